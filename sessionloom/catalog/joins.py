"""JOI-*: joins over the derived panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.catalog.core import R, query
from sessionloom.catalog.filters import FACTS_SQL, ladder_input, LADDER_SQL
from sessionloom.catalog.sqltext import FILINGS, I, MASTER, SPLITS, UNIVERSE, bars as B, lag, lr, ret
from sessionloom.functions.numeric import joined, rnd
from sessionloom.functions.staging import stored
from sessionloom.operators import joins as J
from sessionloom.operators import windows as W
from sessionloom.sources.fixtures import bars, filings, master, session_index, session_range, splits, supplier_region, universe

ID = ["instrument_id", "session_ix"]
IDS = "instrument_id, session_ix"


@query("joi_01_close_to_close", f"""with {B()} select c.instrument_id, c.session_ix, {R('c.close/p.close-1')} as r1, {R('c.close*c.volume', 8)} as dv
 from b c join b p on p.instrument_id=c.instrument_id and p.session_ix=c.session_ix-1""")
def _(t):
    b = W.add_returns(bars(t), lags=(1,)).where("r1 is not null")
    return b.select(*ID, rnd("r1").alias("r1"), rnd(F.col("close") * F.col("volume"), 8).alias("dv"))


@query("joi_02_action_exact_date", f"""with {B()}, {SPLITS} select action_id, case when b.instrument_id is not null then 'resolved' else 'no_exact_date_bar' end as status
 from sp left join b on b.instrument_id=sp.instrument_id and b.session_ix=sp.effective_ix""")
def _(t):
    b = bars(t).select("instrument_id", F.col("session_ix").alias("effective_ix"), F.lit(True).alias("hit"))
    return splits(t).join(b, ["instrument_id", "effective_ix"], "left").select(
        "action_id", F.when(F.col("hit"), "resolved").otherwise("no_exact_date_bar").alias("status"))


@query("joi_03_existence_status", f"""with {B()}, e as (select s_suppkey as instrument_id, s_suppkey%9<>0 as has_evidence from supplier),
 s as (select session_ix, has_evidence, has_prev, has_history
   from (select {IDS}, {lag('close', 1)} is not null as has_prev, (count(*) over (partition by instrument_id order by session_ix range between 19 preceding and current row))>=15 as has_history from b) h join e using (instrument_id))
 select session_ix, has_evidence, has_prev, has_history, count(*) as n from s group by all""")
def _(t):
    k = F.col("s_suppkey")
    ev = t.supplier.where(k % 9 != 0).select(k.alias("instrument_id"), F.lit(True).alias("_e"))
    b = bars(t).select(*ID, W.lagged("close", 1).isNotNull().alias("has_prev"), (F.count(F.lit(1)).over(W.sessions(20)) >= 15).alias("has_history"))
    b = b.join(ev, "instrument_id", "left").withColumn("has_evidence", F.coalesce("_e", F.lit(False)))
    return b.groupBy("session_ix", "has_evidence", "has_prev", "has_history").agg(F.count(F.lit(1)).alias("n"))


def _rebuilt(b):
    k = F.col("instrument_id") * 13 + F.col("session_ix")
    return b.where(k % 20 != 3).select("instrument_id", F.when(k % 61 == 5, F.col("session_ix") + 1000).otherwise(F.col("session_ix")).alias("session_ix"),
                                       F.when(k % 50 == 1, F.col("close") * 2).otherwise(F.col("close")).alias("close"), "volume",
                                       F.when(k % 40 == 2, F.lit("reissue")).otherwise(F.lit("first")).alias("source"))


@query("joi_04_edition_diff", f"""with {B()}, a as (select {IDS}, close, volume, 'first' as source from b),
 r as (select instrument_id, case when k%61=5 then session_ix+1000 else session_ix end as session_ix, case when k%50=1 then close*2 else close end as close, volume, case when k%40=2 then 'reissue' else 'first' end as source
   from (select *, instrument_id*13+session_ix as k from b) where k%20<>3),
 j as (select coalesce(a.session_ix, r.session_ix) as session_ix, case when a.close is null then 'added' when r.close is null then 'absent' when a.close<>r.close or a.volume<>r.volume then 'economic_change' when a.source<>r.source then 'provenance_change' else 'unchanged' end as change
   from a full join r on a.instrument_id=r.instrument_id and a.session_ix=r.session_ix) select session_ix, change, count(*) as n from j group by 1,2""")
def _(t):
    b = bars(t)
    d = J.key_diff(b.withColumn("source", F.lit("first")), _rebuilt(b), ID, ["close", "volume"], ["source"])
    return d.groupBy("session_ix", "change").agg(F.count(F.lit(1)).alias("n"))


def actions_repeat(t):
    k = F.col("instrument_id")
    old = splits(t).where(k % 20 != 0).withColumn("split_to", F.when(k % 12 == 0, F.col("split_to") + 1).otherwise(F.col("split_to")))
    new = t.supplier.where(F.col("s_suppkey") % 9 == 0).select(F.concat_ws("-", F.lit("N"), "s_suppkey").alias("action_id"), F.col("s_suppkey").alias("instrument_id"),
                                                              F.lit(50).alias("effective_ix"), F.lit(1).alias("split_from"), F.lit(2).alias("split_to"))
    return old.select("action_id", "instrument_id", "effective_ix", "split_from", "split_to").unionByName(new)


REPEAT_SQL = f"""{SPLITS}, rp as (select action_id, instrument_id, effective_ix, split_from, case when instrument_id%12=0 then split_to+1 else split_to end as split_to from sp where instrument_id%20<>0
  union all select 'N-'||s_suppkey, s_suppkey, 50, 1, 2 from supplier where s_suppkey%9=0)"""


@query("joi_05_snapshot_diff", f"""with {REPEAT_SQL} select coalesce(sp.action_id, rp.action_id) as action_id, case when sp.action_id is null then 'added' when rp.action_id is null then 'removed'
 when sp.effective_ix<>rp.effective_ix or sp.split_from<>rp.split_from or sp.split_to<>rp.split_to then 'changed' else 'same' end as change,
 case when sp.action_id is null or rp.action_id is null then '' else array_to_string(list_filter([case when sp.effective_ix<>rp.effective_ix then 'effective_ix' end, case when sp.split_from<>rp.split_from then 'split_from' end, case when sp.split_to<>rp.split_to then 'split_to' end], lambda x: x is not null),'|') end as fields
 from sp full join rp on sp.action_id=rp.action_id""")
def _(t):
    d = J.snapshot_diff(splits(t), actions_repeat(t), "action_id", ["effective_ix", "split_from", "split_to"])
    return d.select("action_id", "change", joined(F.col("fields")).alias("fields"))


@query("joi_06_set_compare", f"""with {UNIVERSE}, a as (select s_suppkey as instrument_id from supplier where s_suppkey%6<>0)
 select case when u.instrument_id is null then 'right_only' when a.instrument_id is null then 'left_only' else 'retained' end as side, count(*) as n from u full join a on u.instrument_id=a.instrument_id group by 1""")
def _(t):
    other = t.supplier.where(F.col("s_suppkey") % 6 != 0).select(F.col("s_suppkey").alias("instrument_id"))
    return J.set_compare(universe(t), other, "instrument_id").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def filing_states(t):
    """Filings placed on the weekly calendar: the session whose week holds the availability time."""
    f = filings(t)
    return f.withColumn("session_ix", session_index(F.to_date(F.date_trunc("week", "available_at")), "week"))


@query("joi_07_asof_backward", f"""with {B()}, {FILINGS}, s as (select *, cast(floor(date_diff('day', date '1995-01-02', cast(available_at as date))/7.0)+1 as int) as session_ix from f),
 g as (select c_custkey as cik, unnest(range((select min(session_ix) from b),(select max(session_ix)+1 from b))) as session_ix from customer),
 k as (select cik, session_ix, arg_max(accession, (available_at, accession)) as accession from s group by 1,2)
 select g.cik, cast(g.session_ix as bigint) as session_ix, k.accession, k.session_ix is null as absent from g asof left join k on k.cik=g.cik and k.session_ix<=g.session_ix""")
def _(t):
    first, last = session_range(t)
    states = filing_states(t).withColumn("_at", F.struct("available_at", "accession"))
    out = J.asof_by_span(states, t.customer.select(F.col("c_custkey").alias("cik")), "cik", "_at", ["accession"], first, last)
    return out.select("cik", F.col("session_ix").cast("bigint").alias("session_ix"), "accession", F.col("accession").isNull().alias("absent"))


def calendar(t):
    """Weekly sessions from the first to the last one of the data, with open and close clocks."""
    first, last = session_range(t)
    s = t.spark.range(first, last + 1).select(F.col("id").cast("int").alias("session_ix"))
    day = F.date_add(F.lit("1995-01-02").cast("date"), (F.col("session_ix") - 1) * 7)
    return s.select("session_ix", day.alias("session_date"), (day.cast("timestamp") + F.expr("INTERVAL 14 HOURS 30 MINUTES")).alias("open_utc"),
                    (day.cast("timestamp") + F.expr("INTERVAL 21 HOURS")).alias("close_utc"))


@query("joi_08_asof_forward", f"""with {B()}, {FILINGS}, c as (select distinct session_ix, timestamp '1995-01-02 14:30:00' + (session_ix-1)*interval 7 day as open_utc from (select unnest(range((select min(session_ix) from b),(select max(session_ix)+1 from b))) as session_ix)),
 x as (select accession, case when accession%11=0 then null when accession%7=0 then date_trunc('day', available_at)+interval 1 day else available_at end as bound from f)
 select x.accession, cast(c.session_ix as bigint) as eligible_ix from x asof left join c on c.open_utc > x.bound""")
def _(t):
    f = filings(t)
    at = F.when(F.col("accession") % 7 == 0, F.date_trunc("day", "available_at")).otherwise(F.col("available_at"))
    at = F.when(F.col("accession") % 11 != 0, at)  # some filings have no clock
    out = J.first_open_after(f.select("accession", at.alias("at")), F.col("at"), J.next_session_lookup(calendar(t), "session_date", "open_utc"))
    return out.select("accession", F.col("eligible_ix").cast("bigint").alias("eligible_ix"))


RULES = [("AFRICA", "1995-01-01", "1997-12-31", 0.05), ("AFRICA", "1998-01-01", None, 0.10), ("AMERICA", "1995-01-01", None, 0.10), ("ASIA", "1995-01-01", "1999-06-30", 0.20),
         ("ASIA", "1999-01-01", None, 0.10), ("EUROPE", "1995-01-01", "1996-12-31", 0.05), ("EUROPE", "1998-01-01", None, 0.20)]


def rule_table(spark):
    """Effective-dated rules, with one overlap and one gap (a fixed registry)."""
    return spark.createDataFrame(RULES, "exchange string, f string, t string, ratio double").select(
        "exchange", F.to_date("f").alias("effective_from"), F.to_date("t").alias("effective_to"), "ratio")


RULES_SQL = "ru(exchange, effective_from, effective_to, ratio) as (values " + ",".join(
    f"('{e}', date '{f}', {'null::date' if x is None else f'date {x!r}'}, {r}::double)" for e, f, x, r in RULES) + ")"


@query("joi_09_effective_rule", f"""with {B()}, {MASTER}, {RULES_SQL}, j as (select b.instrument_id, b.session_ix, count(ru.ratio) as n, max(ru.ratio) as ratio from b join m using (instrument_id)
  left join ru on ru.exchange=m.exchange and ru.effective_from<=b.session_date and (ru.effective_to is null or ru.effective_to>=b.session_date) group by 1,2)
 select {IDS}, case n when 0 then 'missing' when 1 then 'resolved' else 'ambiguous' end as rule_status, case when n=1 then ratio end as ratio from j""")
def _(t):
    b = bars(t).join(master(t).select("instrument_id", "exchange"), "instrument_id")
    return J.resolve_rule(b, rule_table(t.spark), "exchange", F.col("session_date")).select(*ID, "rule_status", "ratio")


@query("joi_10_split_factor", f"""with {B()}, {SPLITS} select b.instrument_id, b.session_ix, {R('coalesce(product(split_from)/product(split_to),1.0)')} as price_factor,
 {R('coalesce(product(split_to)/product(split_from),1.0)')} as volume_factor, {R('any_value(b.close)*coalesce(product(split_from)/product(split_to),1.0)', 8)} as adj_close
 from b left join sp on sp.instrument_id=b.instrument_id and sp.effective_ix>b.session_ix and sp.effective_ix<=(select max(session_ix) from b) group by 1,2""")
def _(t):
    df = J.split_factor(bars(t), splits(t), F.lit(session_range(t)[1]))
    return df.select(*ID, rnd("price_factor").alias("price_factor"), rnd("volume_factor").alias("volume_factor"), rnd(F.col("close") * F.col("price_factor"), 8).alias("adj_close"))


@query("joi_11_events_in_windows", f"""with {B()}, {SPLITS} select b.instrument_id, b.session_ix, count(*) filter (effective_ix>session_ix-20 and effective_ix<=session_ix) as n_back,
 count(*) filter (effective_ix>session_ix and effective_ix<=session_ix+1) as n_ahead1, count(*) filter (effective_ix>session_ix and effective_ix<=session_ix+5) as n_ahead5
 from b left join sp on sp.instrument_id=b.instrument_id group by 1,2""")
def _(t):
    return J.events_in_windows(bars(t), splits(t), 20, [1, 5]).select(*ID, "n_back", "n_ahead1", "n_ahead5")


@query("joi_12_terminal_crossing", f"""with {B()}, l as (select instrument_id, max(session_ix) as last_ix from b group by 1)
 select b.instrument_id, count(*) filter (session_ix+5>last_ix) as crossing, count(*) filter (session_ix<=last_ix+1 and session_ix+5>=last_ix+1) as holds_delist, count(*) as n
 from b join l on l.instrument_id=b.instrument_id group by 1""")
def _(t):
    last = F.max("session_ix").over(Window.partitionBy("instrument_id"))
    b = bars(t).select(*ID, last.alias("last_ix"))
    ix, end = F.col("session_ix"), F.col("last_ix")
    return b.groupBy("instrument_id").agg(F.count_if(ix + 5 > end).alias("crossing"), F.count_if((ix <= end + 1) & (ix + 5 >= end + 1)).alias("holds_delist"), F.count(F.lit(1)).alias("n"))


@query("joi_13_interval_overlap", """with s as (select o_custkey as security, cast(min(o_orderdate) as date) as a, cast(max(o_orderdate) as date) as z from orders group by 1)
 select security, a<=date '1997-12-31' and (security%3<>0 or z>=date '1997-01-01') as in_interval from s""")
def _(t):
    s = t.orders.groupBy(F.col("o_custkey").alias("security")).agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("z"))
    z = F.when(F.col("security") % 3 == 0, F.col("z"))
    return s.select("security", ((F.col("a") <= "1997-12-31") & (z.isNull() | (z >= "1997-01-01"))).alias("in_interval"))


@query("joi_14_match_verdict", f"""with {SPLITS}, e as (select action_id, effective_ix as event_ix, cast(split_from as double)/split_to as ratio, ticker as old_symbol, case when instrument_id%5=0 then 'ALT'||(instrument_id%3) else ticker end as new_symbol from sp),
 g as (select effective_ix as event_ix, ticker as symbol, case when instrument_id%12=0 then 9.0 else cast(split_from as double)/split_to end as ratio from sp where instrument_id%28<>0 union all select event_ix, new_symbol, ratio from e where old_symbol<>new_symbol),
 s as (select distinct action_id, event_ix, ratio, unnest([old_symbol, new_symbol]) as symbol from e),
 c as (select s.action_id, count(g.symbol) as n_symbol, count(*) filter (g.ratio=s.ratio) as n_numeric from s left join g on g.event_ix=s.event_ix and g.symbol=s.symbol group by 1)
 select action_id, n_symbol, n_numeric, case n_symbol when 0 then 'none' when 1 then 'unique' else 'ambiguous' end as symbol_match, case when n_symbol=0 then 'none' when n_numeric=0 then 'none' when n_numeric=1 then 'unique' else 'ambiguous' end as numeric_match from c""")
def _(t):
    k = F.col("instrument_id")
    ratio = F.col("split_from").cast("double") / F.col("split_to")
    sp = splits(t)
    ev = sp.select("action_id", F.col("effective_ix").alias("event_ix"), ratio.alias("ratio"), F.col("ticker").alias("old_symbol"),
                   F.when(k % 5 == 0, F.concat(F.lit("ALT"), k % 3)).otherwise(F.col("ticker")).alias("new_symbol"))
    tg = sp.where(k % 28 != 0).select(F.col("effective_ix").alias("event_ix"), F.col("ticker").alias("symbol"), F.when(k % 12 == 0, 9.0).otherwise(ratio).alias("ratio"))
    tg = tg.unionByName(ev.where("old_symbol <> new_symbol").select("event_ix", F.col("new_symbol").alias("symbol"), "ratio"))
    return J.match_verdict(ev, tg, "action_id")


@query("joi_15_members_without_bars", f"""with {B()}, {UNIVERSE}, g as (select instrument_id, cast(unnest(range((select min(session_ix) from b),(select max(session_ix)+1 from b))) as int) as session_ix from u)
 select session_ix, count(*) as n_missing from g anti join b on b.instrument_id=g.instrument_id and b.session_ix=g.session_ix group by 1""")
def _(t):
    return J.missing_sessions(bars(t), universe(t), *session_range(t)).groupBy("session_ix").agg(F.count(F.lit(1)).alias("n_missing"))


@query("joi_16_completeness", f"""with {B()}, x as (select {IDS} from b union all select {IDS} from b where (instrument_id+session_ix)%40=0)
 select instrument_id, count(distinct session_ix) as n_present, (select max(session_ix)-min(session_ix)+1 from b)-count(distinct session_ix) as n_missing, count(*)-count(distinct session_ix) as n_duplicated, 0::bigint as n_extra from x group by 1""")
def _(t):
    b = bars(t).select(*ID)
    return J.completeness(b.unionAll(b.where("(instrument_id + session_ix) % 40 = 0")), *session_range(t))


@query("joi_17_registry_pairs", f"""with {B(entity='type')} select l.instrument_id||'/'||r.instrument_id as pair_id, count(*) as n_shared, min(l.session_ix) as first_ix from b l join b r on l.session_ix=r.session_ix and l.instrument_id<r.instrument_id group by 1""")
def _(t):
    return W.pair_panel(bars(t, "type")).groupBy(F.col("instrument_id").alias("pair_id")).agg(F.count(F.lit(1)).alias("n_shared"), F.min("session_ix").alias("first_ix"))


@query("joi_18_best_partner", f"""with {B('b0', grain='month')}, {B('e0', 'type', 'month')}, s as (select {IDS}, {lr()} as lr from b0), e as (select {IDS}, {lr()} as flr, {ret(5)} as r5 from e0),
 p as (select s.instrument_id, e.instrument_id as fund, s.session_ix, r5, case when lr is not null and flr is not null then lr end as x, case when lr is not null and flr is not null then flr end as y from s join e using (session_ix)),
 c as (select *, count(x) over w as n, round(corr(x,y) over w,10) as cr from p window w as (partition by instrument_id, fund order by session_ix range between 19 preceding and current row)),
 k as (select *, row_number() over (partition by {IDS} order by cr desc, fund) as rn from c where r5>0 and n>=18 and cr>=0.35)
 select s.instrument_id, s.session_ix, k.fund as driver, {R('k.cr')} as driver_corr, k.n as driver_obs from s left join k on k.instrument_id=s.instrument_id and k.session_ix=s.session_ix and rn=1""")
def _(t):
    stock = W.add_log_return(bars(t, grain="month"))
    legs = stored(W.add_returns(W.add_log_return(bars(t, "type", "month")), lags=(5,)), "legs")
    return J.best_partner(stock, legs, 20, 18, 0.35).select(*ID, "driver", rnd("driver_corr").alias("driver_corr"), "driver_obs")


@query("joi_19_change_over_time", f"""with {B(entity='type')}, r as (select {IDS}, {ret(5)} as x from b) select {IDS}, {R('x-' + lag('x', 1))} as change_1, {R('x-' + lag('x', 5))} as change_5 from r""")
def _(t):
    df = bars(t, "type").withColumn("x", W.simple_return(5))
    return df.select(*ID, rnd(F.col("x") - W.lagged("x", 1)).alias("change_1"), rnd(F.col("x") - W.lagged("x", 5)).alias("change_5"))


def adjustments(t):
    """Adjustment observations: backward factor seen at each split (some missing, some off, some extra)."""
    k = F.col("instrument_id")
    per = splits(t).groupBy("instrument_id", "effective_ix").agg((F.product("split_from") / F.product("split_to")).alias("true_ratio"))
    seen = per.where(k % 28 != 0).select("instrument_id", F.col("effective_ix"), F.when(k % 20 == 0, F.col("true_ratio") * 1.1).otherwise(F.col("true_ratio")).alias("step"))
    extra = t.supplier.where(F.col("s_suppkey") % 10 == 1).select(F.col("s_suppkey").alias("instrument_id"), F.lit(120).alias("effective_ix"), F.lit(0.5).alias("step"))
    return per, seen.unionByName(extra)


ADJ_SQL = f"""{SPLITS}, pa as (select instrument_id, effective_ix, product(split_from)/product(split_to) as true_ratio from sp group by 1,2),
 aj as (select instrument_id, effective_ix, case when instrument_id%20=0 then true_ratio*1.1 else true_ratio end as step from pa where instrument_id%28<>0
   union all select s_suppkey, 120, 0.5 from supplier where s_suppkey%10=1)"""


@query("joi_20_action_adjustment_reconcile", f"""with {B()}, {ADJ_SQL}, fb as (select instrument_id, min(session_ix) as first_ix from b group by 1),
 j as (select coalesce(pa.instrument_id, aj.instrument_id) as instrument_id, coalesce(pa.effective_ix, aj.effective_ix) as effective_ix, true_ratio, step from pa full join aj on pa.instrument_id=aj.instrument_id and pa.effective_ix=aj.effective_ix)
 select j.instrument_id, j.effective_ix, case when true_ratio is null then 'no_action' when first_ix is null or first_ix>=j.effective_ix then 'left_boundary' when step is null then 'no_adjustment'
  when abs(true_ratio-1)<1e-12 then 'no_op' when abs(step/true_ratio-1)<=0.001 then 'matched' else 'conflict' end as verdict from j left join fb on fb.instrument_id=j.instrument_id""")
def _(t):
    acts, seen = adjustments(t)
    first = bars(t).groupBy("instrument_id").agg(F.min("session_ix").alias("first_ix"))
    from sessionloom.operators.joins import first_failing

    j = acts.join(seen, ["instrument_id", "effective_ix"], "full_outer").join(first, "instrument_id", "left")
    c = F.col
    return j.select("instrument_id", "effective_ix", first_failing(
        (c("true_ratio").isNull(), "no_action"), (c("first_ix").isNull() | (c("first_ix") >= c("effective_ix")), "left_boundary"), (c("step").isNull(), "no_adjustment"),
        (F.abs(c("true_ratio") - 1) < 1e-12, "no_op"), (F.abs(c("step") / c("true_ratio") - 1) <= 0.001, "matched"), ok="conflict").alias("verdict"))


@query("joi_21_set_equality", f"""with {ADJ_SQL}, l as (select effective_ix//50 as block, round(true_ratio,6) as v from pa), r as (select effective_ix//50 as block, round(step,6) as v from aj),
 d as (select coalesce(l.block, r.block) as block, l.v as lv, r.v as rv from (select distinct * from l) l full join (select distinct * from r) r on l.block=r.block and l.v=r.v)
 select cast(block as bigint) as block, count(*) filter (lv is null or rv is null)=0 as equal_sets, count(lv) as n_left, count(rv) as n_right from d group by 1""")
def _(t):
    acts, seen = adjustments(t)
    blk = F.floor(F.col("effective_ix") / 50).alias("block")
    left = acts.select(blk, F.round("true_ratio", 6).alias("v")).distinct().withColumn("l", F.lit(1))
    right = seen.select(blk, F.round("step", 6).alias("v")).distinct().withColumn("r", F.lit(1))
    d = left.join(right, ["block", "v"], "full_outer")
    return d.groupBy("block").agg((F.count_if(F.col("l").isNull() | F.col("r").isNull()) == 0).alias("equal_sets"), F.count("l").alias("n_left"), F.count("r").alias("n_right"))


@query("joi_22_issuer_to_security", f"""with ln as (select c_custkey as cik, s_suppkey as instrument_id, s_suppkey%5<>0 as common from customer join supplier on c_custkey%7=s_suppkey%7 and c_custkey%(select count(*) from supplier)<=s_suppkey and s_suppkey<c_custkey%(select count(*) from supplier)+9),
 a as (select cik, count(*) filter (common) as n_common, count(*) as n_links from ln group by 1)
 select c_custkey as cik, coalesce(n_common,0) as n_common, case when n_links is null then 'no_link' when n_common=0 then 'no_common_security' when n_common>1 then 'several_common_securities' when c_custkey%17=0 then 'identity_unknown_at_open' else 'applicable' end as verdict
 from customer left join a on a.cik=c_custkey""")
def _(t):
    from sessionloom.operators.aggregates import attach_one_row
    from sessionloom.operators.joins import first_failing

    total = t.supplier.agg(F.count(F.lit(1)).alias("_n"))
    base = attach_one_row(t.customer.select(F.col("c_custkey").alias("cik")), total).withColumn("_p", F.col("cik") % F.col("_n"))
    cand = base.withColumn("instrument_id", F.explode(F.sequence(F.col("_p"), F.col("_p") + 8))).where("instrument_id % 7 = cik % 7")
    links = cand.join(t.supplier.select(F.col("s_suppkey").alias("instrument_id")), "instrument_id")
    agg = links.groupBy("cik").agg(F.count_if(F.col("instrument_id") % 5 != 0).alias("n_common"), F.count(F.lit(1)).alias("n_links"))
    c = F.col
    return t.customer.select(c("c_custkey").alias("cik")).join(agg, "cik", "left").select(
        "cik", F.coalesce("n_common", F.lit(0)).alias("n_common"), first_failing(
            (c("n_links").isNull(), "no_link"), (c("n_common") == 0, "no_common_security"), (c("n_common") > 1, "several_common_securities"),
            (c("cik") % 17 == 0, "identity_unknown_at_open"), ok="applicable").alias("verdict"))


@query("joi_23_ticker_history", f"""with {B()}, h as (select case when instrument_id%3=1 then instrument_id-1 else instrument_id end as ticker, instrument_id, min(session_ix) as first_ix, max(session_ix) as last_ix, count(*) as n from b group by 1,2),
 q as (select s_suppkey+case when s_suppkey%10=0 then 1000000 else 0 end as ticker from supplier)
 select q.ticker, count(h.instrument_id) as n_candidates, min(first_ix) as first_ix, max(last_ix) as last_ix, cast(coalesce(sum(n),0) as bigint) as n_sessions, case count(h.instrument_id) when 0 then 'zero' when 1 then 'one' else 'many' end as verdict
 from q left join h on h.ticker=q.ticker group by 1""")
def _(t):
    k = F.col("instrument_id")
    hist = bars(t).withColumn("ticker", F.when(k % 3 == 1, k - 1).otherwise(k)).groupBy("ticker", "instrument_id").agg(
        F.min("session_ix").alias("f"), F.max("session_ix").alias("l"), F.count(F.lit(1)).alias("n"))
    per = hist.groupBy("ticker").agg(F.count(F.lit(1)).alias("c"), F.min("f").alias("first_ix"), F.max("l").alias("last_ix"), F.sum("n").alias("n"))
    s = F.col("s_suppkey")
    q = t.supplier.select((s + F.when(s % 10 == 0, 1000000).otherwise(0)).alias("ticker"))
    return q.join(per, "ticker", "left").select("ticker", F.coalesce("c", F.lit(0)).alias("n_candidates"), "first_ix", "last_ix", F.coalesce("n", F.lit(0)).alias("n_sessions"),
                                                F.when(F.col("c").isNull(), "zero").when(F.col("c") == 1, "one").otherwise("many").alias("verdict"))


@query("joi_24_residual_evidence", f"""with {B()}, {SPLITS}, lw as (select instrument_id, min(session_ix) as f, max(session_ix) as l from b group by 1), ex as (select s_suppkey as instrument_id, 'x' as e from supplier where s_suppkey%6=0)
 select action_id, case when lw.instrument_id is null then 'no_lifecycle' when effective_ix<f then 'before_first_bar' when effective_ix>l then 'after_last_bar' when e is not null then 'inside_with_external' else 'inside_without_external' end as verdict
 from sp left join lw on lw.instrument_id=sp.instrument_id left join ex on ex.instrument_id=sp.instrument_id""")
def _(t):
    from sessionloom.operators.joins import first_failing

    life = bars(t).groupBy("instrument_id").agg(F.min("session_ix").alias("f"), F.max("session_ix").alias("l"))
    ext = t.supplier.where("s_suppkey % 6 = 0").select(F.col("s_suppkey").alias("instrument_id"), F.lit("x").alias("e"))
    c = F.col
    return splits(t).join(life, "instrument_id", "left").join(ext, "instrument_id", "left").select("action_id", first_failing(
        (c("f").isNull(), "no_lifecycle"), (c("effective_ix") < c("f"), "before_first_bar"), (c("effective_ix") > c("l"), "after_last_bar"), (c("e").isNotNull(), "inside_with_external"),
        ok="inside_without_external").alias("verdict"))


@query("joi_25_label_binding", f"""with {B(grain='month')}, o as (select {IDS} from b where session_ix>20),
 l as (select {IDS}, (coalesce(lead(session_ix,1) {I}-session_ix=1, false))::int + (coalesce(lead(session_ix,3) {I}-session_ix=3, false))::int + (coalesce(lead(session_ix,5) {I}-session_ix=5, false))::int as n_labels, {ret(20)} as ctl from b)
 select session_ix, count(*) as n_obs, count(ctl) as n_controls, cast(sum(n_labels) as bigint) as n_labels, count(*) filter (ctl is not null and n_labels=3) as n_bound
 from o join l using ({IDS}) group by 1""")
def _(t):
    b = bars(t, grain="month")
    ahead = sum(((F.lead("session_ix", h).over(W.BY) - F.col("session_ix")).eqNullSafe(F.lit(h)).cast("bigint") for h in (1, 3, 5)), F.lit(0))
    b = b.select("session_ix", W.simple_return(20).alias("ctl"), ahead.alias("n")).where("session_ix > 20")
    return b.groupBy("session_ix").agg(F.count(F.lit(1)).alias("n_obs"), F.count("ctl").alias("n_controls"), F.sum("n").alias("n_labels"),
                                       F.count_if(F.col("ctl").isNotNull() & (F.col("n") == 3)).alias("n_bound"))


@query("joi_26_panel_consistency", f"""with {B()}, p as (select {IDS}, close, volume from b union all select {IDS}, case when (instrument_id+session_ix)%70=0 then close+1 else close end, volume from b where session_ix>200)
 select n_copies, consistent, count(*) as n from (select {IDS}, count(*) as n_copies, count(distinct (close, volume))=1 as consistent from p group by 1,2) group by 1,2""")
def _(t):
    b = bars(t).select(*ID, "close", "volume")
    second = b.where("session_ix > 200").withColumn("close", F.when((F.col("instrument_id") + F.col("session_ix")) % 70 == 0, F.col("close") + 1).otherwise(F.col("close")))
    return J.consistent(b.unionByName(second), ID, ["close", "volume"]).groupBy("n_copies", "consistent").agg(F.count(F.lit(1)).alias("n"))


@query("joi_28_identifier_cascade", """with r as (select s_suppkey as row_id, case when s_suppkey%3=0 then 'F'||(s_suppkey%40) end as share_id, case when s_suppkey%2=0 then 'C'||(s_suppkey%60) end as composite_id, case when s_suppkey%5<>1 then s_name end as ticker from supplier),
 x as (select 'share_id' as kind, 'F'||(s_suppkey%70) as value, s_suppkey as target from supplier where s_suppkey%2=0 union all select 'composite_id', 'C'||(s_suppkey%80), s_suppkey from supplier where s_suppkey%3=1 union all select 'ticker', s_name, s_suppkey from supplier where s_suppkey%4<>3 union all select 'ticker', s_name, s_suppkey+1 from supplier where s_suppkey%8=1),
 ix as (select kind, value, count(*) as n, min(target) as target from x group by 1,2),
 h as (select row_id, 0 as pos, ix.* from r join ix on kind='share_id' and value=share_id union all select row_id, 1, ix.* from r join ix on kind='composite_id' and value=composite_id union all select row_id, 2, ix.* from r join ix on kind='ticker' and value=ticker),
 b as (select *, row_number() over (partition by row_id order by pos) as rn from h)
 select r.row_id, b.kind as method, case when coalesce(share_id, composite_id, ticker) is null then 'no_identifier' when b.kind is null then 'unjoined' when n>1 and kind='ticker' then 'ambiguous' when n>1 then 'collision' else 'resolved' end as status, case when n=1 then target end as target
 from r left join b on b.row_id=r.row_id and rn=1""")
def _(t):
    s, n = F.col("s_suppkey"), F.col("s_name")
    rows = t.supplier.select(s.alias("row_id"), F.when(s % 3 == 0, F.concat(F.lit("F"), s % 40)).alias("share_id"), F.when(s % 2 == 0, F.concat(F.lit("C"), s % 60)).alias("composite_id"), F.when(s % 5 != 1, n).alias("ticker"))
    part = lambda kind, cond, value, target: t.supplier.where(cond).select(F.lit(kind).alias("kind"), value.alias("value"), target.alias("target"))
    refs = part("share_id", s % 2 == 0, F.concat(F.lit("F"), s % 70), s).unionAll(part("composite_id", s % 3 == 1, F.concat(F.lit("C"), s % 80), s)).unionAll(
        part("ticker", s % 4 != 3, n, s)).unionAll(part("ticker", s % 8 == 1, n, s + 1))
    index = refs.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_targets"), F.min("target").alias("target"))
    return J.cascade(rows, index, "row_id", ["share_id", "composite_id", "ticker"])


@query("joi_29_event_neighbourhood", f"""with {FILINGS}, bd as (select c_custkey as cik, date '1996-01-01' + cast(c_custkey%900 as int) as d1, date '1996-01-01' + cast(c_custkey%900 as int) + 120 as d2 from customer),
 j as (select f.cik, form, case when cast(available_at as date)<d1 then 'before' when cast(available_at as date)=d1 or cast(available_at as date)=d2 then 'on_boundary' when cast(available_at as date)<d2 then 'between' else 'after' end as place
   from f join bd using (cik) where cast(available_at as date) between d1-180 and d2+180)
 select cik, form, place, count(*) as n from j group by 1,2,3""")
def _(t):
    k = F.col("c_custkey")
    d1 = F.date_add(F.lit("1996-01-01").cast("date"), (k % 900).cast("int"))
    bd = t.customer.select(k.alias("cik"), d1.alias("d1"), F.date_add(d1, 120).alias("d2"))
    day = F.to_date("available_at")
    j = filings(t).join(bd, "cik").where(day.between(F.date_sub("d1", 180), F.date_add("d2", 180)))
    place = F.when(day < F.col("d1"), "before").when((day == F.col("d1")) | (day == F.col("d2")), "on_boundary").when(day < F.col("d2"), "between").otherwise("after")
    return j.groupBy("cik", "form", place.alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query("joi_30_successor_valuation", f"""with {B()}, x as (select instrument_id, max(session_ix) as last_ix from b where instrument_id%4=1 group by 1),
 tm as (select instrument_id, last_ix+1 as pay_ix, instrument_id+1 as successor_id, cast(1+instrument_id%3 as double)/2 as ratio, cast(instrument_id%7 as double) as cash from x)
 select tm.instrument_id, tm.pay_ix, {R('cash+ratio*b.close', 8)} as terminal_value, case when b.close is null then 'successor_bar_missing' when b.trades<1 then 'successor_bar_invalid' else 'valued' end as status
 from tm left join b on b.instrument_id=tm.successor_id and b.session_ix=tm.pay_ix""")
def _(t):
    b = bars(t)
    k = F.col("instrument_id")
    terms = b.where(k % 4 == 1).groupBy("instrument_id").agg((F.max("session_ix") + 1).alias("pay_ix")).select(
        "instrument_id", "pay_ix", (k + 1).alias("successor_id"), ((1 + k % 3).cast("double") / 2).alias("ratio"), (k % 7).cast("double").alias("cash"))
    succ = b.select(k.alias("successor_id"), F.col("session_ix").alias("pay_ix"), "close", "trades")
    return terms.join(succ, ["successor_id", "pay_ix"], "left").select(
        "instrument_id", "pay_ix", rnd(F.col("cash") + F.col("ratio") * F.col("close"), 8).alias("terminal_value"),
        F.when(F.col("close").isNull(), "successor_bar_missing").when(F.col("trades") < 1, "successor_bar_invalid").otherwise("valued").alias("status"))
