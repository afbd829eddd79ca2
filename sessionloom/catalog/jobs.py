"""JOB-24..70, INF-*: membership, action, filing, research and rule jobs; remaining WIN-* rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.catalog.aggregates import IC_SQL, _RK, ic_panel
from sessionloom.catalog.core import R, query
from sessionloom.catalog.filters import LADDER_SQL, RISK_SQL, ladder_input, risk_input
from sessionloom.catalog.joins import RULES_SQL, calendar, rule_table
from sessionloom.catalog.sqltext import DIVIDENDS, FILINGS, I, MASTER, SPLITS, UNIVERSE, bars as B, cont, full, lag, lr, needs, ret, rows, sess
from sessionloom.functions import scalars as SC
from sessionloom.functions.numeric import first_failing, joined, rnd
from sessionloom.operators import aggregates as A
from sessionloom.operators import crosssection as X
from sessionloom.operators import joins as J
from sessionloom.operators import windows as W
from sessionloom.operators.topk import top_n
from sessionloom.plans import filings as FP
from sessionloom.plans import research as RS
from sessionloom.sources.fixtures import bars, dividends, filings, master, session_range, splits, universe

ID = ["instrument_id", "session_ix"]
IDS = "instrument_id, session_ix"


@query("win_27_latest_by_time", f"""with {FILINGS}, x as (select cik, concept, date_trunc('month', available_at) as av, round(value/100000) as v from f), l as (select cik, concept, max(av) as av from x group by 1,2)
 select x.cik, x.concept, strftime(any_value(l.av),'%Y-%m') as latest, count(distinct v)>1 as conflict, case when count(distinct v)=1 then min(v) end as value from x join l on l.cik=x.cik and l.concept=x.concept and l.av=x.av group by 1,2""")
def _(t):
    f = filings(t).select("cik", "concept", F.date_trunc("month", "available_at").alias("available_at"), F.round(F.col("value") / 100000).alias("value"))
    top = FP.clean_accessions(f, ["cik", "concept"]).groupBy("cik", "concept").agg(F.max(F.struct("available_at", "value", "conflict")).alias("t"))
    return top.select("cik", "concept", F.date_format("t.available_at", "yyyy-MM").alias("latest"), F.col("t.conflict").alias("conflict"), F.when(~F.col("t.conflict"), F.col("t.value")).alias("value"))


def quarters(t):
    """Quarter sums per issuer, cumulated inside the year (imitates year-to-date reporting)."""
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    q = t.orders.groupBy(F.col("o_custkey").alias("cik"), F.year("o_orderdate").alias("fy"), F.quarter("o_orderdate").alias("fq")).agg(cents.alias("cents"))
    by = W.Window.partitionBy("cik", "fy").orderBy("fq").rowsBetween(W.Window.unboundedPreceding, 0)
    return q.select("cik", "fy", "fq", (F.col("fy") * 4 + F.col("fq")).alias("q_ix"), (F.sum("cents").over(by) / 100.0).alias("ytd"))


_TTM = """q0 as (select o_custkey as cik, year(o_orderdate) as fy, quarter(o_orderdate) as fq, sum(cast(round(o_totalprice*100) as bigint)) as cents from orders group by 1,2,3),
 q1 as (select cik, fy, fq, fy*4+fq as q_ix, cast(sum(cents) over (partition by cik, fy order by fq) as bigint)/100.0 as ytd from q0),
 q2 as (select *, case when fq=1 then ytd when q_ix-lag(q_ix) over w=1 then ytd-lag(ytd) over w end as discrete, q_ix-lag(q_ix,4) over w=4 as five from q1 window w as (partition by cik order by q_ix)),
 q3 as (select *, coalesce(five and count(discrete) over l4=4, false) as ok, sum(discrete) over l4 as s4 from q2 window l4 as (partition by cik order by q_ix rows between 3 preceding and current row))"""


@query("win_28_ttm", f"with {_TTM} select cik, cast(q_ix as bigint) as q_ix, {R('discrete', 3)} as discrete, {R('case when ok then s4 end', 3)} as ttm, case when ok then 'derived' else 'not_consecutive' end as status from q3")
def _(t):
    return FP.ttm(quarters(t)).select("cik", F.col("q_ix").cast("bigint").alias("q_ix"), rnd("discrete", 3).alias("discrete"), rnd("ttm", 3).alias("ttm"), "status")


@query("job_44_ttm_summary", f"with {_TTM} select status, count(*) as n, count(distinct cik) as n_issuers from (select cik, case when ok then 'derived' else 'not_consecutive' end as status from q3) group by 1")
def _(t):
    return FP.ttm(quarters(t)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cik").alias("n_issuers"))


@query("win_29_adjustment_observations", f"""with {B()}, a as (select {IDS}, cast((session_ix//60)%2 as int) as f1, cast(instrument_id%3 as int) as f2 from b), l as (select *, lag(f1) {I} as p1, lag(f2) {I} as p2 from a)
 select session_ix, case when p1 is null then 'first' when p1=f1 and p2=f2 then 'no_op' else 'changed' end as kind, count(*) as n from l group by 1,2""")
def _(t):
    a = bars(t).select(*ID, F.struct((F.floor(F.col("session_ix") / 60) % 2).alias("f1"), (F.col("instrument_id") % 3).alias("f2")).alias("f"))
    prev = F.lag("f").over(W.BY)
    a = a.select("session_ix", F.when(prev.isNull(), "first").when(prev.eqNullSafe(F.col("f")), "no_op").otherwise("changed").alias("kind"))
    return a.groupBy("session_ix", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("win_31_dominance", """with v as (select o_custkey as k, o_orderkey%7 as variant, max(o_orderkey%101) as c1, max(o_orderkey%53) as c2 from orders group by 1,2), m as (select k, max(c1) as m1, max(c2) as m2 from v group by 1),
 d as (select v.k, count(*) filter (c1=m1 and c2=m2) as n, min(variant) filter (c1=m1 and c2=m2) as pick from v join m using (k) group by 1) select k, case n when 0 then 'crossed' when 1 then 'dominant' else 'tie' end as status, case when n=1 then pick end as pick from d""")
def _(t):
    o = F.col("o_orderkey")
    v = t.orders.groupBy(F.col("o_custkey").alias("k"), (o % 7).alias("variant")).agg(F.max(o % 101).alias("c1"), F.max(o % 53).alias("c2"))
    m = v.groupBy("k").agg(F.max("c1").alias("m1"), F.max("c2").alias("m2"))
    hit = (F.col("c1") == F.col("m1")) & (F.col("c2") == F.col("m2"))
    d = v.join(m, "k").groupBy("k").agg(F.count_if(hit).alias("n"), F.min(F.when(hit, F.col("variant"))).alias("pick"))
    return d.select("k", F.when(F.col("n") == 0, "crossed").when(F.col("n") == 1, "dominant").otherwise("tie").alias("status"), F.when(F.col("n") == 1, F.col("pick")).alias("pick"))


@query("win_34_channel_rank", f"""with {RISK_SQL}, tk as (select s_suppkey as instrument_id, s_name as ticker from supplier), x as (select *, cast(instrument_id%3 as int) as channel, case when confidence>=50 then 0 else 1 end as st from ri join tk using (instrument_id) where score is not null) select {IDS}, channel, row_number() over (partition by session_ix, channel order by st, score desc, ticker, instrument_id) as rank from x""")
def _(t):
    from sessionloom.functions.ranking import rank_table

    x = risk_input(t).where("score is not null").join(master(t).select("instrument_id", "ticker"), "instrument_id")
    x = x.withColumn("channel", (F.col("instrument_id") % 3).cast("int")).withColumn("status", F.when(F.col("confidence") >= 50, 0).otherwise(1)).withColumn("below", -F.col("score"))
    # scores are ranked exactly within a status, statuses follow each other by their counts, equal scores are ordered among themselves
    tied = ["session_ix", "channel", "status", "below"]
    r = rank_table(x, tied[:3], "below").select(*tied, "n_lower")
    first = x.groupBy("session_ix", "channel").agg(F.count_if(F.col("status") == 0).alias("n_first"))
    among = F.row_number().over(Window.partitionBy(*tied).orderBy("ticker", "instrument_id"))
    out = x.withColumn("among", among).join(r, tied).join(first, ["session_ix", "channel"])
    rank = F.col("n_lower") + F.col("among") + F.when(F.col("status") == 1, F.col("n_first")).otherwise(0)
    return out.select(*ID, "channel", rank.cast("bigint").alias("rank"))


@query("job_14_candidate_facts", f"""with {B(grain='month')}, a as (select *, {ret(1)} as r1, {ret(5)} as r5, {ret(20)} as r20, {lr()} as lr, {full('avg(close)', 10)} as s10, {full('avg(close)', 20)} as s20, open/{lag('close', 1)}-1 as gap, case when count(volume) {sess(20, 1)}>=15 then median(volume) {sess(20, 1)} end as pm from b)
 select {IDS}, {R('r1')} as r1, {R('r5')} as r5, {R('r20')} as r20, {R('case when close>s10 then 100.0 when s10 is not null then 0.0 end')} as above10, {R('s10/s20-1')} as sma_spread, {R('case when pm>0 then volume/pm end')} as volume_ratio, {R(needs('lr', 10, 'stddev_samp(lr)') + '*sqrt(252)')} as rv10, {R(needs('gap', 5, 'max(abs(gap))'))} as max_gap,
 coalesce(abs(r1)>=10 or abs(gap)>=10, false) as review from a""")
def _(t):
    df = W.open_gaps(W.realised_volatility(W.volume_ratio(W.trailing_means(W.add_returns(bars(t, grain="month")))), windows=(10,)))
    c = F.col
    above = F.when(c("above10").isNotNull(), F.when(c("above10"), 100.0).otherwise(0.0))
    review = F.coalesce((F.abs("r1") >= 10) | (F.abs("gap") >= 10), F.lit(False))
    return df.select(*ID, *[rnd(x).alias(x) for x in ("r1", "r5", "r20", "sma_spread", "volume_ratio", "rv10", "max_gap")], rnd(above).alias("above10"), review.alias("review"))


@query("job_24_backfill_batches", f"""with {B()}, {UNIVERSE}, g as (select instrument_id, cast(unnest(range((select min(session_ix) from b),(select max(session_ix)+1 from b))) as int) as session_ix from u), m as (select g.* from g anti join b on b.instrument_id=g.instrument_id and b.session_ix=g.session_ix),
 r as (select *, (row_number() over (partition by instrument_id order by session_ix)-1)//3 as batch from m) select instrument_id, cast(batch as bigint) as batch, min(session_ix) as first_ix, max(session_ix) as last_ix, count(*) as n from r group by 1,2""")
def _(t):
    m = J.missing_sessions(bars(t), universe(t), *session_range(t))
    m = m.withColumn("batch", F.floor((F.row_number().over(W.BY) - 1) / 3))
    return m.groupBy("instrument_id", "batch").agg(F.min("session_ix").alias("first_ix"), F.max("session_ix").alias("last_ix"), F.count(F.lit(1)).alias("n"))


@query("job_25_trailing_liquidity", f"""with {LADDER_SQL} select session_ix, case when prev_close is null then 'missing_previous_bar' when n_history<20 then 'insufficient_history' when prev_close<600 then 'below_price_threshold' when median_dv<50000 then 'below_liquidity_threshold' else 'passed' end as status, count(*) as n from li where policy='A' group by 1,2""")
def _(t):
    c = F.col
    st = first_failing((c("prev_close").isNull(), "missing_previous_bar"), (c("n_history") < 20, "insufficient_history"), (c("prev_close") < 600.0, "below_price_threshold"), (c("median_dv") < 50000.0, "below_liquidity_threshold"), ok="passed")
    return ladder_input(t).where("policy = 'A'").groupBy("session_ix", st.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("job_31_split_ledger", f"""with {B()}, {SPLITS}, e as (select instrument_id, effective_ix, product(split_from)/product(split_to) as factor, count(*) as n_actions from sp group by 1,2)
 select e.instrument_id, e.effective_ix, {R('factor')} as factor, n_actions, count(b.session_ix) as impacted_bars, case when n_actions>1 then 'quarantined' else 'clear' end as status from e left join b on b.instrument_id=e.instrument_id and b.session_ix<e.effective_ix group by all""")
def _(t):
    e = splits(t).groupBy("instrument_id", "effective_ix").agg((F.product("split_from") / F.product("split_to")).alias("factor"), F.count(F.lit(1)).alias("n_actions"))
    have = bars(t).groupBy("instrument_id").agg(F.collect_set("session_ix").alias("_ix"))
    n = F.size(F.filter(F.coalesce("_ix", F.array().cast("array<int>")), lambda x: x < F.col("effective_ix")))
    return e.join(have, "instrument_id", "left").select("instrument_id", "effective_ix", rnd("factor").alias("factor"), "n_actions", n.cast("bigint").alias("impacted_bars"), F.when(F.col("n_actions") > 1, "quarantined").otherwise("clear").alias("status"))


@query("job_33_split_coverage", f"""with {B()}, {SPLITS}, g as (select {IDS}, open/{lag('close', 1)} as r from b), e as (select instrument_id, effective_ix, product(split_from)/product(split_to) as factor from sp group by 1,2),
 j as (select g.session_ix, r, factor, r*coalesce(1/factor,1.0) as residual from g left join e on e.instrument_id=g.instrument_id and e.effective_ix=g.session_ix where r>=2 or r<=0.5)
 select session_ix, count(*) as n_severe, count(factor) as n_with_event, count(*) filter (factor is null or residual>=2 or residual<=0.5) as n_unexplained from j group by 1""")
def _(t):
    e = splits(t).groupBy("instrument_id", F.col("effective_ix").alias("session_ix")).agg((F.product("split_from") / F.product("split_to")).alias("factor"))
    j = W.discontinuities(bars(t)).where("severe").join(e, ID, "left")
    res = F.col("open_ratio") * F.coalesce(1 / F.col("factor"), F.lit(1.0))
    return j.groupBy("session_ix").agg(F.count(F.lit(1)).alias("n_severe"), F.count("factor").alias("n_with_event"), F.count_if(F.col("factor").isNull() | (res >= 2) | (res <= 0.5)).alias("n_unexplained"))


@query("job_34_dividend_review", f"with {B()}, {DIVIDENDS} select action_id, {R('(prior_close-cash)/prior_close')} as backward_factor, case when cash>=prior_close then 'cash_not_below_close' when cash/prior_close>=0.25 then 'large_dividend_review' else 'clear' end as flag from dv")
def _(t):
    c = F.col
    return dividends(t, bars(t)).select("action_id", rnd((c("prior_close") - c("cash")) / c("prior_close")).alias("backward_factor"),
                                        first_failing((c("cash") >= c("prior_close"), "cash_not_below_close"), (c("cash") / c("prior_close") >= 0.25, "large_dividend_review"), ok="clear").alias("flag"))


@query("job_38_filing_clock_ledger", f"""with {FILINGS}, g as (select cik, accession//4 as package, max(case when accession%5<>0 and (accession//4)%9<>0 then available_at end) as accepted, count(*) as n_forms, count(distinct cast(available_at as date)) as n_dates from f group by 1,2), c as (select range as session_ix, timestamp '1995-01-02 14:30:00' + (range-1)*interval 7 day as open_utc from range(1,400))
 select g.cik, cast(g.package as bigint) as package, n_forms, n_dates=1 as dates_agree, case when accepted is null then 'quarantined' else 'admitted' end as admission, cast(c.session_ix as bigint) as eligible_ix from g asof left join c on c.open_utc > g.accepted""")
def _(t):
    # rows without an acceptance clock, and packages that have none at all
    clock = F.when((F.col("accession") % 5 != 0) & (F.floor(F.col("accession") / 4) % 9 != 0), F.col("available_at"))
    g = filings(t).groupBy("cik", F.floor(F.col("accession") / 4).alias("package")).agg(F.max(clock).alias("accepted"), F.count(F.lit(1)).alias("n_forms"), F.countDistinct(F.to_date("available_at")).alias("n_dates"))
    out = J.first_open_after(g, F.col("accepted"), J.next_session_lookup(calendar(t), "session_date", "open_utc"))
    return out.select("cik", "package", "n_forms", (F.col("n_dates") == 1).alias("dates_agree"), F.when(F.col("accepted").isNull(), "quarantined").otherwise("admitted").alias("admission"), F.col("eligible_ix").cast("bigint").alias("eligible_ix"))


@query("job_42_point_in_time", f"""with {FILINGS}, x as (select cik, concept, period_end, date_trunc('month', available_at) as av, round(value/100000) as v from f where date_trunc('month', available_at)<=timestamp '1999-06-30'),
 pt as (select cik, concept, period_end, av, min(v) as v, min(v)<>max(v) as bad from x group by 1,2,3,4), p as (select cik, concept, period_end, max(av) as av, count(*) as n_versions from pt group by 1,2,3), k as (select cik, concept, max(period_end) as pe, count(*) as n_periods from p group by 1,2)
 select k.cik, k.concept, cast(k.pe as varchar) as period_end, p.n_versions, k.n_periods, case when not bad then v end as value, case when bad then 'quarantined_conflict' else 'selected' end as status
 from k join p on p.cik=k.cik and p.concept=k.concept and p.period_end=k.pe join pt on pt.cik=k.cik and pt.concept=k.concept and pt.period_end=k.pe and pt.av=p.av""")
def _(t):
    f = filings(t).select("cik", "concept", "period_end", F.date_trunc("month", "available_at").alias("available_at"), F.round(F.col("value") / 100000).alias("value"))
    return FP.point_in_time(f, ["cik", "concept"], F.lit("1999-06-30").cast("timestamp")).select("cik", "concept", F.col("period_end").cast("string").alias("period_end"), "n_versions", "n_periods", "value", "status")


_F1 = ["relative_return_20", "relative_acceleration", "signed_path_efficiency", "largest_return_share", "positive_share", "atr_ratio_5_14", "prior_range_atr", "close_vs_prior_high_atr", "gap_atr", "dollar_volume_surprise", "close_location", "max_drawdown"]


@query("job_46_factor_catalog", f"""with {B('b0', 'brand')}, {B('mk', 'market')}, b as (select b0.*, mk.close as b_close from b0 left join mk using (session_ix)),
 a as (select *, {lr()} as lr, case when {lag('close', 1)} is not null then greatest(high-low, abs(high-{lag('close', 1)}), abs(low-{lag('close', 1)})) end as tr, close*volume as dv from b),
 w as (select *, {cont(21)} as ok, {needs('lr', 10, 'sum(lr)')} as net, {needs('lr', 10, 'sum(abs(lr))')} as sz, {needs('lr', 10, 'max(abs(lr))')} as big, {needs('lr', 10, 'sum((lr>0)::int)')} as pos, avg(tr) {rows(14, 1)} as a14, avg(tr) {rows(5, 1)} as a5, max(close) {rows(10, 1)}-min(close) {rows(10, 1)} as rg,
   max(close) {rows(20, 1)} as ph, median(dv) {rows(20, 1)} as md, abs(open-{lag('close', 1)}) as gp, ln(close/{lag('close', 20)})-ln(b_close/{lag('b_close', 20)}) as r20, ln(close/{lag('close', 5)})-ln(b_close/{lag('b_close', 5)})-(ln({lag('close', 5)}/{lag('close', 20)})-ln({lag('b_close', 5)}/{lag('b_close', 20)}))/3 as acc,
   list(close) {rows(11)} as pth from a)
 select {IDS}, {R('case when ok then r20 end')} as relative_return_20, {R('case when ok then acc end')} as relative_acceleration, {R('case when ok then net/nullif(sz,0) end')} as signed_path_efficiency, {R('case when ok then big/nullif(sz,0) end')} as largest_return_share, {R('case when ok then pos/10.0 end')} as positive_share,
  {R('case when ok then a5/nullif(a14,0) end')} as atr_ratio_5_14, {R('case when ok then rg/nullif(a14,0) end')} as prior_range_atr, {R('case when ok then (close-ph)/nullif(a14,0) end')} as close_vs_prior_high_atr, {R('case when ok then gp/nullif(a14,0) end')} as gap_atr, {R('case when ok then dv/nullif(md,0) end')} as dollar_volume_surprise,
  {R('case when ok and high>low then (close-low)/(high-low) end')} as close_location, {R("case when ok then least(0.0, list_min(list_transform(range(2,12), lambda k: pth[k]/list_max(pth[1:k-1])-1))) end")} as max_drawdown from w""")
def _(t):
    f = RS.factor_catalog(bars(t, "brand"), bars(t, "market"))
    return f.select(*ID, *[rnd(c).alias(c) for c in _F1])


def _lab(h):
    own = f"lead(close,{h}) {I}/lead(open,1) {I}-1"
    ok = f"lead(session_ix,{h}) {I}-session_ix={h} and lead(session_ix,1) {I}-session_ix=1"
    fr = f"over (partition by instrument_id order by session_ix rows between 1 following and {h} following)"
    return (f"{R(f'case when {ok} then {own} end')} as ret{h}, {R(f'case when {ok} then {own}-(lead(b_close,{h}) {I}/lead(b_open,1) {I}-1) end')} as rel{h}, {R(f'case when {ok} then max(high) {fr}/lead(open,1) {I}-1 end')} as mfe{h}, "
            f"{R(f'case when {ok} then min(low) {fr}/lead(open,1) {I}-1 end')} as mae{h}, case when lead(session_ix,{h}) {I}-session_ix={h} then 'mature' else 'pending' end as state{h}")


@query("job_51_forward_labels", f"with {B('b0')}, {B('mk', 'market')}, b as (select b0.*, mk.open as b_open, mk.close as b_close from b0 left join mk using (session_ix)) select {IDS}, {_lab(1)}, {_lab(3)}, {_lab(5)} from b")
def _(t):
    l = RS.forward_labels(bars(t), bars(t, "market"))
    return l.select(*ID, *[rnd(f"{k}{h}").alias(f"{k}{h}") for h in (1, 3, 5) for k in ("ret", "rel", "mfe", "mae")], "state1", "state3", "state5")


@query("job_52_nuisance_control", f"with {B('b0', 'brand')}, {B('mk', 'market')}, b as (select b0.*, mk.close as b_close from b0 left join mk using (session_ix)) select {IDS}, {R(ret(20) + '-(b_close/' + lag('b_close', 20) + '-1)')} as control from b")
def _(t):
    df = W.relative_strength(W.versus_benchmark(bars(t, "brand"), bars(t, "market")))
    return df.select(*ID, rnd("rel20").alias("control"))


_ICS = f"{IC_SQL}, r0 as (select session_ix, {_RK.format(c='factor')} as x, {_RK.format(c='target')} as y from ip where factor is not null and target is not null), ics as (select session_ix, corr(x,y) as ic from r0 group by 1 having count(*)>=2)"
_BOOT = f"""{_ICS}, z as (select row_number() over (order by session_ix)-1 as j, ic, count(*) over () as n from ics where ic is not null), nn as (select count(*) as n, avg(ic) as mean from z),
 bs as (select a.j as s, sum(b.ic) as full_, sum(b.ic) filter ((b.j-a.j+a.n)%a.n < a.n%5) as tail_ from z a join z b on (b.j-a.j+a.n)%a.n<5 group by 1),
 rp as (select r.range as rep, k.range as k, n, mean, ('0x'||substr(md5('ic-v1|reversal|'||r.range||'|'||k.range),1,8))::bigint%n as s from range(10000) r, nn, range(0, (n+4)//5) k),
 bt as (select rep, any_value(mean) as mean, sum(case when k<n//5 then full_ else tail_ end)/any_value(n) as boot from rp join bs using (s) group by 1)"""


def _ic_series(t):
    ic = A.rank_ic(ic_panel(t), ["session_ix"], "factor", "target").where("ic is not null")
    return ic.select("session_ix", "ic", F.lit("reversal").alias("trial"))


@query("inf_01_block_bootstrap", f"with {_BOOT} select 'reversal' as trial, {R('any_value(mean)')} as mean, {R('quantile_cont(boot,0.05)')} as lower, {R('quantile_cont(boot,0.95)')} as upper, {R('(count(*) filter (boot-mean>=mean)+1)/(count(*)+1)')} as p_value from bt")
def _(t):
    from sessionloom.functions.staging import cut

    boot = cut(RS.block_bootstrap(cut(_ic_series(t)), "trial", "ic", 10000, 5, "ic-v1"))
    r = RS.bootstrap_report(boot, "trial")
    return r.select("trial", *[rnd(c).alias(c) for c in ("mean", "lower", "upper", "p_value")])


@query("inf_03_gates", f"""with {_ICS}, m as (select unnest([{{'metric':'mean_ic','value':avg(ic)}},{{'metric':'positive_share','value':avg((ic>0)::int)}},{{'metric':'n_sessions','value':count(ic)}}]) as e from ics),
 th(metric, op, threshold) as (values ('mean_ic','>=',0.02),('positive_share','>=',0.5),('n_sessions','>=',60.0),('worst_ic','>=',-0.5)) select th.metric, {R('e.value')} as value, case when e.value is null then 'inconclusive' when e.value>=threshold then 'pass' else 'fail' end as outcome from th left join m on e.metric=th.metric""")
def _(t):
    s = _ic_series(t).agg(F.avg("ic").alias("mean_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_share"), F.count("ic").cast("double").alias("n_sessions"))
    m = s.unpivot([], ["mean_ic", "positive_share", "n_sessions"], "metric", "value")
    th = t.spark.createDataFrame([("mean_ic", ">=", 0.02), ("positive_share", ">=", 0.5), ("n_sessions", ">=", 60.0), ("worst_ic", ">=", -0.5)], "metric string, op string, threshold double")
    return RS.gates(m, th).select("metric", rnd("value").alias("value"), "outcome")


@query("job_57_cohorts", f"""with {B(grain='month')}, a as (select {IDS}, {ret(20)} as x, close>{lag('close', 1)} as pc, close>{lag('high', 1)} as pch, case when {cont(6)} then (max(close) {rows(5, 1)}-close)/nullif(max(close) {rows(5, 1)}-min(close) {rows(5, 1)},0) end as depth, volume/nullif({lag('volume', 1)},0) as vr from b),
 k as (select * from a where x is not null and depth is not null and vr is not null), r as (select *, case when count(*) over (partition by session_ix, x)=count(*) over (partition by session_ix) then 50.0 else 100.0*(rank() over (partition by session_ix order by x)+(count(*) over (partition by session_ix, x)-1)/2.0-1)/(count(*) over (partition by session_ix)-1) end as rs from k),
 g as (select row_number() over (order by a.i, d.i, c.i, v.i)-1 as combo, a.f as floor_, d.lo, d.hi, c.high, v.cap from (values (0,80.0),(1,60.0)) a(i,f), (values (0,0.0,1.0),(1,1.0,3.0)) d(i,lo,hi), (values (0,false),(1,true)) c(i,high), (values (0,0.8),(1,1.0),(2,1.2)) v(i,cap)),
 o as (select combo, case when session_ix>(select max(session_ix) from b)-5 then 'excluded_chronological_boundary' when instrument_id%10=7 then 'excluded_membership' when not rs>=floor_ then 'excluded_not_leader' when depth between lo and hi and (case when high then pch else pc end) and vr<=cap then 'signal' else 'eligible_leader_control' end as role from r, g)
 select cast(combo as int) as combo, role, count(*) as n from o group by 1,2""")
def _(t):
    hi, lo = F.max("close").over(W.rows(5, 1)), F.min("close").over(W.rows(5, 1))
    a = bars(t, grain="month").select(*ID, W.simple_return(20).alias("x"), (F.col("close") > W.lagged("close", 1)).alias("above_prior_close"), (F.col("close") > W.lagged("high", 1)).alias("above_prior_high"),
                                      F.when(W.contiguous(6), (hi - F.col("close")) / F.nullif(hi - lo, F.lit(0.0))).alias("depth"), (F.col("volume") / W.lagged("volume", 1)).alias("volume_ratio"))
    a = X.percentile_0_100(a.where("x is not null and depth is not null and volume_ratio is not null"), "x", out="rs")
    f = a.select("rs", "depth", "above_prior_close", "above_prior_high", "volume_ratio", (F.col("session_ix") <= session_range(t, "month")[1] - 5).alias("usable"), (F.col("instrument_id") % 10 != 7).alias("member"))
    return RS.cohorts(f).groupBy("combo", "role").agg(F.count(F.lit(1)).alias("n"))


@query("udf_05_parameter_grid", """with a(leadership_gate) as (values ('rs80'),('rs60')), d(depth_band) as (values ('shallow'),('deep')), c(recovery) as (values ('close'),('high')), v(volume_cap) as (values (0.8),(1.0),(1.2))
 select leadership_gate, depth_band, recovery, cast(volume_cap as double) as volume_cap, (select count(*) from supplier) as n_members from a, d, c, v""")
def _(t):
    from sessionloom.operators.aggregates import attach_one_row

    g = t.spark.createDataFrame([tuple(x.values()) for x in RS.parameter_grid()], "leadership_gate string, depth_band string, recovery string, volume_cap double")
    return attach_one_row(g, t.supplier.agg(F.count(F.lit(1)).alias("n_members")))


@query("job_65_price_limit_check", f"""with {B()}, {MASTER}, {RULES_SQL}, p as (select b.*, m.exchange from (select *, round({lag('close', 1)},2) as pc from b) b join m using (instrument_id)),
 j as (select p.instrument_id, p.session_ix, any_value(close) as close, any_value(pc) as pc, count(ru.ratio) as n, max(ru.ratio) as ratio from p left join ru on ru.exchange=p.exchange and ru.effective_from<=p.session_date and (ru.effective_to is null or ru.effective_to>=p.session_date) group by 1,2)
 select session_ix, case when n=0 then 'rule_missing' when n>1 then 'rule_ambiguous' when pc is null then 'no_pre_close' when close>round(pc::decimal(18,2)*(1+ratio::decimal(6,4)),2)::double then 'above_limit' when close<round(pc::decimal(18,2)*(1-ratio::decimal(6,4)),2)::double then 'below_limit' else 'inside' end as verdict, count(*) as n_bars from j group by 1,2""")
def _(t):
    b = bars(t).withColumn("pc", F.round(W.lagged("close", 1), 2)).join(master(t).select("instrument_id", "exchange"), "instrument_id")
    r = J.resolve_rule(b, rule_table(t.spark), "exchange", F.col("session_date"))
    r = r.select("*", *SC.price_limits(F.col("pc"), F.col("ratio")))
    c = F.col
    v = first_failing((c("rule_status") == "missing", "rule_missing"), (c("rule_status") == "ambiguous", "rule_ambiguous"), (c("pc").isNull(), "no_pre_close"), (c("close") > c("limit_up"), "above_limit"), (c("close") < c("limit_down"), "below_limit"), ok="inside")
    return r.groupBy("session_ix", v.alias("verdict")).agg(F.count(F.lit(1)).alias("n_bars"))


@query("job_70_document_markers", r"""with x as (select lang, source, len(regexp_extract_all(text,'[0-9]+')) as digits, len(regexp_extract_all(text,'\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b')) as iso_date, length(text) as n_chars from documents)
 select lang, source, count(*) as n_docs, cast(sum(digits) as bigint) as digits, cast(sum(iso_date) as bigint) as iso_date, count(*) filter (iso_date>0) as n_with_date, cast(sum(n_chars) as bigint) as n_chars from x group by 1,2""")
def _(t):
    d = t.documents.select("lang", "source", *SC.marker_counts(F.col("text")), F.length("text").cast("bigint").alias("n_chars"))
    return d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("digits").alias("digits"), F.sum("iso_date").alias("iso_date"), F.count_if(F.col("iso_date") > 0).alias("n_with_date"), F.sum("n_chars").alias("n_chars"))
