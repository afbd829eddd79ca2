"""TOP-* and SET-*: ordered reports, capped selections, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.catalog.core import R, query
from sessionloom.catalog.aggregates import URET, universe_returns
from sessionloom.catalog.filters import RISK_SQL, risk_input
from sessionloom.catalog.joins import ADJ_SQL, REPEAT_SQL, actions_repeat, adjustments
from sessionloom.catalog.sqltext import DIVIDENDS, MASTER, SPLITS, UNIVERSE, bars as B, ret
from sessionloom.functions.numeric import joined, rnd
from sessionloom.operators import sets as S
from sessionloom.operators import topk as K
from sessionloom.operators import windows as W
from sessionloom.operators.aggregates import multiset_fingerprint
from sessionloom.sources.fixtures import bars, dividends, master, session_range, splits, universe

ID = ["instrument_id", "session_ix"]
IDS = "instrument_id, session_ix"


def _returns(t):
    r = universe_returns(t).where("r1 is not null").withColumn("dv", F.col("close") * F.col("volume"))
    return r.join(master(t).select("instrument_id", "ticker"), "instrument_id")


_RET = f"{URET}, rt as (select ur.*, close*volume as dv, m.ticker from ur join m using (instrument_id) where r1 is not null)"


@query("top_01_movers", f"""with {_RET}, g as (select *, row_number() over (partition by universe, session_ix order by r1 desc, dv desc, ticker, instrument_id) as rank from rt where r1>0),
 l as (select *, row_number() over (partition by universe, session_ix order by r1, dv desc, ticker, instrument_id) as rank from rt where r1<0)
 select universe, session_ix, 'gainer' as side, rank, ticker, {R('r1')} as r1 from g where rank<=5 union all select universe, session_ix, 'loser', rank, ticker, {R('r1')} from l where rank<=5""")
def _(t):
    m = K.movers(_returns(t), ["universe", "session_ix"], 5)
    return m.select("universe", "session_ix", "side", F.col("rank").cast("bigint").alias("rank"), "ticker", rnd("r1").alias("r1"))


@query("top_02_activity_map", f"""with {_RET}, g as (select *, row_number() over (partition by universe, session_ix order by dv desc, ticker, instrument_id) as rank from rt)
 select universe, session_ix, rank, ticker, {R('dv', 8)} as dv, {R('r1')} as color from g where rank<=20""")
def _(t):
    m = K.top_n(_returns(t), ["universe", "session_ix"], [F.desc("dv"), F.col("ticker"), F.col("instrument_id")], 20)
    return m.select("universe", "session_ix", F.col("rank").cast("bigint").alias("rank"), "ticker", rnd("dv", 8).alias("dv"), rnd("r1").alias("color"))


@query("top_03_benchmark_order", f"""with {B(entity='region')}, r as (select {IDS}, {ret(5)} as r5 from b) select {IDS}, {R('r5')} as r5, row_number() over (partition by session_ix order by r5 desc nulls last, instrument_id) as position from r""")
def _(t):
    r = W.add_returns(bars(t, "region"), lags=(5,))
    k = r.withColumn("position", F.row_number().over(Window.partitionBy("session_ix").orderBy(F.desc_nulls_last("r5"), "instrument_id")))
    return k.select(*ID, rnd("r5").alias("r5"), F.col("position").cast("bigint").alias("position"))


CAP, SHARE = 10, 0.3
_SEL = f"""{RISK_SQL}, el as (select ri.*, exchange from ri join m using (instrument_id) where score is not null and not quarantined),
 gr as (select *, row_number() over (partition by session_ix, exchange order by score desc, instrument_id) as group_rank from el),
 sl as (select * from (select *, row_number() over (partition by session_ix order by score desc, instrument_id) as rank from gr where group_rank<=3) where rank<=10)"""


def eligible(t):
    return risk_input(t).where("score is not null and not quarantined").join(master(t).select("instrument_id", "exchange"), "instrument_id")


def _selected(df):
    return K.capped_selection(df, ["session_ix"], "exchange", [F.desc("score"), F.col("instrument_id")], CAP, SHARE)


@query("top_04_capped_selection", f"""with {_SEL}, la as (select session_ix, count(*) as taken, arg_max(score, rank) as ls, arg_max(instrument_id, rank) as li from sl group by 1)
 select el.instrument_id, el.session_ix, sl.rank, case when sl.rank is not null then 'selected' when taken=10 and (-el.score>-ls or (el.score=ls and el.instrument_id>li)) then 'display_cap_reached' else 'concentration_cap_reached' end as outcome
 from el left join la using (session_ix) left join sl on sl.instrument_id=el.instrument_id and sl.session_ix=el.session_ix""")
def _(t):
    df = eligible(t)
    out = K.with_rejections(df, _selected(df), ["session_ix"], [(-F.col("score")).alias("k1"), F.col("instrument_id").alias("k2")], ["instrument_id"], CAP)
    return out.select(*ID, F.col("rank").cast("bigint").alias("rank"), "outcome")


@query("top_05_entry_lanes", f"""with {RISK_SQL}, el as (select ri.*, exchange, case when confidence>=60 then 'review_now' when confidence>=30 then 'watch_trigger' else 'wait_reset' end as lane from ri join m using (instrument_id) where score is not null),
 g5 as (select *, row_number() over (partition by session_ix, lane, exchange order by score desc, instrument_id) as gr from el), s as (select *, row_number() over (partition by session_ix, lane order by score desc, instrument_id) as rank from g5 where gr<=2)
 select {IDS}, lane, rank from s where rank<=5""")
def _(t):
    df = risk_input(t).where("score is not null").join(master(t).select("instrument_id", "exchange"), "instrument_id").withColumn(
        "lane", F.when(F.col("confidence") >= 60, "review_now").when(F.col("confidence") >= 30, "watch_trigger").otherwise("wait_reset"))
    s = K.capped_selection(df, ["session_ix", "lane"], "exchange", [F.desc("score"), F.col("instrument_id")], 5, 0.4)
    return s.select(*ID, "lane", F.col("rank").cast("bigint").alias("rank"))


@query("top_06_channel_cap", f"""with {RISK_SQL}, x as (select *, case cast(instrument_id%3 as int) when 0 then 'trend' when 1 then 'pullback' else 'breakout' end as channel from ri where score is not null), r as (select *, row_number() over (partition by session_ix, channel order by score desc, instrument_id) as rank from x) select {IDS}, channel, rank from r where rank<=8""")
def _(t):
    ch = F.element_at(F.array(F.lit("trend"), F.lit("pullback"), F.lit("breakout")), (F.col("instrument_id") % 3 + 1).cast("int"))
    df = risk_input(t).where("score is not null").withColumn("channel", ch)
    return K.top_n(df, ["session_ix", "channel"], [F.desc("score"), F.col("instrument_id")], 8).select(*ID, "channel", F.col("rank").cast("bigint").alias("rank"))


@query("top_07_lexicographic_winner", f"""with {B(grain='month')}, r as (select session_ix, instrument_id%24 as combo, {ret(1)} as x from b), s as (select combo, min(x) as lower, avg(x) as mean, count(x) as n from r where x is not null group by 1)
 select combo, {R('lower')} as lower, {R('mean')} as mean, n from s order by round(lower,10) desc, round(mean,10) desc, n desc, combo limit 1""")
def _(t):
    r = W.add_returns(bars(t, grain="month"), lags=(1,)).where("r1 is not null").withColumn("combo", F.col("instrument_id") % 24)
    s = r.groupBy("combo").agg(F.min("r1").alias("lower"), F.avg("r1").alias("mean"), F.count(F.lit(1)).alias("n"))
    best = s.agg(F.max(F.struct(F.round("lower", 10), F.round("mean", 10), "n", (-F.col("combo")).alias("neg"), F.struct("combo", "lower", "mean", "n").alias("row"))).alias("b"))
    return best.select("b.row.*").select("combo", rnd("lower").alias("lower"), rnd("mean").alias("mean"), "n")


@query("top_09_supporting_evidence", f"""with {RISK_SQL}, c as (select {IDS}, [{{'v': coalesce(score,0), 'k': 'score'}}, {{'v': confidence, 'k': 'confidence'}}, {{'v': least(100, price/100), 'k': 'price'}}, {{'v': least(100, coalesce(median_dv,0)/10000), 'k': 'liquidity'}}] as a from ri),
 s as (select *, list_sort(list_transform(a, lambda x: {{'n': -x.v, 'k': x.k}})) as o from c) select {IDS}, array_to_string(list_transform(o[1:3], lambda x: x.k),'|') as supporting, array_to_string(list_transform(list_reverse(o)[1:2], lambda x: x.k),'|') as counter from s""")
def _(t):
    parts = {"score": F.coalesce("score", F.lit(0.0)), "confidence": F.col("confidence"), "price": F.least(F.lit(100.0), F.col("price") / 100),
             "liquidity": F.least(F.lit(100.0), F.coalesce("median_dv", F.lit(0.0)) / 10000)}
    o = F.array_sort(F.array(*[F.struct((-v).alias("n"), F.lit(k).alias("k")) for k, v in parts.items()]))
    names = lambda a: joined(F.transform(a, lambda x: x["k"]))
    return risk_input(t).withColumn("o", o).select(*ID, names(F.slice("o", 1, 3)).alias("supporting"), names(F.slice(F.reverse("o"), 1, 2)).alias("counter"))


@query("top_10_canonical_order", f"""with {B()} select {IDS}, row_number() over (partition by session_ix order by instrument_id) as position from b""")
def _(t):
    from sessionloom.functions.ranking import rank_table

    ranks = rank_table(bars(t), ["session_ix"], "instrument_id")
    return ranks.select(*ID, (F.col("n_lower") + 1).cast("bigint").alias("position"))


@query("set_01_union_unique", f"""with {B()}, {SPLITS}, {DIVIDENDS}, u as (select action_id, instrument_id, effective_ix as ix, 'split' as kind from sp union all select action_id, instrument_id, ex_ix, 'dividend' from dv)
 select kind, count(*) as n, (select count(*) from (select instrument_id from u group by instrument_id having count(*)>1)) as n_duplicate_keys from u group by 1""")
def _(t):
    from sessionloom.operators.aggregates import attach_one_row

    parts = [splits(t).select("action_id", "instrument_id", F.col("effective_ix").alias("ix"), F.lit("split").alias("kind")),
             dividends(t, bars(t)).select("action_id", "instrument_id", F.col("ex_ix").alias("ix"), F.lit("dividend").alias("kind"))]
    u, dup = S.union_unique(parts, ["instrument_id"])
    return attach_one_row(u.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), dup.agg(F.count(F.lit(1)).alias("n_duplicate_keys")))


@query("set_02_subset", f"with {UNIVERSE} select true as is_subset, true as is_strict_subset, 0::bigint as n_outside, (select count(*) from supplier)-(select count(*) from u) as n_extra")
def _(t):
    return S.subset_report(universe(t), universe(t, "all"), "instrument_id")


@query("set_03_symmetric_difference", f"""with {B()}, {MASTER}, a as (select distinct country, session_ix from b join m using (instrument_id)),
 c as (select country, unnest(range((select min(session_ix) from b), (select max(session_ix)+1 from b))) as session_ix from (select distinct country from m))
 select case when a.session_ix is null then 'library_only' else 'country_only' end as side, coalesce(a.country, c.country) as country, cast(coalesce(a.session_ix, c.session_ix) as int) as session_ix
 from a full join c on a.country=c.country and a.session_ix=c.session_ix where a.session_ix is null or c.session_ix is null""")
def _(t):
    first, last = session_range(t)
    homes = master(t).select("instrument_id", "country")
    a = bars(t).join(homes, "instrument_id").groupBy("country", "session_ix").agg(F.lit(1).alias("x")).drop("x")
    c = homes.select("country").distinct().withColumn("session_ix", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return c.exceptAll(a).withColumn("side", F.lit("library_only")).unionByName(a.exceptAll(c).withColumn("side", F.lit("country_only")))


@query("set_04_three_way_partition", f"""with {B()}, d as (select session_ix, count(*) as n from b group by 1), p as (select session_ix, case when n>=85 then 'completed' when n>=75 then 'missing' else 'corrupt' end as part from d union all select session_ix, 'missing' from d where session_ix%50=0 and n>=85)
 select session_ix, n_parts, case when part is not null then part end as part, session_ix<=350 as expected, session_ix<=350 and n_parts=1 as closes from (select session_ix, count(*) as n_parts, min(part) as part from p group by 1)""")
def _(t):
    d = bars(t).groupBy("session_ix").agg(F.count(F.lit(1)).alias("n"))
    parts = {"completed": d.where("n >= 85"), "missing": d.where("(n >= 75 and n < 85) or (n >= 85 and session_ix % 50 = 0)"), "corrupt": d.where("n < 75")}
    return S.partition_check(parts, d.where("session_ix <= 350"), "session_ix")


@query("set_05_comparable_ids", f"""with {B()} select c.session_ix, count(*) as n_comparable from b c where exists (select 1 from b p where p.instrument_id=c.instrument_id and p.session_ix=c.session_ix-1) group by 1""")
def _(t):
    b = bars(t).select(*ID)
    prev = b.select("instrument_id", (F.col("session_ix") + 1).alias("session_ix"))
    return b.intersect(prev).groupBy("session_ix").agg(F.count(F.lit(1)).alias("n_comparable"))


_FP = "count(*) as n_rows, cast(sum(cast(('0x'||substr(sha256({x}),1,15)) as bigint)) as varchar) as fingerprint"


@query("set_06_set_fingerprint", f"""with {B()}, s as (select distinct {IDS} from b) select session_ix, {_FP.format(x="cast(instrument_id as varchar)")} from s group by 1""")
def _(t):
    return bars(t).select(*ID).distinct().groupBy("session_ix").agg(*multiset_fingerprint(F.col("instrument_id").cast("string")))


@query("set_07_multiset_difference", f"""with {REPEAT_SQL}, l as (select instrument_id, effective_ix, split_from, split_to, count(*) as n from sp group by 1,2,3,4), r as (select instrument_id, effective_ix, split_from, split_to, count(*) as n from rp group by 1,2,3,4)
 select instrument_id, effective_ix, split_from, split_to, cast(sum(nl) as bigint) as n_left, cast(sum(nr) as bigint) as n_right from (select instrument_id, effective_ix, split_from, split_to, n as nl, 0 as nr from l union all select instrument_id, effective_ix, split_from, split_to, 0, n from r) group by 1,2,3,4 having sum(nl)<>sum(nr)""")
def _(t):
    return S.multiset_difference(splits(t), actions_repeat(t), ["instrument_id", "effective_ix", "split_from", "split_to"])
