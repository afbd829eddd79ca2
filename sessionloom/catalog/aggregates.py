"""AGG-*: grouped statistics over the derived panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.catalog.core import R, query
from sessionloom.catalog.filters import FACTS_SQL, LADDER_SQL, LOCAL_SQL, RISK_SQL, facts, ladder, local_states, registry, risk_input
from sessionloom.catalog.sqltext import FILINGS, I, MASTER, SPLITS, UNIVERSE, bars as B, lag, lr, ret
from sessionloom.functions.numeric import joined, rnd
from sessionloom.functions.ranking import median_mad, nearest_rank, quantiles
from sessionloom.operators import aggregates as A
from sessionloom.operators import crosssection as X
from sessionloom.operators import filters as P
from sessionloom.operators import windows as W
from sessionloom.sources.fixtures import bars, filings, master, splits, universe

ID = ["instrument_id", "session_ix"]
IDS = "instrument_id, session_ix"
S = ["session_ix"]


@query("agg_01_session_summary", f"""with {B()}, {MASTER} select session_ix, count(*) as n, count(*) filter (form='CS') as n_cs, count(*) filter (form='ADRC') as n_adrc, count(*) filter (trades=1) as n_single_trade,
 count(*) filter (high=low) as n_zero_range, cast(sum(volume) as double) as volume from b join m using (instrument_id) group by 1""")
def _(t):
    b = bars(t).join(master(t).select("instrument_id", "form"), "instrument_id")
    return b.groupBy("session_ix").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("form") == "CS").alias("n_cs"), F.count_if(F.col("form") == "ADRC").alias("n_adrc"),
                                       F.count_if(F.col("trades") == 1).alias("n_single_trade"), F.count_if(F.col("high") == F.col("low")).alias("n_zero_range"), F.sum("volume").alias("volume"))


def universe_returns(t):
    """Close-to-close returns per universe; each bar counts once per universe it belongs to."""
    m = master(t).select("instrument_id", F.explode(F.when(F.col("is_primary"), F.array(F.lit("primary"), F.lit("all"))).otherwise(F.array(F.lit("all")))).alias("universe"))
    return W.add_returns(bars(t), lags=(1,)).join(m, "instrument_id")


URET = f"""{B()}, {MASTER}, um as (select instrument_id, 'all' as universe from m union all select instrument_id, 'primary' from m where is_primary),
 ur as (select r.*, um.universe from (select *, {ret(1)} as r1 from b) r join um using (instrument_id))"""


@query("agg_02_market_summary", f"""with {URET} select universe, session_ix, count(*) as n, count(*) filter (r1>0) as advancers, count(*) filter (r1<0) as decliners, count(*) filter (r1=0) as unchanged,
 {R('count(*) filter (r1>0)/nullif(count(*) filter (r1<0),0)')} as ad_ratio, {R('sum(case when r1>0 then volume else 0 end)/nullif(sum(case when r1<0 then volume else 0 end),0)')} as volume_ratio,
 {R('avg(r1)')} as mean_return, {R('median(r1)')} as median_return, {R('count(*) filter (r1>0)/count(*)')} as advancer_share from ur where r1 is not null group by 1,2""")
def _(t):
    s = A.market_summary(universe_returns(t), ["universe", "session_ix"])
    keep = ["universe", "session_ix", "n", "advancers", "decliners", "unchanged"]
    return s.select(*keep, *[rnd(c).alias(c) for c in ("ad_ratio", "volume_ratio", "mean_return", "median_return", "advancer_share")])


@query("agg_03_duplicate_analysis", """with g as (select l_orderkey, l_linenumber, count(*) as n_rows, count(distinct (l_partkey, l_suppkey, l_quantity, l_extendedprice)) as d from lineitem group by 1,2)
 select case when d>1 then 'conflicting' when n_rows>1 then 'exact_duplicate' else 'unique' end as status, count(*) as n_keys, cast(sum(n_rows) as bigint) as n_rows from g group by 1""")
def _(t):
    d = A.dedupe(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return d.groupBy("status").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_rows").alias("n_rows"))


@query("agg_04_latest_revision", f"""with {B()}, r as (select {IDS}, 1 as rev, (instrument_id+session_ix)%9<>0 as is_latest from b union all select {IDS}, 2, true from b where (instrument_id+session_ix)%6=0)
 select n_latest, n_revisions, count(*) as n from (select {IDS}, count(*) filter (is_latest) as n_latest, count(*) as n_revisions from r group by 1,2) group by 1,2""")
def _(t):
    b = bars(t).select(*ID)
    k = F.col("instrument_id") + F.col("session_ix")
    r = b.withColumn("is_latest", k % 9 != 0).unionByName(b.where(k % 6 == 0).withColumn("is_latest", F.lit(True)))
    return r.groupBy(*ID).agg(F.count_if("is_latest").alias("n_latest"), F.count(F.lit(1)).alias("n_revisions")).groupBy("n_latest", "n_revisions").agg(F.count(F.lit(1)).alias("n"))


@query("agg_05_identifier_collision", """with r as (select s_name as ticker, case when s_suppkey%13=0 then s_suppkey+1 else s_suppkey end as stable_id from supplier union all select upper(s_name), s_suppkey from supplier where s_suppkey%17=0)
 select stable_id, count(distinct ticker) as n_tickers from r group by 1""")
def _(t):
    return A.claims(_refs(t), "ticker", "stable_id", "n_tickers")


def _refs(t):
    k = F.col("s_suppkey")
    return t.supplier.select(F.col("s_name").alias("ticker"), F.when(k % 13 == 0, k + 1).otherwise(k).alias("stable_id")).unionAll(
        t.supplier.where(k % 17 == 0).select(F.upper("s_name"), k))


@query("agg_06_ticker_ambiguity", """with r as (select s_name as ticker, case when s_suppkey%13=0 then s_suppkey+1 else s_suppkey end as stable_id from supplier union all select upper(s_name), s_suppkey from supplier where s_suppkey%17=0)
 select upper(ticker) as ticker, count(distinct stable_id) as n_ids, max(n_exact) as n_case_forms from (select *, count(distinct ticker) over (partition by upper(ticker)) as n_exact from r) group by 1""")
def _(t):
    r = _refs(t).withColumn("folded", F.upper("ticker"))
    ids = A.claims(r, "stable_id", "folded", "n_ids")
    forms = A.claims(r, "ticker", "folded", "n_case_forms")
    return ids.join(forms, "folded").withColumnRenamed("folded", "ticker")


@query("agg_07_coverage_gate", f"""with {B()}, {UNIVERSE}, r as (select session_ix, {ret(1)} as r1 from b where instrument_id in (select instrument_id from u)),
 g as (select session_ix, count(r1) as actual, (select count(*) from u) as total, avg(case when r1>0 then 1.0 when r1 is not null then 0.0 end) as v from r group by 1)
 select session_ix, actual, {R("case when actual/total>=0.66 and actual>=20 then v end")} as advancer_share, case when actual/total<0.66 then 'insufficient_coverage' when actual<20 then 'insufficient_observations' when v is null then 'zero_denominator' end as reason from g""")
def _(t):
    u = universe(t)
    r = W.add_returns(P.members(bars(t), u), lags=(1,))
    g = r.groupBy("session_ix").agg(F.count("r1").alias("actual"), F.avg((F.col("r1") > 0).cast("double")).alias("v"))
    g = A.attach_one_row(g, u.agg(F.count(F.lit(1)).alias("total")))
    value, reason = A.coverage_gate(F.col("v"), F.col("actual"), F.col("total"), 0.66, 20)
    return g.select("session_ix", "actual", rnd(value).alias("advancer_share"), reason.alias("reason"))


@query("agg_08_even_median", f"""with {B(grain='month')} select {IDS}, {R(f"case when count(*) over w=20 then median(close*volume) over w end", 5)} as median_dv
 from b window w as (partition by instrument_id order by session_ix range between 19 preceding and current row)""")
def _(t):
    dv = F.col("close") * F.col("volume")
    h = W.sessions(20)
    return bars(t, grain="month").select(*ID, rnd(F.when(F.count(F.lit(1)).over(h) == 20, W.sorted_middle(F.collect_list(dv).over(h))), 5).alias("median_dv"))


@query("agg_09_median_mad", f"""with {B()}, r as (select session_ix, {ret(1)} as x from b), m as (select session_ix, median(x) as med, count(x) as n from r where x is not null group by 1)
 select session_ix, any_value(m.n) as n, {R('any_value(med)')} as med, {R('median(abs(x-med))')} as mad from r join m using (session_ix) where x is not null group by 1""")
def _(t):
    m = median_mad(W.add_returns(bars(t), lags=(1,)), S, "r1")
    return m.select("session_ix", F.col("n_group").alias("n"), rnd("med").alias("med"), rnd("mad").alias("mad"))


@query("agg_10_linear_quantiles", f"""with {B()}, r as (select session_ix, {ret(1)} as x from b) select session_ix, {R('quantile_cont(x,0.05)')} as q05, {R('quantile_cont(x,0.25)')} as q25, {R('quantile_cont(x,0.95)')} as q95 from r where x is not null group by 1""")
def _(t):
    q = quantiles(W.add_returns(bars(t), lags=(1,)), S, "r1", {"q05": 0.05, "q25": 0.25, "q95": 0.95})
    return q.select("session_ix", *[rnd(c).alias(c) for c in ("q05", "q25", "q95")])


@query("agg_11_nearest_rank", f"""with {B()}, r as (select session_ix, volume as x, row_number() over (partition by session_ix order by volume) as rn, count(*) over (partition by session_ix) as n from b)
 select session_ix, max(case when rn=greatest(1, ceil(n*0.1)) then x end) as q10, max(case when rn=ceil(n*0.5) then x end) as q50, max(case when rn=ceil(n*0.9) then x end) as q90 from r group by 1""")
def _(t):
    return nearest_rank(bars(t), S, "volume", {"q10": 0.1, "q50": 0.5, "q90": 0.9}).drop("n_group")


@query("agg_12_split_product", f"with {SPLITS} select instrument_id, {R('product(split_from)/product(split_to)')} as factor, count(*) as n_actions from sp group by 1")
def _(t):
    return A.split_product(splits(t), ["instrument_id"]).select("instrument_id", rnd("factor").alias("factor"), "n_actions")


@query("agg_13_conditional_shares", f"""with {B()}, r as (select *, {ret(1)} as r1 from b) select session_ix, {R('sum(case when r1>0 then volume else 0 end)/sum(volume)')} as up_share, {R('avg(case when r1<=-0.04 then 1.0 else 0.0 end)')} as tail_share from r where r1 is not null group by 1""")
def _(t):
    r = W.add_returns(bars(t), lags=(1,)).where("r1 is not null")
    return r.groupBy("session_ix").agg(rnd(F.sum(F.when(F.col("r1") > 0, F.col("volume")).otherwise(0.0)) / F.sum("volume")).alias("up_share"), rnd(F.avg((F.col("r1") <= -0.04).cast("double"))).alias("tail_share"))


@query("agg_14_participation_reference", f"""with {B()}, d as (select session_ix, cast(sum(volume) as double) as v, count(*) as n from b group by 1)
 select session_ix, v as total, {R('case when count(*) over w>=18 then v/median(v) over w end')} as participation from d window w as (order by session_ix range between 20 preceding and 1 preceding)""")
def _(t):
    d = bars(t).groupBy("session_ix").agg(F.sum("volume").alias("v"))
    by = Window.orderBy("session_ix").rangeBetween(-20, -1)
    ref = F.when(F.count("v").over(by) >= 18, W.sorted_middle(F.collect_list("v").over(by)))
    return d.select("session_ix", F.col("v").alias("total"), rnd(F.col("v") / ref).alias("participation"))


@query("agg_15_top_decile_share", f"""with {B()}, r as (select {IDS}, {ret(1)} as x from b), p as (select *, row_number() over (partition by session_ix order by x desc, instrument_id) as rn, count(*) over (partition by session_ix) as n from r where x>0)
 select session_ix, any_value(n) as n_positive, {R('case when any_value(n)>=20 then sum(case when rn<=ceil(n/10.0) then x end)/sum(x) end')} as concentration from p group by 1""")
def _(t):
    c = A.top_decile_share(W.add_returns(bars(t), lags=(1,)), S, "r1", 20)
    return c.select("session_ix", "n_positive", rnd("concentration").alias("concentration"))


@query("agg_16_paired_correlation", f"""with {B('b0')}, {B('mk', 'market')}, b as (select b0.*, mk.close as mc from b0 join mk using (session_ix)), r as (select {IDS}, {lr()} as x, ln(mc/{lag('mc', 1)}) as y from b)
 select instrument_id, count(*) filter (x is not null and y is not null) as n_pairs, {R('case when count(*) filter (x is not null and y is not null)>=18 then corr(x,y) end')} as corr from r group by 1""")
def _(t):
    b = W.versus_benchmark(bars(t), bars(t, "market"))
    b = W.add_log_return(b).withColumn("y", F.log(F.col("b_close") / W.lagged("b_close", 1)))
    n, c = A.pearson("lr", "y", 18)
    return b.groupBy("instrument_id").agg(n, rnd(c).alias("corr"))


def ic_panel(t):
    """Monthly panel: factor = 5-session reversal, target = next return, control = 20-session return."""
    b = bars(t, grain="month")
    fwd = F.when(F.lead("session_ix").over(W.BY) - F.col("session_ix") == 1, F.lead("close").over(W.BY) / F.col("close") - 1)
    return b.select(*ID, (-W.simple_return(5)).alias("factor"), fwd.alias("target"), W.simple_return(20).alias("control"))


_RK = "rank() over (partition by session_ix order by {c}) + (count(*) over (partition by session_ix, {c})-1)/2.0"
IC_SQL = f"""{B(grain='month')}, ip as (select {IDS}, -({ret(5)}) as factor, case when lead(session_ix) {I}-session_ix=1 then lead(close) {I}/close-1 end as target, {ret(20)} as control from b)"""


@query("agg_17_spearman", f"""with {IC_SQL}, r as (select session_ix, {_RK.format(c='factor')} as x, {_RK.format(c='target')} as y from ip where factor is not null and target is not null)
 select session_ix, count(*) as n_obs, {R('corr(x,y)')} as ic from r group by 1""")
def _(t):
    return A.rank_ic(ic_panel(t), S, "factor", "target").select("session_ix", "n_obs", rnd("ic").alias("ic"))


@query("agg_18_partial_spearman", f"""with {IC_SQL}, r as (select session_ix, {_RK.format(c='factor')} as x, {_RK.format(c='target')} as y, {_RK.format(c='control')} as z from ip where factor is not null and target is not null and control is not null),
 g as (select session_ix, count(*) as n_obs, corr(x,y) as xy, corr(x,z) as xz, corr(y,z) as yz from r group by 1)
 select session_ix, n_obs, {R('xy')} as ic, {R('case when (1-xz*xz)*(1-yz*yz)>1e-12 then (xy-xz*yz)/sqrt((1-xz*xz)*(1-yz*yz)) end')} as partial_ic from g""")
def _(t):
    p = A.partial_rank_ic(ic_panel(t), S, "factor", "target", "control")
    return p.select("session_ix", "n_obs", rnd("ic").alias("ic"), rnd("partial_ic").alias("partial_ic"))


@query("agg_19_ols", f"""with {B('b0')}, {B('mk', 'market')}, b as (select b0.*, mk.close as mc from b0 join mk using (session_ix)), r as (select {IDS}, {lr()} as y, ln(mc/{lag('mc', 1)}) as x from b), k as (select * from r where x is not null and y is not null),
 g as (select instrument_id, count(*) as n, regr_slope(y,x) as slope, regr_intercept(y,x) as intercept, regr_sxx(y,x) as sxx, regr_syy(y,x) as syy, regr_sxy(y,x) as sxy from k group by 1)
 select instrument_id, n, {R('slope')} as slope, {R('intercept')} as intercept, {R('sqrt(252*(syy-sxy*sxy/sxx)/(n-2))')} as residual_volatility from g""")
def _(t):
    b = W.add_log_return(W.versus_benchmark(bars(t), bars(t, "market"))).withColumn("x", F.log(F.col("b_close") / W.lagged("b_close", 1)))
    g = b.where("x is not null and lr is not null").groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("lr", "x").alias("slope"), F.regr_intercept("lr", "x").alias("intercept"),
        F.regr_sxx("lr", "x").alias("sxx"), F.regr_syy("lr", "x").alias("syy"), F.regr_sxy("lr", "x").alias("sxy"))
    res = F.sqrt(252.0 * (F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2))
    return g.select("instrument_id", "n", rnd("slope").alias("slope"), rnd("intercept").alias("intercept"), rnd(res).alias("residual_volatility"))


@query("agg_20_quality_gates", f"""with {B()}, g as (select session_ix, count(*) as n, count(*) filter (trades=1)/count(*) as single, count(*) filter (high=low) as flat, count(distinct instrument_id) as ids from b group by 1)
 select session_ix, array_to_string(list_filter([case when n<=75 then 'canonical_bar_count_below_gate' end, case when flat<>0 then 'flat_range_count_nonzero' end, case when ids<>n then 'identity_count_reconciliation_failed' end, case when single>0.3 then 'single_trade_ratio_above_gate' end], lambda x: x is not null),'|') as failures from g""")
def _(t):
    g = bars(t).groupBy("session_ix").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("trades") == 1) / F.count(F.lit(1))).alias("single"), F.count_if(F.col("high") == F.col("low")).alias("flat"), F.countDistinct("instrument_id").alias("ids"))
    from sessionloom.functions.numeric import reasons

    c = F.col
    return g.select("session_ix", joined(reasons((c("n") <= 75, "canonical_bar_count_below_gate"), (c("single") > 0.3, "single_trade_ratio_above_gate"), (c("flat") != 0, "flat_range_count_nonzero"),
                                                 (c("ids") != c("n"), "identity_count_reconciliation_failed"))).alias("failures"))


@query("agg_21_reason_distribution", f"""with {LADDER_SQL} select policy, disposition as reason, count(*) as n from ld group by 1,2""")
def _(t):
    df = ladder(t).select("policy", F.explode(F.array("disposition")).alias("reason"))
    return df.groupBy("policy", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("agg_22_distribution_report", f"""with {B()}, r as (select (session_ix-1)//52 as yr, {ret(1)} as x from b), c as (select * from r where x is not null),
 q as (select yr, quantile_cont(x,[0.01,0.05,0.25,0.5,0.75,0.95,0.99]) as q from c group by 1)
 select cast(yr as bigint) as yr, {R('any_value(q[1])')} as p01, {R('any_value(q[2])')} as p05, {R('any_value(q[3])')} as p25, {R('any_value(q[4])')} as p50, {R('any_value(q[5])')} as p75, {R('any_value(q[6])')} as p95, {R('any_value(q[7])')} as p99,
  {R('min(x)')} as lowest, {R('max(x)')} as highest, count(*) as n, count(distinct x) as n_distinct, count(*)-count(distinct x) as tie_excess, {R('avg(case when x<q[3]-3*(q[5]-q[3]) or x>q[5]+3*(q[5]-q[3]) then 1.0 else 0.0 end)')} as outlier_rate from c join q using (yr) group by 1""")
def _(t):
    r = W.add_returns(bars(t), lags=(1,)).withColumn("yr", F.floor((F.col("session_ix") - 1) / 52))
    d = A.distribution_report(r, ["yr"], "r1")
    num = ["p01", "p05", "p25", "p50", "p75", "p95", "p99", "lowest", "highest", "outlier_rate"]
    return d.select("yr", "n", "n_distinct", "tie_excess", *[rnd(c).alias(c) for c in num])


@query("agg_23_concentration", f"""with p as (select l_returnflag as flag, l_suppkey as k, count(*) as n from lineitem group by 1,2), g as (select *, row_number() over (partition by flag order by n desc, k) as rn, sum(n) over (partition by flag) as tot from p)
 select flag, count(*) as n_parts, {R('max(n)/any_value(tot)')} as max_share, {R('sum(case when rn<=10 then n end)/any_value(tot)')} as top_share, {R('sum(n*n)/any_value(tot)/any_value(tot)', 8)} as herfindahl from g group by 1""")
def _(t):
    c = A.concentration(t.lineitem.select(F.col("l_returnflag").alias("flag"), "l_suppkey"), ["flag"], "l_suppkey")
    return c.select("flag", "n_parts", rnd("max_share").alias("max_share"), rnd("top_share").alias("top_share"), rnd("herfindahl", 8).alias("herfindahl"))


FACTORS = ["f_ret5", "f_ret20", "f_range", "f_volume"]


def factor_panel(t, *prices: str):
    b = bars(t, grain="month")
    return b.select(*ID, W.simple_return(5).alias("f_ret5"), W.simple_return(20).alias("f_ret20"), (F.col("high") / F.col("low")).alias("f_range"), F.col("volume").alias("f_volume"), *prices)


FACTOR_SQL = f"{B(grain='month')}, fp as (select {IDS}, {ret(5)} as f_ret5, {ret(20)} as f_ret20, high/low as f_range, volume as f_volume from b)"


def _pair_sql(a, b):
    return f"""select '{a}/{b}' as pair_id, session_ix, count(*) as n, corr(x,y) as rho from (select session_ix, {_RK.format(c=a)} as x, {_RK.format(c=b)} as y from fp where {a} is not null and {b} is not null) group by 2"""


_PAIRS = [(a, b) for i, a in enumerate(FACTORS) for b in FACTORS[i + 1:]]


@query("agg_24_pairwise_spearman", f"""with {FACTOR_SQL}, p as ({' union all '.join(_pair_sql(a, b) for a, b in _PAIRS)})
 select pair_id, count(*) as n_sessions, {R('avg(rho)')} as mean_rho, abs(avg(rho))>=0.85 as near_duplicate from p where n>=30 group by 1""")
def _(t):
    from sessionloom.plans.research import pairwise_spearman

    p = pairwise_spearman(factor_panel(t), FACTORS, 30, 0.85)
    return p.select("pair_id", "n_sessions", rnd("mean_rho").alias("mean_rho"), "near_duplicate")


@query("agg_27_rank_buckets", f"""with {IC_SQL}, k as (select * from ip where factor is not null and target is not null), r as (select *, least(4, floor(({_RK.format(c='factor')}-1)*5/count(*) over (partition by session_ix))) as bucket from k)
 select session_ix, cast(bucket as int) as bucket, count(*) as n, {R('avg(target)')} as mean_target from r group by 1,2""")
def _(t):
    df = X.rank_buckets(ic_panel(t).where("target is not null"), "factor")
    return df.groupBy("session_ix", "bucket").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("target")).alias("mean_target"))


@query("agg_28_session_contrast", f"""with {IC_SQL}, r as (select session_ix, case when factor>0 then 'signal' else 'control' end as role, target from ip where factor is not null and target is not null),
 g as (select session_ix, avg(case when role='signal' then target end) as s, avg(case when role='control' then target end) as c from r group by 1) select session_ix, {R('s-c')} as contrast from g where s is not null and c is not null""")
def _(t):
    r = ic_panel(t).where("factor is not null and target is not null").withColumn("role", F.when(F.col("factor") > 0, "signal").otherwise("control"))
    g = r.groupBy("session_ix").pivot("role", ["signal", "control"]).agg(F.avg("target"))
    return g.where("signal is not null and control is not null").select("session_ix", rnd(F.col("signal") - F.col("control")).alias("contrast"))


COSTS = [0, 10, 25]


@query("agg_29_return_statistics", f"""with {IC_SQL}, r as (select cost, target - cost/10000.0 as x from ip, (values (0),(10),(25)) v(cost) where target is not null)
 select cost, count(*) as n, {R('avg(case when x>0 then 1.0 else 0.0 end)')} as win_rate, {R('avg(case when x>0 then x end)')} as average_win, {R('avg(case when x<0 then x end)')} as average_loss,
  {R('avg(case when x>0 then x end)/abs(avg(case when x<0 then x end))')} as payoff, {R('sum(case when x>0 then x end)/abs(sum(case when x<0 then x end))')} as profit_factor from r group by 1""")
def _(t):
    from sessionloom.plans.research import return_statistics

    s = return_statistics(ic_panel(t).where("target is not null"), "target", COSTS, [])
    return s.select("cost", "n", *[rnd(c).alias(c) for c in ("win_rate", "average_win", "average_loss", "payoff", "profit_factor")])


@query("agg_30_stability_slices", f"""with {IC_SQL}, d as (select distinct session_ix from ip), h as (select session_ix, case when row_number() over (order by session_ix)<=count(*) over ()//2 then 'first' else 'second' end as half from d),
 r as (select half, session_ix%3 as state, target from ip join h using (session_ix) where target is not null)
 select coalesce(half,'all') as half, coalesce(cast(state as varchar),'all') as state, count(*) as n, {R('avg(target)')} as mean_target from r group by grouping sets ((), (half), (state))""")
def _(t):
    p = ic_panel(t)
    r = p.join(A.chronological_halves(p), "session_ix").where("target is not null").withColumn("state", (F.col("session_ix") % 3).cast("string"))
    g = r.groupingSets([[], ["half"], ["state"]], "half", "state").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("target")).alias("mean_target"))
    return g.select(F.coalesce("half", F.lit("all")).alias("half"), F.coalesce("state", F.lit("all")).alias("state"), "n", "mean_target")


@query("agg_31_largest_contribution", f"with {IC_SQL} select session_ix, {R('max(abs(target))/sum(abs(target))')} as top_share from ip where target is not null group by 1")
def _(t):
    return A.top_share(ic_panel(t).where("target is not null"), S, "target", []).select("session_ix", rnd("top_share").alias("top_share"))


@query("agg_32_two_level_availability", f"""with {FILINGS}, x as (select cik, concept, period_end, accession//3 as acc, date_trunc('month', available_at) as av, round(value/50000) as v from f),
 a as (select cik, concept, period_end, acc, count(*) as n, count(distinct v) as nv, count(distinct av) as na, max(av) as av, max(v) as v from x group by 1,2,3,4),
 tm as (select cik, concept, period_end, av, count(distinct v) as nv from a where nv=1 and na=1 group by 1,2,3,4),
 p as (select cik, concept, period_end, count(*) filter (nv>1 or na>1) as w, count(*) filter (nv=1 and na=1 and n>1) as dup from a group by 1,2,3), q as (select cik, concept, period_end, count(*) filter (nv>1) as s from tm group by 1,2,3)
 select concept, count(*) as n_periods, cast(sum(w) as bigint) as within_accession_conflicts, cast(sum(dup) as bigint) as exact_duplicate_groups, cast(coalesce(sum(s),0) as bigint) as same_time_conflicts, count(*) filter (w=0 and coalesce(s,0)=0) as clean_periods from p left join q using (cik, concept, period_end) group by 1""")
def _(t):
    from sessionloom.plans.filings import availability_conflicts

    f = filings(t).select("cik", "concept", "period_end", F.floor(F.col("accession") / 3).alias("accession"), F.date_trunc("month", "available_at").alias("available_at"), F.round(F.col("value") / 50000).alias("value"))
    return availability_conflicts(f, ["cik", "concept", "period_end"]).groupBy("concept").agg(
        F.count(F.lit(1)).alias("n_periods"), F.sum("within_accession_conflicts").alias("within_accession_conflicts"), F.sum("exact_duplicate_groups").alias("exact_duplicate_groups"),
        F.sum("same_time_conflicts").alias("same_time_conflicts"), F.count_if("clean").alias("clean_periods"))


@query("agg_33_set_overlap", f"""with {B()}, i as (select instrument_id, bool_or(volume>200) as a, bool_or(trades>=6) as c from b group by 1) select count(*) filter (a and c) as n_both, count(*) filter (a or c) as n_union, count(*) filter (a and not c) as a_only, count(*) filter (c and not a) as c_only,
 {R('count(*) filter (a and c)/nullif(count(*) filter (a or c),0)')} as jaccard, count(*) filter (a and not c)=0 as a_subset from i""")
def _(t):
    i = bars(t).groupBy("instrument_id").agg(F.bool_or(F.col("volume") > 200).alias("a"), F.bool_or(F.col("trades") >= 6).alias("c"))
    a, c = F.col("a"), F.col("c")
    return i.agg(F.count_if(a & c).alias("n_both"), F.count_if(a | c).alias("n_union"), F.count_if(a & ~c).alias("a_only"), F.count_if(c & ~a).alias("c_only"),
                 rnd(A.ratio(F.count_if(a & c), F.count_if(a | c))).alias("jaccard"), (F.count_if(a & ~c) == 0).alias("a_subset"))


@query("agg_34_partition_merge", f"with {LOCAL_SQL} select board, trading_status, count(*) as n, count(*) filter (has_bar) as n_bars, min(session_ix) as first_ix, max(session_ix) as last_ix from ls group by 1,2")
def _(t):
    return local_states(t).groupBy("board", "trading_status").agg(F.count(F.lit(1)).alias("n"), F.count_if("has_bar").alias("n_bars"), F.min("session_ix").alias("first_ix"), F.max("session_ix").alias("last_ix"))


STAGES = ["provider_security_evidence", "target_security_form", "supported_exchange", "comparable_bars", "input_quality", "outlier_quarantine", "previous_close", "history_completeness", "trailing_liquidity", "final_membership"]
_STAGE_CASE = """case disposition when 'provider_evidence_missing' then 0 when 'target_security_form' then 1 when 'unsupported_exchange' then 2 when 'missing_current_bar' then 3 when 'missing_previous_bar' then 3 when 'exchange_conflict' then 4
 when 'material_quality_flag' then 4 when 'outlier_quarantine' then 5 when 'below_previous_close' then 6 when 'insufficient_history' then 7 when 'below_trailing_liquidity' then 8 else 9 end"""


@query("agg_35_universe_funnel", f"""with {LADDER_SQL}, s as (select policy, {_STAGE_CASE} as k from ld), g as (select policy, unnest(range(0,10)) as k from (select distinct policy from s))
 select g.policy, cast(g.k as int) as stage_order, count(*) filter (s.k>=g.k) as n_input, count(*) filter (s.k=g.k and g.k<9) as n_excluded, count(*) filter (s.k>g.k or g.k=9 and s.k=9) as n_remaining from g join s on s.policy=g.policy group by 1,2""")
def _(t):
    from sessionloom.plans.membership import funnel

    return funnel(ladder(t), STAGES, ["policy"]).select("policy", "stage_order", "n_input", "n_excluded", "n_remaining")


@query("agg_36_calendar_coverage", f"""with {B()}, fm as (select 'bars' as family, session_ix from b union all select 'actions', effective_ix from ({'with ' + SPLITS + ' select * from sp'}) union all select 'filings', cast(floor(date_diff('day', date '1995-01-02', cast(o_orderdate as date))/7.0)+1 as int) from orders)
 select family, count(distinct session_ix) filter (session_ix between (select min(session_ix) from b) and (select max(session_ix) from b)) as covered, (select max(session_ix)-min(session_ix)+1 from b)-count(distinct session_ix) filter (session_ix between (select min(session_ix) from b) and (select max(session_ix) from b)) as missing, min(session_ix) as first_ix, max(session_ix) as last_ix,
  case when count(distinct session_ix) filter (session_ix between (select min(session_ix) from b) and (select max(session_ix) from b))=(select max(session_ix)-min(session_ix)+1 from b) then 'complete' else 'partial' end as status from fm group by 1""")
def _(t):
    from sessionloom.sources.fixtures import session_index, session_range

    first, last = session_range(t)
    n = last - first + 1

    fil = t.orders.select(F.lit("filings").alias("family"), session_index(F.to_date(F.date_trunc("week", "o_orderdate")), "week").alias("session_ix"))
    fam = bars(t).select(F.lit("bars").alias("family"), "session_ix").unionByName(splits(t).select(F.lit("actions").alias("family"), F.col("effective_ix").alias("session_ix"))).unionByName(fil)
    days = fam.groupBy("family", "session_ix").agg(F.lit(1).alias("x"))
    ok = F.col("session_ix").between(first, last)
    return days.groupBy("family").agg(F.count_if(ok).alias("covered"), (n - F.count_if(ok)).alias("missing"), F.min("session_ix").alias("first_ix"), F.max("session_ix").alias("last_ix"),
                                      F.when(F.count_if(ok) == n, "complete").otherwise("partial").alias("status"))


@query("agg_37_evidence_budget", f"""with {LOCAL_SQL}, x as (select instrument_id, bool_or(not listed_complete) as a, bool_or(warning_status='unknown') as w, bool_or(trading_status='unknown') as s, bool_or(board='unknown') as d from ls group by 1),
 e as (select instrument_id, unnest(list_filter([case when a then 'listing' end, case when w then 'warning' end, case when s then 'status' end, case when d then 'board' end], lambda x: x is not null)) as family from x) select family, count(*) as n_securities from e group by 1""")
def _(t):
    c = F.col
    x = local_states(t).groupBy("instrument_id").agg(F.bool_or(~c("listed_complete")).alias("a"), F.bool_or(c("warning_status") == "unknown").alias("w"), F.bool_or(c("trading_status") == "unknown").alias("s"), F.bool_or(c("board") == "unknown").alias("d"))
    fam = F.array_compact(F.array(F.when(c("a"), "listing"), F.when(c("w"), "warning"), F.when(c("s"), "status"), F.when(c("d"), "board")))
    return x.select(F.explode(fam).alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n_securities"))


@query("agg_38_holm", f"""with p as (select s_nationkey as trial, {R('0.001+avg(abs(s_acctbal))/200000', 5)} as p from supplier group by 1), r as (select *, row_number() over (order by p, trial) as rn, count(*) over () as m from p)
 select cast(trial as bigint) as trial, p, {R('max(least(1.0, p*(m-rn+1))) over (order by rn)')} as p_holm from r""")
def _(t):
    p = t.supplier.groupBy(F.col("s_nationkey").cast("bigint").alias("trial")).agg(rnd(0.001 + F.avg(F.abs("s_acctbal")) / 200000, 5).alias("p"))
    return A.holm(p, "p", "trial").select("trial", "p", rnd("p_holm").alias("p_holm"))


@query("agg_39_multi_universe", f"""with {URET} select universe, count(*) as n, {R('avg(r1)')} as mean_return, count(distinct session_ix) as n_sessions from ur where r1 is not null group by 1""")
def _(t):
    return universe_returns(t).where("r1 is not null").groupBy("universe").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("r1")).alias("mean_return"), F.countDistinct("session_ix").alias("n_sessions"))


@query("agg_40_availability_rate", f"""with {FACTOR_SQL}, u as (unpivot fp on f_ret5, f_ret20, f_range, f_volume into name factor_id value value), n as (select count(*) as n, count(*) filter (f_ret5 is not null and f_ret20 is not null and f_range is not null and f_volume is not null) as whole from fp)
 select factor_id, count(*) as n_available, {R('count(*)/any_value(n.n)')} as rate, any_value(whole) as n_complete from u, n group by 1""")
def _(t):
    p = factor_panel(t)
    whole = F.count_if(~F.greatest(*[F.col(f).isNull() for f in FACTORS]))
    one = p.agg(F.count(F.lit(1)).alias("n"), whole.alias("n_complete"))
    g = A.unpivot(p, ID, FACTORS).groupBy("factor_id").agg(F.count("value").alias("n_available"))
    g = A.attach_one_row(g, one)
    return g.select("factor_id", "n_available", rnd(F.col("n_available") / F.col("n")).alias("rate"), "n_complete")


@query("agg_41_zero_filled_counts", f"""with {LADDER_SQL}, e(d) as (values {','.join(f"('{x}')" for x in P.MEMBERSHIP_STAGES)}) select d as disposition, count(ld.disposition) as n from e left join ld on ld.disposition=e.d group by 1""")
def _(t):
    names = t.spark.createDataFrame([(x,) for x in P.MEMBERSHIP_STAGES], "disposition string")
    g = ladder(t).groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))
    return names.join(g, "disposition", "left").select("disposition", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_42_membership_analytics", f"""with {LADDER_SQL}, r as (select * from (select session_ix, instrument_id, {ret(1)} as r1, volume from b)), k as (select ld.session_ix, r.r1, r.volume from ld join r on r.instrument_id=ld.instrument_id and r.session_ix=ld.session_ix where policy='B' and disposition='included')
 select session_ix, count(*) as n, {R('avg(r1)')} as equal_weight, {R('median(r1)')} as median_return, {R('sum(case when r1>0 then volume else 0 end)/nullif(sum(case when r1<0 then volume else 0 end),0)')} as up_down, count(*) filter (r1 is not null) as map_eligible from k group by 1""")
def _(t):
    r = W.add_returns(bars(t), lags=(1,)).select(*ID, "r1", "volume")
    k = ladder(t).where("policy = 'B' and disposition = 'included'").select(*ID).join(r, ID)
    s = A.market_summary(k, S)
    g = k.groupBy("session_ix").agg(F.count(F.lit(1)).alias("n0"), F.count("r1").alias("map_eligible"))
    return g.join(s, "session_ix", "left").select("session_ix", F.col("n0").alias("n"), rnd("mean_return").alias("equal_weight"), rnd("median_return").alias("median_return"), rnd("volume_ratio").alias("up_down"), "map_eligible")
