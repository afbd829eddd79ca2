"""Report jobs over checked operators: bootstraps of slopes, matrices, timelines, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.aggregates import FACTORS, FACTOR_SQL, _RK, ic_panel, factor_panel
from sessionloom.catalog.core import ORACLES, R, query
from sessionloom.catalog.filters import RISK_SQL, risk_input
from sessionloom.catalog.jobs import IC_SQL, _ICS
from sessionloom.catalog.joins import _rebuilt, actions_repeat, adjustments
from sessionloom.catalog.sqltext import FILINGS, I, MASTER, SPLITS, bars as B, cont, full, lag, lr, needs, ret, rows, sess
from sessionloom.functions.numeric import joined, rnd
from sessionloom.functions.staging import cut
from sessionloom.operators import aggregates as A
from sessionloom.operators import crosssection as X
from sessionloom.operators import joins as J
from sessionloom.operators import windows as W
from sessionloom.operators.topk import top_n
from sessionloom.plans import filings as FP
from sessionloom.plans import research as RS
from sessionloom.sources.fixtures import bars, filings, master, session_index, session_range, splits

ID = ["instrument_id", "session_ix"]
IDS = "instrument_id, session_ix"


_SLOPE = f"""{_ICS}, st as (select session_ix, avg(factor) as x from ip where factor is not null group by 1), z as (select row_number() over (order by session_ix)-1 as j, x, ic as y, count(*) over () as n from ics join st using (session_ix) where ic is not null), nn as (select any_value(n) as n, regr_slope(y,x) as slope from z),
 bs as (select a.j as s, sum(b.x) as fx, sum(b.y) as fy, sum(b.x*b.x) as fxx, sum(b.x*b.y) as fxy, sum(b.x) filter ((b.j-a.j+a.n)%a.n<a.n%5) as tx, sum(b.y) filter ((b.j-a.j+a.n)%a.n<a.n%5) as ty, sum(b.x*b.x) filter ((b.j-a.j+a.n)%a.n<a.n%5) as txx, sum(b.x*b.y) filter ((b.j-a.j+a.n)%a.n<a.n%5) as txy
   from z a join z b on (b.j-a.j+a.n)%a.n<5 group by 1),
 rp as (select r.range as rep, k.range as k, n, slope, ('0x'||substr(md5('slope-v1|reversal|'||r.range||'|'||k.range),1,8))::bigint%n as s from range(10000) r, nn, range(0, (n+4)//5) k),
 sm as (select rep, any_value(n) as n, any_value(slope) as slope, sum(case when k<n//5 then fx else tx end) as sx, sum(case when k<n//5 then fy else ty end) as sy, sum(case when k<n//5 then fxx else txx end) as sxx, sum(case when k<n//5 then fxy else txy end) as sxy from rp join bs using (s) group by 1),
 bt as (select slope, case when n*sxx-sx*sx>0 then (n*sxy-sx*sy)/(n*sxx-sx*sx) end as boot from sm)"""


@query("inf_02_slope_bootstrap", f"with {_SLOPE} select 'reversal' as trial, {R('any_value(slope)', 5)} as slope, {R('quantile_cont(boot,0.1)', 5)} as lower, {R('(count(*) filter (boot-slope>=slope)+1)/(count(*)+1)')} as p_value from bt")
def _(t):
    from sessionloom.functions.ranking import quantiles

    p = ic_panel(t)
    ic = A.rank_ic(p, ["session_ix"], "factor", "target").where("ic is not null")
    state = p.groupBy("session_ix").agg(F.avg("factor").alias("x"))
    series = cut(ic.join(state, "session_ix").select("session_ix", "x", F.col("ic").alias("y"), F.lit("reversal").alias("trial")))
    boot = cut(RS.slope_bootstrap(series, "trial", "x", "y", 10000, 5, "slope-v1"))
    q = quantiles(boot, ["trial"], "boot", {"lower": 0.1}).drop("n_group")
    g = boot.groupBy("trial").agg(F.max("slope").alias("slope"), F.count(F.lit(1)).alias("r"), F.count_if(F.col("boot") - F.col("slope") >= F.col("slope")).alias("e"))
    return g.join(q, "trial").select("trial", rnd("slope", 5).alias("slope"), rnd("lower", 5).alias("lower"), rnd((F.col("e") + 1) / (F.col("r") + 1)).alias("p_value"))


@query("agg_25_correlation_matrix", f"with {FACTOR_SQL}, k as (select * from fp where " + " and ".join(f"{f} is not null" for f in FACTORS) + ") " + " union all ".join(
    f"select '{a}' as a, '{b}' as b, count(*) as n, {R(f'corr({a},{b})')} as corr from k" for i, a in enumerate(FACTORS) for b in FACTORS[i:]))
def _(t):
    return RS.correlation_matrix(factor_panel(t), FACTORS).select("a", "b", "n", rnd("corr").alias("corr"))


@query("fil_14_cohort_roles", ORACLES["job_57_cohorts"].replace("select cast(combo as int) as combo, role, count(*) as n from o group by 1,2", "select role, count(*) as n, count(distinct combo) as n_combos from o group by 1"))
def _(t):
    from sessionloom.catalog.core import QUERIES

    per = QUERIES["job_57_cohorts"](t.spark, t.sf_dir)
    return per.groupBy("role").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_combos"))


@query("top_08_role_capped", """with s as (select s_nationkey as factor_id, case when s_nationkey%3=0 then 'risk' else 'alpha' end as role, s_nationkey%8 as related, round(avg(s_acctbal),4) as score from supplier group by 1),
 b as (select * from (select *, row_number() over (partition by related order by score desc, factor_id) as g from s) where g=1), r as (select *, row_number() over (partition by role order by score desc, factor_id) as rk from b)
 select cast(factor_id as bigint) as factor_id, role, rk as role_rank from r where (role='alpha' and rk<=2) or (role='risk' and rk<=1 and (select count(*) from b where role='alpha')>0)""")
def _(t):
    k = F.col("s_nationkey")
    s = t.supplier.groupBy(k.alias("factor_id")).agg(F.round(F.avg("s_acctbal"), 4).alias("score"))
    s = s.select("*", F.when(F.col("factor_id") % 3 == 0, "risk").otherwise("alpha").alias("role"), (F.col("factor_id") % 8).alias("related"))
    return RS.role_capped(s, {"alpha": 2, "risk": 1}).select(F.col("factor_id").cast("bigint").alias("factor_id"), "role", F.col("role_rank").cast("bigint").alias("role_rank"))


@query("joi_27_decision_chain", f"""with {RISK_SQL}, {B('tb', 'type', 'month')}, tr as (select instrument_id, session_ix, close/(case when session_ix-lag(session_ix,5) over (partition by instrument_id order by session_ix)=5 then lag(close,5) over (partition by instrument_id order by session_ix) end)-1 as r5 from tb),
 a as (select session_ix, 'rotation' as kind, instrument_id as id, row_number() over (partition by session_ix order by r5 desc, instrument_id) as rank from tr where r5 is not null), c as (select session_ix, 'candidate' as kind, cast(instrument_id as varchar) as id, row_number() over (partition by session_ix order by score desc, instrument_id) as rank from ri where score is not null)
 select * from a where rank<=5 and session_ix in (select session_ix from c) union all select * from c where rank<=8 and session_ix in (select session_ix from a)""")
def _(t):
    a = top_n(W.add_returns(bars(t, "type", "month"), lags=(5,)).where("r5 is not null"), ["session_ix"], [F.desc("r5"), F.col("instrument_id")], 5)
    c = top_n(risk_input(t).where("score is not null"), ["session_ix"], [F.desc("score"), F.col("instrument_id")], 8)
    a = a.select("session_ix", F.lit("rotation").alias("kind"), F.col("instrument_id").alias("id"), F.col("rank").cast("bigint").alias("rank"))
    c = c.select("session_ix", F.lit("candidate").alias("kind"), F.col("instrument_id").cast("string").alias("id"), F.col("rank").cast("bigint").alias("rank"))
    return a.join(c.select("session_ix"), "session_ix", "left_semi").unionByName(c.join(a.select("session_ix"), "session_ix", "left_semi"))


@query("job_30_repeat_summary", f"""with x as ({ORACLES['joi_05_snapshot_diff']}) select change, fields, count(*) as n from x group by 1,2""")
def _(t):
    d = J.snapshot_diff(splits(t), actions_repeat(t), "action_id", ["effective_ix", "split_from", "split_to"])
    return d.groupBy("change", joined(F.col("fields")).alias("fields")).agg(F.count(F.lit(1)).alias("n"))


@query("job_37_edition_disposition", f"""with x as ({ORACLES['joi_04_edition_diff']}) select session_ix, case when coalesce(sum(n) filter (change in ('absent','economic_change')),0)>0 then 'review' when coalesce(sum(n) filter (change='added'),0)>0 then 'extended' when coalesce(sum(n) filter (change='provenance_change'),0)>0 then 'provenance_only' else 'unchanged' end as disposition from x group by 1""")
def _(t):
    b = bars(t)
    d = J.key_diff(b.withColumn("source", F.lit("first")), _rebuilt(b), ID, ["close", "volume"], ["source"])
    has = lambda *k: F.count_if(F.col("change").isin(*k)) > 0
    return d.groupBy("session_ix").agg(F.when(has("absent", "economic_change"), "review").when(has("added"), "extended").when(has("provenance_change"), "provenance_only").otherwise("unchanged").alias("disposition"))


@query("job_43_selection_timeline", f"""with {FILINGS}, s as (select cik, concept, cast(floor(date_diff('day', date '1995-01-02', cast(available_at as date))/7.0)+1 as int) as session_ix, arg_max(round(value/100000), (available_at, accession)) as v from f group by 1,2,3),
 l as (select *, lag(v) over (partition by cik, concept order by session_ix) as pv, lag(session_ix) over (partition by cik, concept order by session_ix) as ps from s) select cik, concept, session_ix, v from l where ps is null or v<>pv""")
def _(t):
    f = filings(t).withColumn("session_ix", session_index(F.to_date(F.date_trunc("week", "available_at")), "week"))
    s = f.groupBy("cik", "concept", "session_ix").agg(F.max_by(F.round(F.col("value") / 100000), F.struct("available_at", "accession")).alias("v"))
    by = W.Window.partitionBy("cik", "concept").orderBy("session_ix")
    prev = F.lag(F.struct("v")).over(by)
    return s.withColumn("_p", prev).where(F.col("_p").isNull() | (F.col("_p.v") != F.col("v"))).select("cik", "concept", "session_ix", "v")


@query("job_50_market_state_vector", f"""with {B('mk', 'market')}, m as (select *, ln(close/{lag('close', 1)}) as lr from mk), v as (select session_ix, {ret(1)} as m1, {ret(5)} as m5, {ret(20)} as m20, {needs('lr', 10, 'stddev_samp(lr)')}*sqrt(252) as rv10, {needs('lr', 20, 'stddev_samp(lr)')}*sqrt(252) as rv20 from m),
 {B()}, r as (select session_ix, {ret(1)} as x from b), d as (select session_ix, median(x) as med, avg((x>0)::int) as up from r where x is not null group by 1), q as (select session_ix, any_value(med) as med, any_value(up) as up, median(abs(x-med))*1.4826::double as disp from r join d using (session_ix) where x is not null group by 1)
 select v.session_ix, {R('m1')} as market_1, {R('m5')} as market_5, {R('m20')} as market_20, {R('rv10')} as rv10, {R('rv20')} as rv20, {R('med')} as median_1, {R('up')} as up_share, {R('disp')} as dispersion from v left join q using (session_ix)""")
def _(t):
    from sessionloom.functions.ranking import median_mad

    m = W.realised_volatility(W.add_returns(bars(t, "market")))
    r = cut(W.add_returns(bars(t), lags=(1,)).where("r1 is not null").select("session_ix", "r1"))
    mm = median_mad(r, ["session_ix"], "r1")
    up = r.groupBy("session_ix").agg(F.avg((F.col("r1") > 0).cast("double")).alias("up"))
    df = m.join(mm, "session_ix", "left").join(up, "session_ix", "left")
    c = {"market_1": "r1", "market_5": "r5", "market_20": "r20", "rv10": "rv10", "rv20": "rv20", "median_1": "med", "up_share": "up"}
    return df.select("session_ix", *[rnd(v).alias(k) for k, v in c.items()], rnd(F.col("mad") * 1.4826).alias("dispersion"))


@query("job_53_bucket_spread", f"""with x as ({ORACLES['agg_27_rank_buckets'].replace(R('avg(target)') + ' as mean_target', 'avg(target) as mean_target')}) select session_ix, {R('max(mean_target) filter (bucket=4)-max(mean_target) filter (bucket=0)')} as spread, count(*) as n_buckets from x group by 1""")
def _(t):
    g = X.rank_buckets(ic_panel(t).where("target is not null"), "factor").groupBy("session_ix", "bucket").agg(F.avg("target").alias("m"))
    top, low = F.max(F.when(F.col("bucket") == 4, F.col("m"))), F.max(F.when(F.col("bucket") == 0, F.col("m")))
    return g.groupBy("session_ix").agg(rnd(top - low).alias("spread"), F.count(F.lit(1)).alias("n_buckets"))


@query("job_63_terminal_gaps", f"""with {B()}, g as (select {IDS}, session_ix-lag(session_ix) {I}-1 as gap from b) select instrument_id, min(session_ix) as first_ix, max(session_ix) as last_ix, (select max(session_ix) from b)-max(session_ix) as sessions_after_last, count(*) filter (gap>0) as n_gaps, cast(max(gap) as int) as longest_gap, case when max(session_ix)<(select max(session_ix)-5 from b) then 'terminal' else 'open' end as boundary from g group by 1""")
def _(t):
    g = bars(t).select(*ID, (F.col("session_ix") - F.lag("session_ix").over(W.BY) - 1).alias("gap"))
    last, end = F.max("session_ix"), session_range(t)[1]
    return g.groupBy("instrument_id").agg(F.min("session_ix").alias("first_ix"), last.alias("last_ix"), (end - last).alias("sessions_after_last"), F.count_if(F.col("gap") > 0).alias("n_gaps"), F.max("gap").alias("longest_gap"),
                                          F.when(last < end - 5, "terminal").otherwise("open").alias("boundary"))


@query("job_66_reconciliation_report", f"with x as ({ORACLES['joi_20_action_adjustment_reconcile']}) select verdict, count(*) as n, count(distinct instrument_id) as n_instruments from x group by 1")
def _(t):
    from sessionloom.catalog.core import QUERIES

    x = QUERIES["joi_20_action_adjustment_reconcile"](t.spark, t.sf_dir)
    return x.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("instrument_id").alias("n_instruments"))


@query("job_71_joint_availability", f"""with {FACTOR_SQL}, d as (select distinct session_ix from fp), h as (select session_ix, case when row_number() over (order by session_ix)<=count(*) over ()//2 then 'first' else 'second' end as half from d), u as (unpivot fp on f_ret5, f_ret20, f_range, f_volume into name factor_id value value)
 select factor_id, half, count(*) as n_available, count(distinct u.session_ix) as n_sessions from u join h on h.session_ix=u.session_ix group by 1,2""")
def _(t):
    p = factor_panel(t)
    u = A.unpivot(p, ID, FACTORS).where("value is not null").join(A.chronological_halves(p), "session_ix")
    return u.groupBy("factor_id", "half").agg(F.count(F.lit(1)).alias("n_available"), F.countDistinct("session_ix").alias("n_sessions"))
