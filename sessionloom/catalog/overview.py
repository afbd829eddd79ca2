"""Overview and coverage jobs: market overview, price paths, pullback features, reference ingestion, raw partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.aggregates import universe_returns, URET
from sessionloom.catalog.core import R, query
from sessionloom.catalog.filters import LOCAL_SQL, local_states
from sessionloom.catalog.sqltext import UNIVERSE, bars as B, cont, full, lag, needs, ret, rows
from sessionloom.functions.numeric import rnd
from sessionloom.functions.scalars import identifier
from sessionloom.operators import crosssection as X
from sessionloom.operators import filters as P
from sessionloom.operators import windows as W
from sessionloom.operators.topk import top_n
from sessionloom.sources.fixtures import bars, universe

ID = ["instrument_id", "session_ix"]
IDS = "instrument_id, session_ix"


@query("job_01_market_overview", f"""with {URET}, c as (select universe, session_ix, instrument_id, r1, r1>=1 or r1<=-0.5 as outlier, close*volume as dv from ur where r1 is not null),
 t as (select *, row_number() over (partition by universe, session_ix order by r1 desc, dv desc, instrument_id) as up, row_number() over (partition by universe, session_ix order by dv desc, instrument_id) as busy from c where not outlier)
 select c.universe, c.session_ix, count(*) as n, count(*) filter (c.outlier) as n_outliers, count(*) filter (c.r1>0) as advancers, any_value(g.instrument_id) as top_gainer, any_value(b.instrument_id) as most_active
 from c left join (select * from t where up=1) g on g.universe=c.universe and g.session_ix=c.session_ix left join (select * from t where busy=1) b on b.universe=c.universe and b.session_ix=c.session_ix group by 1,2""")
def _(t):
    by = ["universe", "session_ix"]
    c = universe_returns(t).where("r1 is not null").select(*by, "instrument_id", "r1", (F.col("close") * F.col("volume")).alias("dv"), ((F.col("r1") >= 1) | (F.col("r1") <= -0.5)).alias("outlier"))
    ok = c.where("not outlier")
    up = top_n(ok, by, [F.desc("r1"), F.desc("dv"), F.col("instrument_id")], 1).select(*by, F.col("instrument_id").alias("top_gainer"))
    busy = top_n(ok, by, [F.desc("dv"), F.col("instrument_id")], 1).select(*by, F.col("instrument_id").alias("most_active"))
    g = c.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("outlier").alias("n_outliers"), F.count_if(F.col("r1") > 0).alias("advancers"))
    return g.join(up, by, "left").join(busy, by, "left")


@query("job_22_price_paths", f"""with {B(grain='month')}, p as (select {IDS}, {cont(20)} as ok, list(close) {rows(20)} as path, max(close) {rows(20)} as hi, min(close) {rows(20)} as lo, close from b)
 select {IDS}, {R('case when ok then path[1] end', 8)} as first_close, case when ok then len(path) end as n_points, {R('case when ok then hi end', 8)} as reference_high, {R('case when ok then lo end', 8)} as reference_low, {R('case when ok and hi>lo then (close-lo)/(hi-lo) end')} as position from p""")
def _(t):
    b = bars(t, grain="month").select(*ID, "close", W.full(F.collect_list("close"), 20).alias("path"), W.full(F.max("close"), 20).alias("hi"), W.full(F.min("close"), 20).alias("lo"))
    pos = F.when(F.col("hi") > F.col("lo"), (F.col("close") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    n = F.when(F.col("path").isNotNull(), F.size("path").cast("bigint"))
    return b.select(*ID, rnd(F.get("path", F.lit(0)), 8).alias("first_close"), n.alias("n_points"), rnd("hi", 8).alias("reference_high"), rnd("lo", 8).alias("reference_low"), rnd(pos).alias("position"))


@query("job_55_pullback_features", f"""with {B(grain='month')}, a as (select *, {ret(20)} as r20, case when {lag('close', 1)} is not null then greatest(high-low, abs(high-{lag('close', 1)}), abs(low-{lag('close', 1)})) end as tr, {full('avg(close)', 20)} as s20 from b),
 f as (select {IDS}, r20, close, case when {cont(11)} then max(close) {rows(10, 1)} end as ph, {needs('tr', 14, 'avg(tr)')} as atr, close>{lag('close', 1)} as above_prior_close, close>{lag('high', 1)} as above_prior_high, close>s20 as above_trend, volume/nullif({lag('volume', 1)},0) as vr from a),
 k as (select {IDS}, case when count(*) over (partition by session_ix, r20)=count(*) over (partition by session_ix) then 50.0 else 100.0*(rank() over (partition by session_ix order by r20)+(count(*) over (partition by session_ix, r20)-1)/2.0-1)/(count(*) over (partition by session_ix)-1) end as rs from f where r20 is not null)
 select f.instrument_id, f.session_ix, {R('rs')} as rs_percentile, {R('(ph-close)/nullif(atr,0)')} as depth_atr, above_prior_close, above_prior_high, above_trend, {R('vr')} as volume_ratio from f join k on k.instrument_id=f.instrument_id and k.session_ix=f.session_ix""")
def _(t):
    b = W.trailing_means(W.average_true_range(W.add_returns(bars(t, grain="month"), lags=(20,))))
    f = b.select(*ID, "r20", "close", "atr14", F.when(W.contiguous(11), F.max("close").over(W.rows(10, 1))).alias("ph"), (F.col("close") > W.lagged("close", 1)).alias("above_prior_close"),
                 (F.col("close") > W.lagged("high", 1)).alias("above_prior_high"), F.col("above20").alias("above_trend"), (F.col("volume") / W.lagged("volume", 1)).alias("volume_ratio"))
    f = X.percentile_0_100(f, "r20", out="rs")
    depth = (F.col("ph") - F.col("close")) / F.nullif(F.col("atr14"), F.lit(0.0))
    return f.select(*ID, rnd("rs").alias("rs_percentile"), rnd(depth).alias("depth_atr"), "above_prior_close", "above_prior_high", "above_trend", rnd("volume_ratio").alias("volume_ratio"))


@query("job_61_coverage_census", f"""with {B()}, {UNIVERSE}, c as (select instrument_id, count(*) as n, min(session_ix) as f, max(session_ix) as l from b where instrument_id in (select instrument_id from u) group by 1)
 select case when n>=300 then 'full' when n>=250 then 'usable' else 'sparse' end as coverage, count(*) as n_instruments, cast(sum(n) as bigint) as n_bars, min(f) as first_ix, max(l) as last_ix from c group by 1""")
def _(t):
    c = P.members(bars(t), universe(t)).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"), F.min("session_ix").alias("f"), F.max("session_ix").alias("l"))
    kind = F.when(F.col("n") >= 300, "full").when(F.col("n") >= 250, "usable").otherwise("sparse")
    return c.groupBy(kind.alias("coverage")).agg(F.count(F.lit(1)).alias("n_instruments"), F.sum("n").alias("n_bars"), F.min("f").alias("first_ix"), F.max("l").alias("last_ix"))


@query("src_09_reference_tickers", """with r as (select s_name as ticker, nullif(upper(trim(case when s_suppkey%3=0 then ' f'||(s_suppkey%40) else '' end)),'') as share_id, 'P'||s_suppkey as provider_id from supplier), s as (select *, coalesce(share_id, provider_id) as stable_id, case when share_id is not null then 'share' else 'provider' end as kind from r),
 c as (select stable_id, count(distinct ticker) as n from s group by 1) select ticker, s.stable_id, kind, case when n>1 then 'ambiguous' else 'resolved' end as status from s join c using (stable_id)""")
def _(t):
    from sessionloom.operators.aggregates import claims

    k = F.col("s_suppkey")
    body = F.to_json(F.struct(F.col("s_name").alias("ticker"), F.when(k % 3 == 0, F.concat(F.lit(" f"), k % 40)).otherwise("").alias("share_id"), F.concat(F.lit("P"), k).alias("provider_id")))
    p = t.supplier.select(F.from_json(body, "ticker string, share_id string, provider_id string").alias("p")).select("p.*")
    share = identifier(F.col("share_id"))
    s = p.select("ticker", F.coalesce(share, F.col("provider_id")).alias("stable_id"), F.when(share.isNotNull(), "share").otherwise("provider").alias("kind"))
    return s.join(claims(s, "ticker", "stable_id", "n"), "stable_id").select("ticker", "stable_id", "kind", F.when(F.col("n") > 1, "ambiguous").otherwise("resolved").alias("status"))


@query("src_15_raw_partition", f"""with {LOCAL_SQL}, x as (select *, instrument_id%25=0 as quarantined from ls) select session_ix, count(*) filter (not quarantined) as n_states, count(*) filter (not quarantined and trading_status<>'suspended' and has_bar) as n_bars, count(*) filter (quarantined) as n_dropped from x group by 1""")
def _(t):
    x = local_states(t).withColumn("q", F.col("instrument_id") % 25 == 0)
    ok = ~F.col("q")
    return x.groupBy("session_ix").agg(F.count_if(ok).alias("n_states"), F.count_if(ok & (F.col("trading_status") != "suspended") & F.col("has_bar")).alias("n_bars"), F.count_if("q").alias("n_dropped"))
