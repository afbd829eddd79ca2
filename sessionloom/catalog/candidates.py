"""JOB-15 / JOB-16 and further jobs assembled from operators already checked one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.core import R, query
from sessionloom.catalog.filters import FACTS_SQL, LADDER_SQL, facts as filing_facts, ladder, registry
from sessionloom.catalog.sqltext import MASTER, SPLITS, bars as B, cont, full, lag, lr, needs, ret, rows, sess
from sessionloom.catalog.windows import _DOWN, _VS, _span, _versus
from sessionloom.functions.numeric import rnd
from sessionloom.functions.staging import stored
from sessionloom.operators import filters as P
from sessionloom.operators import joins as J
from sessionloom.operators import windows as W
from sessionloom.params.candidates import COMPONENTS, NORMALISERS
from sessionloom.plans import candidates as C
from sessionloom.plans import research as RS
from sessionloom.sources.fixtures import bars, master, session_range, splits

ID = ["instrument_id", "session_ix"]
IDS = "instrument_id, session_ix"


def stock_panel(t):
    """Monthly bars of all stocks, stored once for all that a query derives from them."""
    return stored(bars(t, grain="month").select(*ID, "open", "high", "low", "close", "volume"), "panel")


def _scored(t, stock=None):
    stock = stock_panel(t) if stock is None else stock
    r1 = W.add_returns(stock, lags=(1,)).where("r1 is not null")
    regime = r1.groupBy("session_ix").agg((F.avg((F.col("r1") > 0).cast("double")) * 100).alias("regime_score"))
    return C.scores(C.facts(stock, bars(t, "type", "month"), bars(t, "market", "month"), regime), stock)


def _n(c, k, lo, hi):
    if k == "log":
        return f"case when {c}>0 then least(100.0,greatest(0.0,100*(log10({c})-log10({lo}))/(log10({hi})-log10({lo})))) end"
    lin = f"least(100.0,greatest(0.0,100*({c}-({lo}))/({hi}-({lo}))))"
    return f"case when {c} is not null then {'100-' + lin if k == 'declining' else lin} end"


_P = "partition by session_ix, metric"
_comp = {n: ("least(70.0, {})" if n == "etf_sector_alignment" else "{}").format("+".join(f"{m}*{w / 100}::double" for m, w in items)) for n, (_, items) in COMPONENTS.items()}
# least() skips nulls in DuckDB, so the capped component repeats its null test
_comp["etf_sector_alignment"] = f"case when s_driver_rel5 is not null and s_stock_driver5 is not null and n_driver_corr is not null then {_comp['etf_sector_alignment']} end"
SCORE_SQL = f"""{B('b0', grain='month')}, {B('e0', 'type', 'month')}, {B('mk', 'market', 'month')}, b as (select b0.*, mk.close as b_close from b0 left join mk using (session_ix)),
 a as (select *, {ret(1)} as r1, {ret(5)} as r5, {ret(20)} as r20, {ret(5)}-(b_close/{lag('b_close', 5)}-1) as rel5, {ret(20)}-(b_close/{lag('b_close', 20)}-1) as rel20, b_close/{lag('b_close', 5)}-1 as m5, {lr()} as lr,
   {full('avg(close)', 10)} as s10, {full('avg(close)', 20)} as s20, open/{lag('close', 1)}-1 as gp, case when count(volume) {sess(20, 1)}>=15 then median(volume) {sess(20, 1)} end as pm, close*volume as dv, case when {cont(6)} then list(close) {rows(6)} end as pth from b),
 a2 as (select *, case when pm>0 then volume/pm end as vr, case when pm is not null then (volume>pm)::int end as abv, case when r1 is not null then (r1<=-0.04)::int end as hit from a),
 a3 as (select *, s10/s20-1 as sma_spread, case when s10 is not null then case when close>s10 then 100.0 else 0.0 end end as n_above10, {needs('lr', 10, 'stddev_samp(lr)')}*sqrt(252) as rv10, {needs('gp', 5, 'max(abs(gp))')} as max_gap,
   case when count(hit) {sess(5)}>=4 then avg(hit) {sess(5)} end as tail_share, case when count(abv) {sess(5)}>=5 then avg(abv) {sess(5)} end*100 as n_persistence,
   case when r1 is not null and vr is not null then case when r1>0 and vr>1 then 100.0 when r1>0 or vr>1 then 50.0 else 0.0 end end as participation, ln(vr) as log_volume,
   case when pth is not null then abs(list_min(list_transform(range(1,7), lambda k: pth[k]/list_max(pth[1:k])-1))) end as dd_abs, case when count(*) {sess(20)}>=15 then median(dv) {sess(20)} end as median_dv, count(*) {sess(21)} as n_history from a2),
 fe as (select {IDS}, {lr()} as flr, {ret(5)} as f5 from e0),
 pr as (select s.instrument_id, s.session_ix, fe.instrument_id as fund, f5, case when lr is not null and flr is not null then lr end as x, case when lr is not null and flr is not null then flr end as y from a s join fe on fe.session_ix=s.session_ix),
 pc as (select *, count(x) over pw as n, round(corr(x,y) over pw,10) as cr from pr window pw as (partition by instrument_id, fund order by session_ix range between 19 preceding and current row)),
 dr as (select * from (select *, row_number() over (partition by {IDS} order by cr desc, fund) as rn from pc where f5>0 and n>=18 and cr>=0.35) where rn=1),
 rgm as (select session_ix, avg((r1>0)::int)*100 as n_regime from a where r1 is not null group by 1),
 f as (select a3.*, dr.fund as driver, dr.cr as driver_corr, dr.f5-m5 as driver_rel5, r5-dr.f5 as stock_driver5, n_regime from a3 left join dr on dr.instrument_id=a3.instrument_id and dr.session_ix=a3.session_ix left join rgm on rgm.session_ix=a3.session_ix),
 tl as (select {IDS}, metric, x from ({' union all '.join(f"select {IDS}, '{k}' as metric, {c} as x from f" for k, c in C.CROSS.items())}) where x is not null),
 tq as (select session_ix, metric, quantile_cont(x,0.05) as lo, quantile_cont(x,0.95) as hi from tl group by 1,2), tw as (select tl.*, least(hi,greatest(lo,x)) as v from tl join tq using (session_ix, metric)), tm as (select session_ix, metric, median(v) as med from tw group by 1,2),
 td as (select session_ix, metric, any_value(med) as med, median(abs(v-med)) as mad from tw join tm using (session_ix, metric) group by 1,2),
 tp as (select *, case when count(*) over ({_P}, v)=count(*) over ({_P}) then 50.0 else 100.0*(rank() over ({_P} order by v)+(count(*) over ({_P}, v)-1)/2.0-1)/(count(*) over ({_P})-1) end as pct from tw),
 ts as (select {IDS}, metric, case when mad=0 then pct else least(100.0,greatest(0.0,50+15*0.67448975*(v-med)/mad)) end as score from tp join td using (session_ix, metric)),
 tv as (select {IDS}, {', '.join(f"max(score) filter (metric='{k}') as {k}" for k in C.CROSS)} from ts group by 1,2),
 rp as (select {IDS}, case when count(*) over (partition by session_ix, r20)=count(*) over (partition by session_ix) then 50.0 else 100.0*(rank() over (partition by session_ix order by r20)+(count(*) over (partition by session_ix, r20)-1)/2.0-1)/(count(*) over (partition by session_ix)-1) end as p_r20 from f where r20 is not null),
 nz as (select f.*, {', '.join(k for k in C.CROSS)}, p_r20, {', '.join(f"{_n(c, k, lo, hi)} as {n}" for n, (c, k, lo, hi) in NORMALISERS.items())} from f left join tv on tv.instrument_id=f.instrument_id and tv.session_ix=f.session_ix left join rp on rp.instrument_id=f.instrument_id and rp.session_ix=f.session_ix),
 cm as (select *, {', '.join(f"{e} as {n}" for n, e in _comp.items())} from nz),
 cw as (select *, {'+'.join(f"(case when {n} is not null then {w} else 0 end)" for n, (w, _) in COMPONENTS.items())} as weight, {'+'.join(f"coalesce({n}*{w},0)" for n, (w, _) in COMPONENTS.items())} as tot from cm),
 sc as (select *, case when weight>=80 then tot/weight end as base_score, 0.40::double*weight/100+0.25::double*least(n_history/21,1.0)+0.20::double*(case when driver is not null then 0.35 else 0 end) as confidence from cw)"""


@query("job_15_candidate_score", f"with {SCORE_SQL} select {IDS}, " + ", ".join(f"{R(n, 5)} as {n}" for n in COMPONENTS) + f", cast(weight as int) as weight, {R('base_score', 5)} as base_score, {R('confidence', 5)} as confidence from sc")
def _(t):
    s = _scored(t)
    return s.select(*ID, *[rnd(n, 5).alias(n) for n in COMPONENTS], F.col("weight").cast("int").alias("weight"), rnd("base_score", 5).alias("base_score"), rnd("confidence", 5).alias("confidence"))


MODES = {"conservative": dict(minimum_price=10.0, minimum_median_dollar_volume=500000.0, maximum_annualized_volatility=15.0, maximum_absolute_open_gap=10.0, minimum_confidence=0.60, adrc_permitted=False),
         "balanced": dict(minimum_price=5.0, minimum_median_dollar_volume=200000.0, maximum_annualized_volatility=25.0, maximum_absolute_open_gap=40.0, minimum_confidence=0.50, adrc_permitted=True),
         "aggressive": dict(minimum_price=5.0, minimum_median_dollar_volume=100000.0, maximum_annualized_volatility=40.0, maximum_absolute_open_gap=100.0, minimum_confidence=0.45, adrc_permitted=True)}
CAPS = {"conservative": (5, 0.4), "balanced": (8, 0.25), "aggressive": (12, 0.35)}


def _mode_sql(m):
    p, (cap, share) = MODES[m], CAPS[m]
    return f"""select {IDS}, '{m}' as mode, rank, {R('base_score', 5)} as score from (select *, row_number() over (partition by session_ix order by round(base_score,6) desc, instrument_id) as rank from (
     select sc.*, row_number() over (partition by session_ix, exchange order by round(base_score,6) desc, instrument_id) as gr from sc join m using (instrument_id) where base_score>=45 and close>=5 and median_dv>=100000 and confidence>=0.4 and median_dv>={p['minimum_median_dollar_volume']}
     and rv10<={p['maximum_annualized_volatility']} and max_gap<={p['maximum_absolute_open_gap']} and confidence>={p['minimum_confidence']} and (form<>'ADRC' or {str(p['adrc_permitted']).lower()})) where gr<={int(cap * share)}) where rank<={cap}"""


@query("job_16_risk_mode_lists", f"with {SCORE_SQL}, {MASTER} " + " union all ".join(_mode_sql(m) for m in MODES))
def _(t):
    s = stored(_scored(t).select(*ID, "base_score", "close", "median_dv", "rv10", "max_gap", "confidence"), "scored").join(master(t).select("instrument_id", "form", "exchange"), "instrument_id")
    r = C.risk_lists(s, MODES, 45.0, 5.0, 100000.0, 0.4, CAPS)
    return r.select(*ID, "mode", F.col("rank").cast("bigint").alias("rank"), rnd("score", 5).alias("score"))


@query("job_47_factor_catalog_v2", f"""{_DOWN}, mo as (select {IDS}, {_span('close', 126, 5)}-{_span('b_close', 126, 5)} as momentum, -({_span('close', 5, 0)}-{_span('b_close', 5, 0)}) as reversal from b)
 select a.instrument_id, a.session_ix, {R('momentum')} as momentum, {R('reversal')} as reversal, {R('case when whole and ndn>=12 then adn end')} as down_market_return, {R('case when whole then sqrt(252*asq) end')} as downside_deviation, {R('case when whole and sxx>0 then sqrt(252*greatest(syy-sxy*sxy/sxx,0.0)/58) end')} as residual_volatility
 from a join mo on mo.instrument_id=a.instrument_id and mo.session_ix=a.session_ix""")
def _(t):
    df = W.down_market(W.relative_windows(_versus(t)))
    return df.select(*ID, *[rnd(c).alias(c) for c in ("momentum", "reversal", "down_market_return", "downside_deviation", "residual_volatility")])


@query("job_32_adjusted_series", f"""with {B()}, {SPLITS}, fx as (select b.instrument_id, b.session_ix, coalesce(product(split_from)/product(split_to),1.0) as k from b left join sp on sp.instrument_id=b.instrument_id and sp.effective_ix>b.session_ix and sp.effective_ix<=(select max(session_ix) from b) group by 1,2)
 select b.instrument_id, b.session_ix, {R('open*k', 9)} as open, {R('high*k', 9)} as high, {R('low*k', 9)} as low, {R('close*k', 9)} as close, {R('volume/k')} as volume from b join fx on fx.instrument_id=b.instrument_id and fx.session_ix=b.session_ix""")
def _(t):
    df = J.split_factor(bars(t), splits(t), F.lit(session_range(t)[1]))
    k = F.col("price_factor")
    return df.select(*ID, *[rnd(F.col(c) * k, 9).alias(c) for c in ("open", "high", "low", "close")], rnd(F.col("volume") / k).alias("volume"))


@query("job_27_membership_ledger", f"with {LADDER_SQL} select policy, session_ix, count(*) as n_decisions, count(*) filter (disposition='included') as n_members, count(distinct disposition) as n_kinds from ld group by 1,2")
def _(t):
    d = ladder(t)
    return d.groupBy("policy", "session_ix").agg(F.count(F.lit(1)).alias("n_decisions"), F.count_if(F.col("disposition") == "included").alias("n_members"), F.countDistinct("disposition").alias("n_kinds"))


@query("job_41_query_readiness", f"""with {FACTS_SQL}, el as (select * from fe where eligibility='query_eligible'), p as (select query_id, cik, start_date, end_date, count(*) as n, count(distinct value) as nv from el group by 1,2,3,4)
 select query_id, count(*) as n_periods, count(*) filter (nv=1) as n_clean, count(distinct cik) filter (nv=1) as n_filers from p group by 1""")
def _(t):
    el = P.fact_eligibility(filing_facts(t).join(registry(t.spark), "concept")).where("eligibility = 'query_eligible'")
    p = el.groupBy("query_id", "cik", "start_date", "end_date").agg((F.min("value") == F.max("value")).alias("clean"))
    return p.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_periods"), F.count_if("clean").alias("n_clean"), F.countDistinct(F.when(F.col("clean"), F.col("cik"))).alias("n_filers"))


@query("job_56_split_plan", f"""with {B()}, s as (select distinct session_ix from b), x as (select session_ix, row_number() over (order by session_ix)-1 as i, count(*) over () as n from s), y as (select *, n//2 as v, n//2+n//4 as h from x)
 select case when i<v then 'development' when i<h then 'validation' else 'holdout' end as split, count(*) as n_sessions, count(*) filter (not (i<126 or i+5>=n or (i>=v-5 and i<v+5) or (i>=h-5 and i<h+5))) as n_usable from y group by 1""")
def _(t):
    p = RS.split_plan(bars(t).select("session_ix").distinct(), warmup=126, horizon=5, purge=5, embargo=5)
    return p.groupBy("split").agg(F.count(F.lit(1)).alias("n_sessions"), F.count_if("usable").alias("n_usable"))


@query("job_62_evidence_blockers", f"""with {B()}, {SPLITS}, l as (select instrument_id, max(session_ix) as last_ix from b group by 1), p as (select b.instrument_id, b.session_ix, any_value(last_ix) as last_ix, count(sp.action_id) filter (effective_ix>session_ix-20 and effective_ix<=session_ix+5) as n from b join l on l.instrument_id=b.instrument_id left join sp on sp.instrument_id=b.instrument_id group by 1,2)
 select session_ix, count(*) as n_paths, count(*) filter (n>0) as n_action_exposed, count(*) filter (session_ix+5>last_ix) as n_lifecycle_exposed, count(*) filter (n=0 and session_ix+5<=last_ix) as n_clear from p group by 1""")
def _(t):
    e = J.events_in_windows(bars(t).select(*ID), splits(t), 20, [5])
    last = F.max("session_ix").over(W.Window.partitionBy("instrument_id"))
    e = e.withColumn("last_ix", last)
    exposed, ends = (F.col("n_back") + F.col("n_ahead5")) > 0, F.col("session_ix") + 5 > F.col("last_ix")
    return e.groupBy("session_ix").agg(F.count(F.lit(1)).alias("n_paths"), F.count_if(exposed).alias("n_action_exposed"), F.count_if(ends).alias("n_lifecycle_exposed"), F.count_if(~exposed & ~ends).alias("n_clear"))
