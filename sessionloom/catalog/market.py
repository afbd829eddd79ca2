"""JOB-01..13: market jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.core import R, query
from sessionloom.catalog.sqltext import I, MASTER, UNIVERSE, bars as B, cont, full, lag, lr, needs, ret, rows, sess
from sessionloom.catalog.windows import _PAIRW, _REL, _LV, _LW, _dir
from sessionloom.functions.numeric import rnd
from sessionloom.operators.filters import members
from sessionloom.operators import windows as W
from sessionloom.params.regime import DIMENSIONS
from sessionloom.plans import market as M
from sessionloom.sources.fixtures import bars, universe
from sessionloom.functions.staging import stored

ID = ["instrument_id", "session_ix"]
IDS = "instrument_id, session_ix"
METRICS = {d: [m[0] for m in items] for d, (_, items) in DIMENSIONS.items()}


def regime_metrics(t, stock=None):
    u = universe(t)
    total = u.agg(F.count(F.lit(1)).alias("n")).scalar()
    own = M.member_metrics(stored(members(bars(t, grain="month") if stock is None else stock, u).select("instrument_id", "session_ix", "close", "volume"), "members"), total, min_obs=10, min_positive=4)
    return own.join(M.benchmark_metrics(bars(t, "region", "month"), bars(t, "market", "month"), 5, 3), "session_ix", "left")


_MAD = "(select session_ix, median(abs({c}-med)) as {o} from ms join (select session_ix, median({c}) as med from ms where {c} is not null group by 1) using (session_ix) where {c} is not null group by 1)"
REGIME = f"""{B('b0', grain='month')}, {UNIVERSE}, {B('rg', 'region', 'month')}, {B('mk', 'market', 'month')},
 b as (select * from b0 where instrument_id in (select instrument_id from u)), nm as (select count(*) as total from u),
 m1 as (select *, {ret(1)} as r1, {ret(5)} as r5, {full('avg(close)', 20)} as sma20, {full('max(close)', 20)} as hi, {full('min(close)', 20)} as lo, {lr()} as lr, close*volume as dv,
   case when count(volume) {sess(20, 1)}>=15 then median(volume) {sess(20, 1)} end as pm from b),
 ms as (select *, {needs('lr', 10, 'stddev_samp(lr)')}*sqrt(252) as rv from m1),
 g0 as (select session_ix, count(*) as nb, count(r1) as n1, count(r5) as n5, count(sma20) as n20, count(rv) as nv, avg(case when r1 is not null then (r1>0)::int end) as adv, avg(case when r5 is not null then (r5>0)::int end) as pos5,
   avg((close>sma20)::int) as ab, avg(case when hi is not null then (close=hi)::int-(close=lo)::int end) as bal, count(*) filter (r1<=-0.04) as nt, sum(dv) as dva, sum(dv) filter (r1 is not null) as dv1, coalesce(sum(dv) filter (r1>0),0) as dvu,
   count(pm) as no_, avg(case when pm is not null then (volume>pm)::int end) as own, median(rv) as mrv from ms group by 1),
 g1 as (select *, case when nb/total>=0.8 then dva end as dvc, total from g0, nm),
 g2 as (select *, sum(n1) over l5 as np, sum(nt) over l5 as nt5, count(dvc) over p20 as nr, median(dvc) over p20 as ref from g1 window l5 as (order by session_ix range between 4 preceding and current row), p20 as (order by session_ix range between 20 preceding and 1 preceding)),
 tp as (select session_ix, case when any_value(n)>=4 then sum(case when rn<=ceil(n/10.0) then r5 end)/sum(r5) end as wc from (select session_ix, r5, row_number() over (partition by session_ix order by r5 desc) as rn, count(*) over (partition by session_ix) as n from ms where r5>0) group by 1),
 bm0 as (select instrument_id, session_ix, {ret(5)} as r5, {ret(20)} as r20, close>{full('avg(close)', 20)} as ab from rg),
 bm as (select session_ix, count(r20) as c20, median(r20) as m20, count(r5) as c5, median(r5) as m5, count(ab) as cs, avg(ab::int) as sma from bm0 group by 1),
 ag as (select session_ix, avg((sign(r5)=sign(m5))::int) as agree from bm0 join bm using (session_ix) where r5 is not null group by 1),
 sv0 as (select *, {lr()} as lr from mk), sv as (select session_ix, {needs('lr', 10, 'stddev_samp(lr)')}*sqrt(252) as spv from sv0),
 mt as (select g2.session_ix, case when c20=5 then m20 end as broad_return_20, case when c5=5 then m5 end as broad_return_5, case when cs>=3 then sma end as broad_above_sma20_share, case when c5>=3 then agree end as broad_direction_agreement,
   case when n1/total>=0.8 and n1>=10 then adv end as advancer_share_1, case when n5/total>=0.8 then pos5 end as positive_return_share_5, case when n20/total>=0.75 then ab end as above_sma20_share, case when n20/total>=0.75 then bal end as high_low_balance_20,
   spv as spy_realized_volatility_10, case when nv/total>=0.7 then mrv end as median_stock_realized_volatility_10, case when np/(total*5)>=0.7 then nt5/np end as downside_tail_frequency_5, case when n1>=10 then 1.4826::double*d1 end as cross_sectional_dispersion_1,
   case when nb/total>=0.8 and nr>=18 then dva/nullif(ref,0) end as aggregate_participation_ratio, case when n1/total>=0.8 then dvu/nullif(dv1,0) end as up_participation_share, case when no_/total>=0.7 then own end as above_own_volume_median_share,
   case when n5/total>=0.7 then wc end as winner_concentration_5, case when c5>=3 then agree end as benchmark_direction_agreement_5, case when n5>=10 then 1.4826::double*d5 end as return_dispersion_5
  from g2 left join {_MAD.format(c='r1', o='d1')} using (session_ix) left join {_MAD.format(c='r5', o='d5')} using (session_ix) left join tp using (session_ix) left join bm using (session_ix) left join ag using (session_ix) left join sv using (session_ix))"""


def _dimension(key, dim):
    cols = METRICS[dim]

    @query(key, f"with {REGIME} select session_ix, " + ", ".join(f"{R(c)} as {c}" for c in cols) + " from mt")
    def _(t):
        return regime_metrics(t).select("session_ix", *[rnd(c).alias(c) for c in cols])


for _key, _dim in (("job_02_trend", "trend"), ("job_03_breadth", "breadth"), ("job_04_volatility", "volatility"), ("job_05_participation", "liquidity_participation"), ("job_06_leadership", "leadership_dispersion")):
    _dimension(_key, _dim)


def _norm(m, method, low, high, center):
    lin = f"least(100.0,greatest(0.0,100*({m}-({low}))/({high - low})))"
    if method == "triangular":
        return f"case when {m}<={low} or {m}>={high} then 0.0 when {m}<={center} then 100*({m}-{low})/{center - low} else 100*({high}-{m})/{high - center} end"
    return f"case when {m} is not null then {'100-' + lin if method == 'declining' else lin} end"


def _share(d, w):
    """Exact half-even quantum of score * weight / 100 in integer arithmetic."""
    v = f"(cast(round({d}_score*10000) as bigint)*{w})"
    return f"coalesce(({v}//100+case when {v}%100>50 or ({v}%100=50 and ({v}//100)%2=1) then 1 else 0 end)/10000.0,0)"


def _composite_sql():
    ctes, parts = [], []
    prev = "mt"
    for d, (w, items) in DIMENSIONS.items():
        tot = "+".join(f"(case when {i[0]} is not null then {i[5]} else 0 end)" for i in items)
        scored = ", ".join(f"case when {i[0]} is not null then round_even({_norm(*i[:5])},10) end as s{k}" for k, i in enumerate(items))
        base = ", ".join(f"case when {i[0]} is not null then round_even({i[5]}*100.0::double/tot,4) else 0 end as e{k}" for k, i in enumerate(items))
        eff = []
        for k in range(len(items)):
            later = " or ".join(f"{items[j][0]} is not null" for j in range(k + 1, len(items))) or "false"
            before = "+".join(["0"] + [f"e{j}" for j in range(k)])
            eff.append(f"coalesce(round_even(s{k}*(case when {items[k][0]} is null then 0 when {later} then e{k} else round_even(100-({before}),4) end)/100,4),0)")
        ctes.append(f"{d}_t as (select *, {tot} as tot from {prev})")
        ctes.append(f"{d}_e as (select *, {scored}, {base} from {d}_t)")
        ctes.append(f"{d}_s as (select * exclude (tot, {', '.join(f's{k}, e{k}' for k in range(len(items)))}), case when tot>=70 then round_even({'+'.join(eff)},4) end as {d}_score from {d}_e)")
        prev = f"{d}_s"
        parts.append((d, w))
    weight = "+".join(f"(case when {d}_score is not null then {w} else 0 end)" for d, w in parts)
    value = "+".join(_share(d, w) for d, w in parts)
    return (f"{REGIME}, " + ", ".join(ctes) + f", cp as (select *, {weight} as weight_available, case when {weight}>=90 and trend_score is not null and breadth_score is not null and volatility_score is not null then round_even({value},4) end as regime_score from {prev})")


@query("job_07_composite", f"with {_composite_sql()} select session_ix, cast(weight_available as int) as weight_available, " + ", ".join(f"{R(d + '_score', 4)} as {d}_score" for d in DIMENSIONS) + f", {R('regime_score', 4)} as regime_score from cp")
def _(t):
    c = M.composite(regime_metrics(t))
    return c.select("session_ix", F.col("weight_available").cast("int").alias("weight_available"), *[rnd(f"{d}_score", 4).alias(f"{d}_score") for d in DIMENSIONS], rnd("regime_score", 4).alias("regime_score"))


def daily_composite(t):
    """Stand-in composite per user from the event stream: mean value rescaled to 0..100, gaps where a day is silent; with its first and last day."""
    day = F.to_date("ts")
    start, end = t.events.agg(F.min(day), F.max(day)).first()
    last = 1 if start is None else (end - start).days + 1
    e = t.events.groupBy(F.col("user_id").alias("universe_id"), (F.datediff(day, F.lit(start).cast("date")) + 1).alias("session_ix")).agg(F.avg("value").alias("v"))
    return e.select("universe_id", "session_ix", F.least(F.lit(100.0), F.round(F.col("v") * 2, 4)).alias("score")), 1, last


@query("job_09_state_explanation", f"""with {_composite_sql()} select session_ix, {R('regime_score-70', 4)} as to_risk_on, {R('regime_score-50', 4)} as to_balanced, {R('regime_score-30', 4)} as to_defensive,
 array_to_string(list_sort(list_filter([{','.join(f"case when {d}_score>=60 then '{d}' end" for d in DIMENSIONS)}], lambda x: x is not null)),'|') as supporting,
 array_to_string(list_sort(list_filter([{','.join(f"case when {d}_score<=40 then '{d}' end" for d in DIMENSIONS)}], lambda x: x is not null)),'|') as conflicting from cp""")
def _(t):
    from sessionloom.functions.numeric import joined, reasons

    c = M.composite(regime_metrics(t))
    s = F.col("regime_score")
    return c.select("session_ix", rnd(s - 70, 4).alias("to_risk_on"), rnd(s - 50, 4).alias("to_balanced"), rnd(s - 30, 4).alias("to_defensive"),
                    joined(reasons(*[(F.col(f"{d}_score") >= 60, d) for d in DIMENSIONS])).alias("supporting"), joined(reasons(*[(F.col(f"{d}_score") <= 40, d) for d in DIMENSIONS])).alias("conflicting"))


_REL_STATE = f"""{_PAIRW}, q0 as (select *, ln(lc/rc) as ratio from ps), q1 as (select *, {_LV} as s from q0), q2 as (select *, list_aggregate(s,'median') as med from q1), q3 as (select *, list_aggregate(list_transform(s, lambda x: abs(x-med)),'median') as mad from q2),
 q4 as (select *, case when mad>0 then (ratio-med)/mad end as z from q3),
 q5 as (select *, {lag('corr20', 5)} as cp, {lag('z', 1)} as zp, {lag('spread5', 1)} as sp, count(*) over (partition by instrument_id order by session_ix) as np,
   coalesce((corr18>=0.35)=(corr20>=0.35) and (corr20>=0.35)=(corr22>=0.35), false) as pc, coalesce(sign(spread20)=sign({lag('spread20', 20)}) and sign(spread20)<>0, false) as nc from q4),
 rs as (select {IDS}, case when spread5 is null then 'unavailable' when cp>=0.60 and corr20<=0.20 and corr20-cp<=-0.40 then 'relationship_break_candidate'
   when abs(z)>=2 and abs(zp)>=2 and sign(z)=sign(spread5) and sign(z)<>0 and sign(zp)=sign(sp) and sign(zp)<>0 then 'rotation_candidate' when lret5*rret5<0 and abs(spread5)>=0.02 then 'divergence'
   when lret5>0 and rret5>0 and corr20>=0.35 then 'synchronous_strengthening' when lret5<0 and rret5<0 and corr20>=0.35 then 'synchronous_weakening' else 'neutral' end as relationship_state,
   case when np<21 then 'insufficient' when np<60 then 'low' when not pc then 'low' when np<120 then 'medium' when nc then 'high' else 'medium' end as confidence, spread5 from q5)"""


def relationships(t):
    return M.relationship_state(W.pair_panel(bars(t, "type")))


@query("job_10_pair_relationships", f"with {_REL_STATE} select {IDS}, relationship_state, confidence from rs")
def _(t):
    return relationships(t).select(*ID, "relationship_state", "confidence")


@query("job_11_regime_alignment", f"""with {_REL_STATE}, g as (select *, case session_ix%3 when 0 then 'balanced' when 1 then 'risk_on' else 'defensive' end as regime from rs)
 select {IDS}, case when relationship_state='unavailable' then 'neutral' when relationship_state='relationship_break_candidate' then 'conflict'
  when relationship_state in ('divergence','rotation_candidate') then case when regime='balanced' then 'conflict' when (case when spread5>0 then 'risk_on' else 'defensive' end)=regime then 'consistent' else 'conflict' end
  when relationship_state='neutral' and regime='balanced' then 'consistent' else 'neutral' end as alignment from g""")
def _(t):
    r = relationships(t)
    regime = F.element_at(F.array(F.lit("balanced"), F.lit("risk_on"), F.lit("defensive")), (F.col("session_ix") % 3 + 1).cast("int"))
    st, tilt = F.col("relationship_state"), F.when(F.col("spread5") > 0, "risk_on").otherwise("defensive")
    return r.select(*ID, F.when(st == "unavailable", "neutral").when(st == "relationship_break_candidate", "conflict")
                    .when(st.isin("divergence", "rotation_candidate"), F.when(regime == "balanced", "conflict").when(tilt == regime, "consistent").otherwise("conflict"))
                    .when((st == "neutral") & (regime == "balanced"), "consistent").otherwise("neutral").alias("alignment"))


@query("job_12_relationship_changes", f"""with {_REL_STATE}, f as (select *, case when lag(relationship_state) {I}=relationship_state or lag(relationship_state) {I} is null then 0 else 1 end as fresh from rs),
 g as (select *, sum(fresh) over (partition by instrument_id order by session_ix) as isle, row_number() over (partition by instrument_id order by session_ix desc) as back from f), h as (select *, row_number() over (partition by instrument_id, isle order by session_ix) as run_length from g)
 select {IDS}, relationship_state, run_length, isle=0 as reaches_start from h where back<=10""")
def _(t):
    from sessionloom.operators.topk import top_n

    r = W.state_runs(relationships(t).select(*ID, "relationship_state"), "relationship_state")
    r = top_n(r, ["instrument_id"], [F.desc("session_ix")], 10, "back")
    return r.select(*ID, "relationship_state", F.col("run_length").cast("bigint").alias("run_length"), "reaches_start")


@query("job_13_sector_rotation", f"""with {_REL}, a as (select *, rel5-{lag('rel5', 5)} as acc, case when rel20 is not null then dense_rank() over (partition by session_ix order by rel20 desc nulls last) end as peer_rank from rel),
 k as (select *, sign(rel5) as sg from a where rel5 is not null), f as (select *, case when lag(sg) {I}=sg or lag(sg) {I} is null then 0 else 1 end as fresh from k), g as (select *, sum(fresh) over (partition by instrument_id order by session_ix) as isle from f),
 h as (select {IDS}, row_number() over (partition by instrument_id, isle order by session_ix) as run_length from g)
 select a.instrument_id, a.session_ix, cast(peer_rank as bigint) as peer_rank, {R('rel20')} as rel20, {R('acc')} as acceleration, run_length, case when rel20 is null or acc is null then 'unavailable' when rel20=0 or acc=0 then 'neutral' when rel20>0 and acc>0 then 'leading_improving' when rel20>0 then 'leading_weakening' when acc>0 then 'lagging_improving' else 'lagging_weakening' end as posture
 from a left join h on h.instrument_id=a.instrument_id and h.session_ix=a.session_ix""")
def _(t):
    df = M.rotation(W.versus_benchmark(bars(t, "type"), bars(t, "market")))
    return df.select(*ID, F.col("peer_rank").cast("bigint").alias("peer_rank"), rnd("rel20").alias("rel20"), rnd("acceleration").alias("acceleration"), F.col("run_length").cast("bigint").alias("run_length"), "posture")
