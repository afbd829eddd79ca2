"""JOB-58 / JOB-59: strategy statistics over development, validation and holdout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.catalog.core import R, query
from sessionloom.catalog.market import _composite_sql
from sessionloom.catalog.sqltext import UNIVERSE, bars as B, cont, lag, ret, rows
from sessionloom.catalog.stages import market_states
from sessionloom.catalog.streams import _FOLD
from sessionloom.functions.numeric import rnd
from sessionloom.functions.staging import cut, shared_folder, stored
from sessionloom.operators import crosssection as X
from sessionloom.operators import windows as W
from sessionloom.params import strategy as PS
from sessionloom.plans import research as RS
from sessionloom.plans import strategy_stages as SG
from sessionloom.plans import strategy_statistics as ST
from sessionloom.sources.fixtures import bars, session_index, universe

ID = ["instrument_id", "session_ix"]
IDS = "instrument_id, session_ix"
WARMUP, EVIDENCE = 21, 1e6
FLOORS = (60, 20, 10)


def strategy_rows(t) -> DataFrame:
    """Signals and controls of the weekly panel under all combinations, with their split; months lag, so a week sees the state of the month before."""
    c = F.col
    b = stored(bars(t).select(*ID, "session_date", "open", "high", "low", "close", "volume"), "weeks")
    a = W.average_true_range(b).select(*ID, "session_date", "open", "high", "low", "close", W.simple_return(5).alias("x"), (c("close") > W.lagged("close", 1)).alias("above_prior_close"), (c("close") > W.lagged("high", 1)).alias("above_prior_high"),
                                       F.when(W.contiguous(6), (F.max("close").over(W.rows(5, 1)) - c("close")) / F.nullif("atr5_prior", F.lit(0.0))).alias("depth"), (c("volume") / W.lagged("volume", 1)).alias("volume_ratio"))
    measured = ["session_date", "x", "depth", "above_prior_close", "above_prior_high", "volume_ratio"]
    a = ST.outcomes(a, stored(bars(t, "market").select("session_ix", "open", "close"), "market"), EVIDENCE, measured)
    a = stored(a.where("x is not null and depth is not null and volume_ratio is not null"), "measured")
    a = X.percentile_0_100(a, "x", out="rs")
    plan = stored(RS.split_plan(b.select("session_ix").distinct(), warmup=WARMUP, horizon=5, purge=5, embargo=5).select("session_ix", "split", "usable"), "plan")
    states = stored(market_states(t).select(c("session_ix").alias("month_ix"), "regime"), "states")
    a = a.withColumn("month_ix", session_index(F.trunc("session_date", "month"), "month") - 1).join(states, "month_ix", "left").join(plan, "session_ix").where("usable").dropna(subset=ID)
    a = a.join(universe(t).withColumn("member", F.lit(True)), "instrument_id", "left").withColumn("member", F.coalesce("member", F.lit(False)))
    # an observation is stored once; its combinations and horizons are only spread where they are summed
    observed = stored(a.select(*ID, "split", "regime", "rs", "depth", "above_prior_close", "above_prior_high", "volume_ratio", "usable", "member", "labels"), "observed")
    rows_ = ST.cohorts(observed).where(c("role").isin("signal", "eligible_leader_control"))
    return rows_.select("split", "combo", (c("role") == "signal").alias("signal"), *ID, "regime", F.inline("labels"))


#: From ``b`` and ``mk`` to ``lb``: state and bounds of each bar and horizon.
_LABELS = f"""ex as (select {IDS}, h, case h when 1 then h1 when 3 then h3 else h5 end as hi_, case h when 1 then l1 when 3 then l3 else l5 end as lo_, session_ix+h as t_end from (select {IDS}, {', '.join(f"max(high) over (partition by instrument_id order by session_ix range between 1 following and {h} following) as h{h}, min(low) over (partition by instrument_id order by session_ix range between 1 following and {h} following) as l{h}" for h in PS.HORIZONS)} from b), (values (1),(3),(5)) z(h)),
 e0 as (select ex.*, e.open as eo, m1.open as mo, mx.close as mc from ex left join b e on e.instrument_id=ex.instrument_id and e.session_ix=ex.session_ix+1 left join mk m1 on m1.session_ix=ex.session_ix+1 left join mk mx on mx.session_ix=ex.t_end),
 e1 as (select e0.*, li.session_ix as ls, li.close as lc from e0 asof left join b li on li.instrument_id=e0.instrument_id and e0.t_end>=li.session_ix), e2 as (select e1.*, af.close as ac from e1 asof left join b af on af.instrument_id=e1.instrument_id and e1.t_end<af.session_ix),
 lb as (select *, mc/mo-1 as base, case when eo is null then 'unexecutable_no_next_open' when mc is null or mo is null then 'unavailable_evidence' when ls=t_end then 'observed_eod_exact' when ac is null then 'terminal_reference_exact' when greatest(lc,ac)>={EVIDENCE}*least(lc,ac) then 'unavailable_evidence' else 'terminal_reference_interval' end as state,
   case when ls=t_end or ac is null then lc else least(lc,ac) end/eo-1 as lo0, case when ls=t_end or ac is null then lc else greatest(lc,ac) end/eo-1 as up0 from e2)"""

_ROWS = f"""{B()}, {B('mk', 'market')}, {UNIVERSE}, rgs as (with recursive {_composite_sql()}, d as (select 1::bigint as universe_id, cast(session_ix as int) as session_ix, regime_score as score from cp), {_FOLD} select w.session_ix as m, conf from w join e on e.universe_id=w.universe_id and e.session_ix=w.session_ix),
 tr as (select *, case when {lag('close', 1)} is not null then greatest(high-low, abs(high-{lag('close', 1)}), abs(low-{lag('close', 1)})) end as tr from b),
 a as (select {IDS}, session_date, {ret(5)} as x, close>{lag('close', 1)} as pc, close>{lag('high', 1)} as pch, case when {cont(6)} then (max(close) {rows(5, 1)}-close)/nullif(case when count(tr) {rows(5, 1)}=5 then avg(tr) {rows(5, 1)} end,0) end as depth, volume/nullif({lag('volume', 1)},0) as vr from tr),
 k as (select * from a where x is not null and depth is not null and vr is not null), r as (select *, case when count(*) over (partition by session_ix, x)=count(*) over (partition by session_ix) then 50.0 else 100.0*(rank() over (partition by session_ix order by x)+(count(*) over (partition by session_ix, x)-1)/2.0-1)/(count(*) over (partition by session_ix)-1) end as rs from k),
 g as (select row_number() over (order by a.i, d.i, c.i, v.i)-1 as combo, a.f as floor_, d.lo, d.hi, c.high, v.cap from (values (0,80.0),(1,60.0)) a(i,f), (values (0,0.0,1.0),(1,1.0,3.0)) d(i,lo,hi), (values (0,false),(1,true)) c(i,high), (values (0,0.8),(1,1.0),(2,1.2)) v(i,cap)),
 pl as (select session_ix, case when i<v then 'development' when i<h then 'validation' else 'holdout' end as split from (select *, n//2 as v, n//2+n//4 as h from (select session_ix, row_number() over (order by session_ix)-1 as i, count(*) over () as n from (select distinct session_ix from b))) where not (i<{WARMUP} or i+5>=n or (i>=v-5 and i<v+5) or (i>=h-5 and i<h+5))),
 ob as (select r.*, split, conf as regime from r join pl using (session_ix) join u using (instrument_id) left join rgs on rgs.m=(year(session_date)-1995)*12+month(session_date)-1),
 {_LABELS},
 ro as (select split, combo, (depth between lo and hi and (case when high then pch else pc end) and vr<=cap) as sg, ob.session_ix, regime, h as horizon, state, case when state not like 'un%' then lo0 end as lower, case when state not like 'un%' then up0 end as upper, case when state not like 'un%' then lo0-base end as rl, case when state not like 'un%' then up0-base end as ru,
   case when state not like 'un%' then hi_/eo-1 end as fav, case when state not like 'un%' then lo_/eo-1 end as adv from ob join g on rs>=floor_ join lb on lb.instrument_id=ob.instrument_id and lb.session_ix=ob.session_ix)"""


def _summary_sql(source: str, seed: str, tag: str, exact: bool = False) -> str:
    """CTEs ending in ``sm_<tag>`` from rows like ``ro``."""
    n = lambda x: f"{x}_{tag}"
    state = "case when state='terminal_reference_interval' then 'unavailable_evidence' else state end" if exact else "state"
    keep = "state not like 'un%'" + (" and state<>'terminal_reference_interval'" if exact else "")
    sides = ", ".join(f"count(*) filter ({w}) as {p}_assigned, count(*) filter ({w} and {keep}) as {p}_n, sum(lower) filter ({w} and {keep}) as {p}_lower, sum(upper) filter ({w} and {keep}) as {p}_upper, "
                      + ", ".join(f"count(*) filter ({w} and {state}='{s}') as {p}_{s}" for s in PS.STATES) for p, w in (("s", "sg"), ("c", "not sg")))
    sums = ", ".join(f"cast(sum({p}_{x}) as bigint) as {p}_{x}" for p in "sc" for x in ("assigned", "n", *PS.STATES))
    regimes = ", ".join(f"cast(sum(case when regime='{r}' then s_n else 0 end) as bigint) as n_{r}, avg(contrast) filter (regime='{r}') as {r}_contrast" for r in PS.REGIMES)
    costs = ", ".join(f"count(*) filter (x>{2 * k / 10000}) as wins_{k}, sum(x-{2 * k / 10000}::double) filter (x>{2 * k / 10000}) as won_{k}, count(*) filter (x<{2 * k / 10000}) as losses_{k}, sum(x-{2 * k / 10000}::double) filter (x<{2 * k / 10000}) as lost_{k}" for k in PS.COSTS_BPS)
    scenarios = "('all_lower','lower','lower')" if exact else "('all_lower','lower','lower'),('all_upper','upper','upper'),('contrast_adverse','lower','upper')"
    return f"""{n('ce')} as (select combo, horizon, session_ix, max(regime) as regime, {sides} from {source} group by 1,2,3),
 {n('hf')} as (select session_ix, case when row_number() over (order by session_ix)<=count(*) over ()//2 then 'first' else 'second' end as half from (select distinct session_ix from {source})),
 {n('cs')} as (select c.*, half, scenario, mine as bound, case when s_n>0 and c_n>0 then case when mine='upper' then s_upper else s_lower end/s_n-case when theirs='upper' then c_upper else c_lower end/c_n end as contrast from {n('ce')} c join {n('hf')} using (session_ix), (values {scenarios}) z(scenario, mine, theirs)),
 {n('wd')} as (select combo, horizon, scenario, bound, {sums}, count(contrast) as paired_sessions, avg(contrast) as contrast, count(*) filter (contrast>0)/nullif(count(contrast),0) as positive_ratio, max(abs(contrast))/nullif(sum(abs(contrast)),0) as concentration,
   avg(contrast) filter (half='first') as first_half_contrast, avg(contrast) filter (half='second') as second_half_contrast, {regimes} from {n('cs')} group by 1,2,3,4),
 {n('w2')} as (select *, s_n>={FLOORS[0]} and c_n>={FLOORS[0]} and paired_sessions>={FLOORS[1]} as inference_available, list_min(list_filter([{','.join(f'n_{r}' for r in PS.REGIMES)}], lambda x: x>0)) as least_regime from {n('wd')}),
 {n('z2')} as (select c.combo||'|'||c.horizon||'|'||c.scenario as trial, row_number() over w-1 as j, c.contrast as v, count(*) over (partition by c.combo, c.horizon, c.scenario) as n, least(5, count(*) over (partition by c.combo, c.horizon, c.scenario)) as blk
   from {n('cs')} c join {n('w2')} using (combo, horizon, scenario) where c.contrast is not null and inference_available window w as (partition by c.combo, c.horizon, c.scenario order by c.session_ix)),
 {n('bs')} as (select a.trial, a.j as s, sum(b.v) as full_, sum(b.v) filter ((b.j-a.j+a.n)%a.n<a.n%a.blk) as tail_ from {n('z2')} a join {n('z2')} b on b.trial=a.trial and (b.j-a.j+a.n)%a.n<a.blk group by 1,2),
 {n('nn')} as (select trial, any_value(n) as n, any_value(blk) as blk, avg(v) as mean from {n('z2')} group by 1),
 {n('rp')} as (select trial, n, blk, mean, rep, k, ('0x'||substr(md5('{seed}|'||trial||'|'||rep||'|'||k),1,8))::bigint%n as s from (select *, unnest(range(0,(n+blk-1)//blk)) as k from {n('nn')}), (select unnest(range({PS.REPLICATES})) as rep)),
 {n('bt')} as (select p.trial, rep, any_value(mean) as mean, sum(case when k<n//blk then full_ else tail_ end)/any_value(n) as boot from {n('rp')} p join {n('bs')} b on b.trial=p.trial and b.s=p.s group by 1,2),
 {n('re')} as (select trial, quantile_cont(boot,0.05) as lower, quantile_cont(boot,0.95) as upper, (count(*) filter (boot-mean>=mean)+1)/(count(*)+1) as p_value from {n('bt')} group by 1),
 {n('sg')} as (select combo, horizon, bound, count(*) as sn, avg(x) as mean, median(x) as median, median(rel) as median_relative, avg(fav) as mean_favourable, avg(adv) as mean_adverse, count(fav) as n_excursions, {costs} from (select combo, horizon, fav, adv, unnest([{{'bound':'lower','x':lower,'rel':rl}},{{'bound':'upper','x':upper,'rel':ru}}], recursive:=true) from {source} where sg and {keep}) group by 1,2,3),
 {n('sm')} as (select w.*, lower, upper, p_value, mean, median, median_relative, mean_favourable, mean_adverse, n_excursions, coalesce(least_regime>={FLOORS[2]},false) as regime_floor_met, {', '.join(f"wins_{k}, won_{k}, losses_{k}, lost_{k}, wins_{k}/nullif(s_n,0) as win_rate_{k}, mean-{2 * k / 10000}::double as mean_net_{k}, median-{2 * k / 10000}::double as median_net_{k}, median_relative-{2 * k / 10000}::double as median_relative_net_{k}, won_{k}/nullif(-lost_{k},0) as profit_factor_{k}, (won_{k}/nullif(wins_{k},0))/nullif(-(lost_{k}/nullif(losses_{k},0)),0) as payoff_{k}" for k in PS.COSTS_BPS)}
   from {n('w2')} w left join {n('re')} e on e.trial=w.combo||'|'||w.horizon||'|'||w.scenario left join {n('sg')} s on s.combo=w.combo and s.horizon=w.horizon and s.bound=w.bound)"""


COUNTS = [f"{p}_{x}" for p in "sc" for x in ("assigned", "n", *PS.STATES)]
NUMBERS = ["contrast", "lower", "upper", "p_value", "positive_ratio", "concentration", "first_half_contrast", "second_half_contrast", *[f"{r}_contrast" for r in PS.REGIMES], "mean", "median", "median_relative", "mean_favourable", "mean_adverse",
           *[f"{x}_{k}" for k in PS.COSTS_BPS for x in ("mean_net", "median_net", "median_relative_net", "win_rate", "payoff", "profit_factor")]]
FLAGS = ["inference_available", "regime_floor_met"]


def _select(df: DataFrame, *more) -> DataFrame:
    return df.select(*more, "combo", "horizon", "scenario", *COUNTS, "paired_sessions", "least_regime", *FLAGS, *[rnd(x, 5).alias(x) for x in NUMBERS])


def _selected_sql(table: str, more: str = "") -> str:
    return f"select {more}cast(combo as int) as combo, horizon, scenario, {', '.join(COUNTS)}, paired_sessions, least_regime, {', '.join(FLAGS)}, {', '.join(R(x, 5) + f' as {x}' for x in NUMBERS)} from {table}"


_DEV = f"with {_ROWS}, rd as (select * from ro where split='development'), {_summary_sql('rd', 'development-v1', 'd')}"
_BEST = "row_number() over (partition by scenario order by lower desc, contrast desc, s_n desc, combo)"


def _development(t):
    return cut(ST.summaries(strategy_rows(t).where("split = 'development'"), FLOORS, "development-v1"))


@query("job_59_development_summaries", f"{_DEV} {_selected_sql('sm_d')}")
def _(t):
    return _select(_development(t))


@query("job_59_selection", f"""{_DEV}, p3 as (select * from sm_d where horizon=3), ft as (select * from p3 where inference_available and regime_floor_met and lower is not null and scenario in (select scenario from p3 where inference_available and regime_floor_met and lower is not null group by 1 having count(*)=24)),
 wn as (select * from (select *, {_BEST} as rn from ft) where rn=1), o1 as (select max(combo) filter (scenario='all_lower') as wl, max(combo) filter (scenario='all_upper') as wu, max(combo) filter (scenario='contrast_adverse') as wa, count(*) as nw, count(distinct combo) as nd, max(lower) filter (scenario='contrast_adverse') as ob, max(contrast) filter (scenario='contrast_adverse') as tb from wn),
 st as (select *, case when (select sum(s_unavailable_evidence+c_unavailable_evidence) from p3)>0 then 'blocked_unavailable_evidence' when nw<3 then 'inconclusive_evidence_floor' when nd>1 then 'rejected_endpoint_instability' else 'locked' end as status from o1),
 cm as (select combo from p3 where inference_available and s_n>=60 and c_n>=60 and paired_sessions>=20 and s_unavailable_evidence+c_unavailable_evidence=0 group by 1 having count(*)=3), w2 as (select * from (select *, {_BEST} as rn from p3 where combo in (select combo from cm)) where rn=1),
 s2 as (select count(*) as nw, count(distinct combo) as nd, (select count(*) from p3 where s_unavailable_evidence+c_unavailable_evidence>0) as nb from w2), ad as (select * from w2 where scenario='contrast_adverse'),
 gt as ({' union all '.join(f"select {i} as gate_order, '{gname}' as gate, combo, cast({m} as double) as value, coalesce({m}{op}{th},false) as passed from ad" for i, (gname, m, op, th) in enumerate(PS.ROBUSTNESS_GATES))}),
 gn as (select unnest(range(6)) as gate_order, unnest([{','.join("'" + x[0] + "'" for x in PS.ROBUSTNESS_GATES)}]) as gate),
 gs as (select gn.gate, gt.combo, value, passed, case when nb>0 then 'blocked_source_evidence' when nw=0 then 'rejected_no_common_eligible' when nd>1 then 'rejected_endpoint_instability' when (select bool_and(passed) from gt) then 'locked' else 'rejected_robustness_gates' end as status from gn left join gt using (gate_order), s2)
 select 'development' as step, 'lock' as gate, status, cast(case when status='locked' then wa end as int) as winner, {R('ob', 5)} as value, cast(null as boolean) as passed from (select status, wa, case when status='locked' then ob end as ob from st)
 union all select 'replacement', gate, status, cast(case when status in ('locked','rejected_robustness_gates') then combo end as int), {R("case when status in ('locked','rejected_robustness_gates') then value end", 5)}, case when status in ('locked','rejected_robustness_gates') then passed end from gs""")
def _(t):
    table = _development(t)
    d = ST.development_selection(table).select(F.lit("development").alias("step"), F.lit("lock").alias("gate"), "status", F.col("selected").alias("winner"), rnd("objective", 5).alias("value"), F.lit(None).cast("boolean").alias("passed"))
    g = ST.replacement_selection(table, (60, 20)).select(F.lit("replacement").alias("step"), "gate", "status", "winner", rnd("value", 5).alias("value"), "passed")
    return d.unionByName(g)


_LOCK = "lk as (select combo, lower, contrast from sm_d where horizon=3 and inference_available and lower is not null order by lower desc, contrast desc, s_n desc, combo limit 1)"
_STAGES_SQL = f"with {_ROWS}, rd as (select * from ro where split='development'), rv as (select * from ro where split='validation'), {_summary_sql('rd', 'development', 'd', True)}, {_summary_sql('rv', 'validation', 'v', True)}, {_LOCK}"


def _stages(t):
    """Summaries of each stage that the locks open, and the gates of the later ones."""
    rows_, root = strategy_rows(t), shared_folder(t.spark, "strategy")
    of = lambda split: lambda: rows_.where(F.col("split") == split)
    tables = {"development": SG.run_development(of("development")(), root, "pullback", FLOORS)}
    gates = {}
    for stage, run in (("validation", SG.run_validation), ("holdout", SG.run_holdout)):
        try:
            tables[stage], gates[stage] = run(of(stage), t.spark, root, "pullback", FLOORS)
        except SG.StageLocked:
            break
    return tables, gates


@query("job_58_stage_summaries", f"{_STAGES_SQL} {_selected_sql('sm_d', chr(39) + 'development' + chr(39) + ' as stage, ')} union all {_selected_sql('sm_v', chr(39) + 'validation' + chr(39) + ' as stage, ')} where exists (select 1 from lk)")
def _(t):
    tables, _ = _stages(t)
    return reduce(DataFrame.unionByName, [_select(x, F.lit(k).alias("stage")) for k, x in tables.items()])


@query("job_58_stage_gates", f"""{_STAGES_SQL}, v3 as (select *, coalesce(s_n/nullif(s_assigned,0),0) as sc_, coalesce(c_n/nullif(c_assigned,0),0) as cc_ from sm_v where horizon=3), hm as (select combo, max(st) over (order by p_value, combo) as adj from (select combo, p_value, least(1.0, p_value*((select count(*) from v3)-row_number() over (order by p_value, combo)+1)) as st from v3 where p_value is not null)),
 me as (select v3.*, adj from v3 left join hm using (combo) where combo=(select combo from lk)), gt as (
  select 'complete_validation_family_evidence' as gate, (select count(*) filter (inference_available and sc_=1 and cc_=1)/24 from v3) as value, (select count(*) filter (inference_available and sc_=1 and cc_=1) from v3)=24 as ok from me
  union all select 'familywise_adjusted_parameter_evidence', adj, adj<=0.10 from me union all select 'net_primary_median_positive', median_relative_net_25, median_relative_net_25>0 from me union all select 'regime_observation_floor', least_regime, least_regime>={FLOORS[2]} from me)
 select 'development' as stage, 'lock' as gate, {R('lower', 5)} as value, 'pass' as outcome, cast(combo as int) as combo from lk
 union all select 'validation', gate, {R('value', 5)}, case when value is null then 'inconclusive' when ok then 'pass' else 'fail' end, cast((select combo from lk) as int) from gt""")
def _(t):
    tables, gates = _stages(t)
    lock = ST.development_lock(tables["development"])
    out = lock.select(F.lit("development").alias("stage"), F.lit("lock").alias("gate"), rnd("objective", 5).alias("value"), F.lit("pass").alias("outcome"), "combo")
    for stage, g in gates.items():
        out = out.unionByName(g.select(F.lit(stage).alias("stage"), "gate", rnd("value", 5).alias("value"), "outcome", lock.select("combo").scalar().alias("combo")))
    return out
