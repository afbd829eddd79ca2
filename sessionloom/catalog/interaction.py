"""JOB-54: state-interaction screening of the factor catalog against the market-state vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.core import ORACLES, QUERIES, R, query
from sessionloom.catalog.sqltext import bars as B
from sessionloom.catalog.strategy import EVIDENCE, WARMUP, _LABELS
from sessionloom.functions.numeric import joined, rnd
from sessionloom.functions.staging import cut
from sessionloom.params import interaction as PI
from sessionloom.plans import interaction as IN
from sessionloom.plans import research as RS
from sessionloom.plans import strategy_statistics as ST
from sessionloom.sources.fixtures import bars

MINIMUM_INSTRUMENTS = 10


def interaction_summaries(t):
    b = cut(bars(t, "brand"))
    plan = RS.split_plan(b.select("session_ix").distinct(), warmup=WARMUP, horizon=5, purge=5, embargo=5).where("usable and split = 'development'")
    factors, states = QUERIES["job_46_factor_catalog"](t.spark, t.sf_dir), QUERIES["job_50_market_state_vector"](t.spark, t.sf_dir)
    ev = IN.evidence(factors, ST.outcomes(b, bars(t, "market"), EVIDENCE), cut(states), cut(plan.select("session_ix")), MINIMUM_INSTRUMENTS)
    return cut(IN.summaries(ev))


_STATE = {"as_defined": "{m}", "negated": "-{m}", "centred_share": "2*({m}-0.5)"}
_TARGET = {"lower": "rl", "upper": "ru", "complete_path": "case when state='observed_eod_exact' then adv end"}
_TALL = " union all ".join(f"select '{h}' as hypothesis, '{r}' as role, '{e}' as endpoint, horizon, session_ix, {f}*{sign} as x, {_TARGET[e]} as y, {_STATE[tr].format(m=m)} as state from fl" for h, (r, f, sign, m, tr) in PI.HYPOTHESES.items() for e in PI.ENDPOINTS[r])
_RANK = "rank() over (partition by hypothesis, horizon, endpoint, session_ix order by {c})+(count(*) over (partition by hypothesis, horizon, endpoint, session_ix, {c})-1)/2.0"
_W = ", ".join(f"max(lower) filter (blk={b}) as lower_{b}, max(p) filter (blk={b}) as p_{b}" for b in PI.BLOCKS)
_EVERY = ",".join(f"('{h}','{r}',{k},'{e}')" for h, (r, *_) in PI.HYPOTHESES.items() for k in PI.HORIZONS for e in PI.ENDPOINTS[r])
_SUMS = ("fx", "state"), ("fy", "ic"), ("fxx", "state*b.state"), ("fxy", "state*b.ic")
_I54 = f"""with fac as ({ORACLES['job_46_factor_catalog']}), sta as ({ORACLES['job_50_market_state_vector']}), {B('b', 'brand')}, {B('mk', 'market')}, {_LABELS},
 pl as (select session_ix from (select *, n//2 as v, n//2+n//4 as hh from (select session_ix, row_number() over (order by session_ix)-1 as i, count(*) over () as n from (select distinct session_ix from b))) where i<v and not (i<{WARMUP} or i+5>=n or (i>=v-5 and i<v+5) or (i>=hh-5 and i<hh+5))),
 fl as (select fac.*, lb.h as horizon, lb.state, case when state not like 'un%' then lo0-base end as rl, case when state not like 'un%' then up0-base end as ru, case when state not like 'un%' then lo_/eo-1 end as adv, sta.* exclude (session_ix) from fac join pl using (session_ix) join lb on lb.instrument_id=fac.instrument_id and lb.session_ix=fac.session_ix join sta on sta.session_ix=fac.session_ix),
 ta as (select * from ({_TALL}) where x is not null and y is not null), rk as (select *, {_RANK.format(c='x')} as rx, {_RANK.format(c='y')} as ry from ta),
 ic as (select hypothesis, role, horizon, endpoint, session_ix, any_value(state) as state, corr(rx,ry) as ic, count(*) as n from rk group by 1,2,3,4,5 having count(*)>={MINIMUM_INSTRUMENTS} and min(rx)<>max(rx) and min(ry)<>max(ry)),
 hf as (select session_ix, case when row_number() over (order by session_ix)<=count(*) over ()//2 then 'first' else 'second' end as half from pl),
 ev as (select ic.*, half, hypothesis||'|'||horizon||'|'||endpoint as trial from ic join hf using (session_ix) where state is not null),
 s0 as (select trial, count(*) as n, count(*) filter (half='first') as n_first, count(*) filter (half='second') as n_second, regr_slope(ic,state) as beta, regr_intercept(ic,state) as intercept, regr_slope(ic,state) filter (half='first') as first_beta, regr_slope(ic,state) filter (half='second') as second_beta, count(*) filter (state>0) as n_favourable, avg(ic) filter (state>0) as favourable_ic from ev group by 1),
 zs as (select e.trial, q.ask, e.state, e.ic, row_number() over (partition by e.trial, q.ask order by e.session_ix)-1 as j, count(*) over (partition by e.trial, q.ask) as n, least(q.ask, count(*) over (partition by e.trial, q.ask)) as blk from ev e, (values ({'),('.join(map(str, PI.BLOCKS))})) q(ask)),
 bs as (select a.trial, a.ask, a.j as s, {', '.join(f"sum(b.{x}) as {n}, sum(b.{x}) filter ((b.j-a.j+a.n)%a.n<a.n%a.blk) as t{n}" for n, x in _SUMS)} from zs a join zs b on b.trial=a.trial and b.ask=a.ask and (b.j-a.j+a.n)%a.n<a.blk group by 1,2,3),
 nn as (select trial, ask, any_value(n) as n, any_value(blk) as blk from zs group by 1,2),
 rp as (select trial, ask, n, blk, rep, k, ('0x'||substr(md5('interaction-v1|'||trial||'|'||rep||'|'||k),1,8))::bigint%n as s from (select *, unnest(range(0,(n+blk-1)//blk)) as k from nn), (select unnest(range({PI.REPLICATES})) as rep)),
 sm as (select p.trial, p.ask, rep, any_value(n) as n, {', '.join(f"sum(case when k<n//blk then {x} else t{x} end) as {x}" for x, _ in _SUMS)} from rp p join bs on bs.trial=p.trial and bs.ask=p.ask and bs.s=p.s group by 1,2,3),
 bt as (select sm.trial, ask as blk, case when sm.n*fxx-fx*fx>0 then (sm.n*fxy-fx*fy)/(sm.n*fxx-fx*fx) end as boot, beta from sm join s0 on s0.trial=sm.trial),
 bp as (select trial, blk, (count(*) filter (boot-beta>=beta)+1)/(count(*)+1) as p, quantile_cont(boot,0.1) as lower, count(boot)=count(*) as whole from bt group by 1,2), bw as (select trial, bool_and(whole) as whole, {_W} from bp group by 1),
 al as (select h.*, hypothesis||'|'||horizon||'|'||endpoint as trial from (values {_EVERY}) h(hypothesis, role, horizon, endpoint)),
 sy as (select al.*, coalesce(n,0) as n, coalesce(n_first,0) as n_first, coalesce(n_second,0) as n_second, case when role='candidate_alpha' then coalesce(n_favourable,0) end as n_favourable, coalesce(whole and beta is not null and first_beta is not null and second_beta is not null and n>=2,false) as ok, beta, intercept, first_beta, second_beta, favourable_ic, lower_10, p_10, lower_20, p_20
   from al left join s0 using (trial) left join bw using (trial)),
 su as (select hypothesis, role, horizon, endpoint, n, n_first, n_second, n_favourable, {', '.join(f"case when ok then {x} end as {x}" for x in ('intercept', 'beta', 'first_beta', 'second_beta', 'lower_10', 'p_10', 'lower_20', 'p_20'))}, case when ok and role='candidate_alpha' then favourable_ic end as favourable_ic,
   list_filter([case when n<{PI.MINIMUM_SESSIONS} then 'eligible_session_floor_not_met' end, case when n_first<{PI.MINIMUM_HALF} then 'first_half_session_floor_not_met' end, case when not ok then 'regression_unavailable' end, case when n_second<{PI.MINIMUM_HALF} then 'second_half_session_floor_not_met' end], lambda x: x is not null) as codes from sy)"""
NUMBERS = ["intercept", "beta", "first_beta", "second_beta", "lower_10", "p_10", "lower_20", "p_20", "favourable_ic"]


@query("job_54_interaction_summaries", f"{_I54} select hypothesis, role, cast(horizon as int) as horizon, endpoint, n, n_first, n_second, n_favourable, {', '.join(R(x, 5) + f' as {x}' for x in NUMBERS)}, array_to_string(codes,'|') as codes from su")
def _(t):
    s = interaction_summaries(t)
    return s.select("hypothesis", "role", "horizon", "endpoint", "n", "n_first", "n_second", "n_favourable", *[rnd(x, 5).alias(x) for x in NUMBERS], joined(F.col("codes")).alias("codes"))


@query("job_54_interaction_decisions", f"""{_I54}, p3 as (select *, role='candidate_alpha' as al, list_concat(codes, list_filter([case when coalesce(beta<=0,true) then 'interaction_beta_not_positive' end, case when coalesce(lower_10<=0,true) then 'primary_block_lower_bound_not_positive' end, case when coalesce(lower_20<=0,true) then 'sensitivity_block_lower_bound_not_positive' end,
   case when coalesce(first_beta<=0,true) then 'first_half_beta_not_positive' end, case when coalesce(second_beta<=0,true) then 'second_half_beta_not_positive' end, case when role='candidate_alpha' and n_favourable<{PI.MINIMUM_FAVOURABLE} then 'alpha_favorable_state_session_floor_not_met' end,
   case when role='candidate_alpha' and coalesce(favourable_ic<=0,true) then 'alpha_favorable_state_mean_rank_ic_not_positive' end], lambda x: x is not null)) as fs from su where horizon={PI.PRIMARY_HORIZON}),
 gd as (select hypothesis, role, count(*) as n_endpoints, coalesce(case when count(p_10+p_20)=count(*) then max(greatest(p_10,p_20)) end,1.0) as raw_p, case when count(beta)=count(*) then min(beta) end as worst_beta, case when count(lower_10+lower_20)=count(*) then min(least(lower_10,lower_20)) end as worst_lower, list_distinct(flatten(list(fs))) as fs from p3 group by 1,2),
 hs as (select *, least(1.0, raw_p*(count(*) over (partition by role)-row_number() over (partition by role order by raw_p, hypothesis)+1)) as st from gd), hm as (select *, max(st) over (partition by role order by raw_p, hypothesis rows unbounded preceding) as p_holm from hs),
 fd as (select *, list_sort(list_concat(fs, case when p_holm>{PI.ALPHA} then ['holm_familywise_gate_failed'] else [] end)) as failed from hm), tp as (select *, len(failed)=0 and row_number() over (partition by role, len(failed)=0 order by worst_beta desc, worst_lower desc, hypothesis)<=1 as top from fd)
 select hypothesis, role, n_endpoints, {R('raw_p', 5)} as raw_p, {R('p_holm', 5)} as p_holm, {R('worst_beta', 5)} as worst_beta, {R('worst_lower', 5)} as worst_lower, array_to_string(failed,'|') as failed,
  case when top and (role='candidate_alpha' or (select bool_or(top and role='candidate_alpha') from tp)) then 'selected_model_candidate' when len(failed)=0 then 'qualified_not_selected_cap' when list_has_any(failed, {list(PI.INCONCLUSIVE)}) then 'inconclusive_data' else 'rejected_screen' end as status from tp""")
def _(t):
    d = IN.decisions(interaction_summaries(t))
    return d.select("hypothesis", "role", "n_endpoints", *[rnd(x, 5).alias(x) for x in ("raw_p", "p_holm", "worst_beta", "worst_lower")], joined(F.col("failed")).alias("failed"), "status")
