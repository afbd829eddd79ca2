"""JOB-53: the screening chain over the factor panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.aggregates import FACTORS, FACTOR_SQL, factor_panel
from sessionloom.catalog import qualification as Q
from sessionloom.catalog.core import R, query
from sessionloom.catalog.qualification import _FP as _QFP
from sessionloom.functions.numeric import rnd
from sessionloom.plans import qualification, screening as P

HORIZONS, REPLICATES, BLOCK, SEED, COST = (1, 3), 2000, 5, "screen-v1", 0.002
FLOORS = dict(n_sessions=40, mean_ic=0.0, positive_share=0.5, p_holm=0.1)
_I = "over (partition by instrument_id order by session_ix)"
_RK = "rank() over (partition by trial, session_ix order by {c}) + (count(*) over (partition by trial, session_ix, {c})-1)/2.0"
_ONE = " union all ".join(f"select '{f}|{h}' as trial, session_ix, instrument_id, {f} as factor, t{h} as target from tg where {f} is not null and t{h} is not null" for f in FACTORS for h in HORIZONS)


@query("job_53_factor_screening", f"""with {FACTOR_SQL}, cl as (select instrument_id, session_ix, close from b), tx as (select instrument_id, session_ix, {', '.join(f"case when lead(session_ix,{h}) {_I}-session_ix={h} then lead(close,{h}) {_I}/close-1 end as t{h}" for h in HORIZONS)} from cl),
 tg as (select fp.*, {', '.join(f't{h}' for h in HORIZONS)} from fp join tx on tx.instrument_id=fp.instrument_id and tx.session_ix=fp.session_ix), ta as ({_ONE}),
 rk as (select *, {_RK.format(c='factor')} as x, {_RK.format(c='target')} as y, count(*) over (partition by trial, session_ix) as ng from ta), ics as (select trial, session_ix, corr(x,y) as ic from rk group by 1,2 having count(*)>=2 and min(x)<>max(x) and min(y)<>max(y)),
 st as (select trial, count(*) as n_sessions, avg(ic) as mean_ic, stddev_samp(ic) as sd, avg((ic>0)::int) as positive_share from ics where ic is not null group by 1),
 z as (select trial, row_number() over (partition by trial order by session_ix)-1 as j, ic, count(*) over (partition by trial) as n, avg(ic) over (partition by trial) as mean from ics where ic is not null),
 bs as (select a.trial, a.j as s, sum(b.ic) as full_, sum(b.ic) filter ((b.j-a.j+a.n)%a.n < a.n%{BLOCK}) as tail_ from z a join z b on a.trial=b.trial and (b.j-a.j+a.n)%a.n<{BLOCK} group by 1,2),
 nn as (select trial, any_value(n) as n, any_value(mean) as mean from z group by 1),
 rp as (select trial, r.range as rep, k.k, n, mean, ('0x'||substr(md5('{SEED}|'||trial||'|'||r.range||'|'||k.k),1,8))::bigint%n as s from nn, range({REPLICATES}) r, lateral (select unnest(range(0, (n+{BLOCK - 1})//{BLOCK})) as k) k),
 bt as (select rp.trial, rep, any_value(mean) as mean, sum(case when k<n//{BLOCK} then full_ else tail_ end)/any_value(n) as boot from rp join bs on bs.trial=rp.trial and bs.s=rp.s group by 1,2),
 pv as (select trial, (count(*) filter (boot-mean>=mean)+1)/(count(*)+1) as p_value from bt group by 1),
 bk as (select trial, session_ix, least(4, floor((x-1)*5/ng)) as bucket, avg(target) as m from rk group by 1,2,3), en as (select trial, session_ix, max(m) filter (bucket=4)-max(m) filter (bucket=0) as spread from bk group by 1,2),
 sp as (select trial, avg(spread)-{COST} as net_spread from en group by 1),
 jn as (select st.*, p_value, net_spread, least(1.0, p_value*(count(*) over ()-row_number() over (order by p_value, st.trial)+1)) as step from st join pv on pv.trial=st.trial left join sp on sp.trial=st.trial),
 hm as (select *, max(step) over (order by p_value, trial rows unbounded preceding) as p_holm, case when sd>0 then mean_ic/sd end as ir from jn),
 fl as (select *, list_sort(list_filter([case when n_sessions<{FLOORS['n_sessions']} then 'too_few_sessions' end, case when mean_ic<{FLOORS['mean_ic']} then 'mean_ic_below_floor' end, case when positive_share<{FLOORS['positive_share']} then 'sign_unstable' end,
   case when p_holm>{FLOORS['p_holm']} then 'not_significant_after_holm' end, case when coalesce(net_spread<=0,true) then 'no_spread_after_costs' end], lambda x: x is not null)) as failed from hm)
 select trial, n_sessions, {R('mean_ic')} as mean_ic, {R('ir')} as ir, {R('positive_share')} as positive_share, {R('p_value')} as p_value, {R('p_holm')} as p_holm, {R('net_spread')} as net_spread, array_to_string(failed,'|') as failed, case when len(failed)=0 then 'selected' else 'rejected' end as decision from fl""")
def _(t):
    panel = factor_panel(t, "close").dropna(subset=qualification.ID)
    s = P.screened(P.trials(panel, FACTORS, HORIZONS), REPLICATES, BLOCK, SEED, COST, FLOORS)
    return s.select("trial", "n_sessions", *[rnd(c).alias(c) for c in ("mean_ic", "ir", "positive_share", "p_value", "p_holm", "net_spread")], "failed", "decision")


#: The registered protocol: factor, role, related group, direction; f_ret20 is the control
REGISTRY = {"f_ret5": ("candidate_alpha", "reversal", -1), "f_volume": ("candidate_alpha", "activity", 1), "f_dollar": ("candidate_alpha", "activity", 1), "f_gain": ("candidate_alpha", "session", 1), "f_range": ("risk_guard", "variation", -1)}
PRIMARY, DECAY, MINIMUM, DRAWS, SCREEN_SEED = 3, (1, 5), 30, 10000, "screen-v2"
#: Fixed thresholds; the session floors are lowered for the test tables
GATES = dict(mean_ic=0.015, partial_ic=0.005, positive_share=0.55, largest_share=0.15, monotonic=0.8, decay=-0.01, alpha=0.05, sessions=50, half=24)
CAPS = dict(candidate_alpha=2, risk_guard=1)
_HS = (1, 3, 5)
_OK = lambda h: f"lead(session_ix,{h}) {_I}-session_ix={h}"
_LOWS = lambda h: "least(" + ",".join(f"lead(low,{i}) {_I}" for i in range(1, h + 1)) + ")"
_MID = "rank() over (partition by trial, session_ix order by {c}) + (count(*) over (partition by trial, session_ix, {c})-1)/2.0"
_HR = f"""{_QFP}, tx as (select b.instrument_id, b.session_ix, {', '.join(f"case when {_OK(h)} then lead(close,{h}) {_I}/lead(open,1) {_I}-1 end as r{h}, case when {_OK(h)} then {_LOWS(h)}/lead(open,1) {_I}-1 end as m{h}" for h in _HS)} from b),
 tg as (select fp.*, {', '.join(f'r{h}, m{h}' for h in _HS)} from fp join tx on tx.instrument_id=fp.instrument_id and tx.session_ix=fp.session_ix),
 ta as ({' union all '.join(f"select '{f}|{h}' as trial, session_ix, instrument_id, {f}*{sign} as factor, {'m' if role == 'risk_guard' else 'r'}{h} as target, f_ret20 as control from tg where {f} is not null and {'m' if role == 'risk_guard' else 'r'}{h} is not null" for f, (role, _, sign) in REGISTRY.items() for h in _HS)}),
 rk as (select *, {_MID.format(c='factor')} as x, {_MID.format(c='target')} as y, count(*) over (partition by trial, session_ix) as ng from ta),
 ics as (select trial, session_ix, {R('corr(x,y)', 12)} as ic from rk group by 1,2 having count(*)>={MINIMUM} and min(x)<>max(x) and min(y)<>max(y)),
 pk as (select *, {_MID.format(c='factor')} as x, {_MID.format(c='target')} as y, {_MID.format(c='control')} as z from ta where control is not null),
 pc as (select trial, session_ix, corr(x,y) as xy, corr(x,z) as xz, corr(y,z) as yz from pk group by 1,2 having count(*)>={MINIMUM} and min(x)<>max(x) and min(y)<>max(y) and min(z)<>max(z)),
 se as (select trial||'|standalone' as series, session_ix, ic from ics union all select trial||'|partial', session_ix, {R('(xy-xz*yz)/sqrt((1-xz*xz)*(1-yz*yz))', 12)} from pc where (1-xz*xz)*(1-yz*yz)>1e-12),
 z as (select series, row_number() over (partition by series order by session_ix)-1 as j, ic, count(*) over (partition by series) as n, least({BLOCK}, count(*) over (partition by series)) as bl, avg(ic) over (partition by series) as mean from se),
 bs as (select a.series, a.j as s, sum(b.ic) as full_, sum(b.ic) filter ((b.j-a.j+a.n)%a.n < a.n%a.bl) as tail_ from z a join z b on a.series=b.series and (b.j-a.j+a.n)%a.n<a.bl group by 1,2),
 nn as (select series, any_value(n) as n, any_value(bl) as bl, any_value(mean) as mean from z group by 1),
 rp as (select series, r.range as rep, k.k, n, bl, mean, ('0x'||substr(md5('{SCREEN_SEED}|'||series||'|'||r.range||'|'||k.k),1,8))::bigint%n as s from nn, range({DRAWS}) r, lateral (select unnest(range(0, (n+bl-1)//bl)) as k) k),
 bt as (select rp.series, rep, any_value(mean) as mean, sum(case when k<n//bl then full_ else tail_ end)/any_value(n) as boot from rp join bs on bs.series=rp.series and bs.s=rp.s group by 1,2),
 bo as (select series, any_value(mean) as mean, quantile_cont(boot,0.05) as lower, quantile_cont(boot,0.95) as upper, (count(*) filter (boot-mean>=mean)+1)/(count(*)+1) as p_value from bt group by 1),
 hv as (select *, row_number() over (partition by trial order by session_ix)<=count(*) over (partition by trial)//2 as first_ from ics),
 st as (select trial, count(*) as n_sessions, avg((ic>0)::int) as positive_share, case when sum(abs(ic))>0 then max(abs(ic))/sum(abs(ic)) else 0.0 end as largest_share, count(*) filter (first_) as first_half, avg(ic) filter (first_) as first_mean, count(*) filter (not first_) as second_half, avg(ic) filter (not first_) as second_mean from hv group by 1),
 bk as (select trial, session_ix, least(4, floor((x-1)*5/ng)) as bucket, avg(target) as m from rk semi join ics using (trial, session_ix) group by 1,2,3), bw as (select trial, session_ix from bk group by 1,2 having count(*)=5),
 bm as (select trial, bucket, avg(m) as m, count(*) as n from bk semi join bw using (trial, session_ix) group by 1,2), br as (select *, rank() over (partition by trial order by m)+(count(*) over (partition by trial, m)-1)/2.0 as rk from bm),
 bu as (select trial, max(n) as bucket_sessions, max(m) filter (bucket=4)-max(m) filter (bucket=0) as spread, case when min(rk)<>max(rk) then corr(bucket,rk) end as monotonic from br group by 1),
 hr as (select st.*, a.mean as mean_ic, a.lower, a.upper, a.p_value, p.mean as partial_mean_ic, p.lower as partial_lower, p.upper as partial_upper, p.p_value as partial_p_value, (select count(*) from se where series=st.trial||'|partial') as partial_sessions, coalesce(bucket_sessions,0) as bucket_sessions, spread, monotonic
  from st left join bo a on a.series=st.trial||'|standalone' left join bo p on p.series=st.trial||'|partial' left join bu on bu.trial=st.trial)"""
_NUM = ["mean_ic", "lower", "upper", "p_value", "partial_mean_ic", "partial_lower", "partial_upper", "partial_p_value", "positive_share", "largest_share", "first_mean", "second_mean", "spread", "monotonic"]
_INT = ["n_sessions", "first_half", "second_half", "partial_sessions", "bucket_sessions"]
_FAIL = [("mean_ic>={mean_ic}", "primary_mean_rank_ic"), ("lower>0", "primary_rank_ic_lower_bound"), ("partial_mean_ic>={partial_ic}", "incremental_mean_partial_rank_ic"), ("partial_lower>0", "incremental_partial_rank_ic_lower_bound"),
         ("positive_share>={positive_share}", "positive_session_share"), ("largest_share<={largest_share}", "session_contribution_concentration"), ("first_mean>0", "first_half_direction"), ("second_mean>0", "second_half_direction"),
         ("monotonic>={monotonic}", "bucket_monotonicity"), ("spread>0", "bucket_top_minus_bottom"), ("(nd=2 and dec>={decay})", "decay_direction"), ("p_holm<={alpha}", "holm_familywise_significance")]


def _results(t):
    panel = Q.panel(t, "open", "low", "close").dropna(subset=qualification.ID)
    return P.horizon_results(P.paths(panel, REGISTRY, "f_ret20", _HS), MINIMUM, DRAWS, BLOCK, SCREEN_SEED)


@query("job_53_horizon_results", f"with {_HR} select trial, {', '.join(_INT)}, {', '.join(f'{R(c)} as {c}' for c in _NUM)} from hr")
def _(t):
    return _results(t).select("trial", *[F.col(c).cast("long").alias(c) for c in _INT], *[rnd(c).alias(c) for c in _NUM])


@query("job_53_screening_decisions", f"""with {_HR}, rg(factor_id, role, related) as (values {','.join(f"('{f}','{r}','{g}')" for f, (r, g, _) in REGISTRY.items())}),
 lt as (select split_part(trial,'|',1) as factor_id, count(mean_ic) as nd, min(mean_ic) as dec from hr where split_part(trial,'|',2) in ('1','5') group by 1),
 pm as (select rg.*, hr.* exclude (trial), nd, dec, greatest(p_value, partial_p_value) as raw, least(mean_ic, partial_mean_ic) as effect, least(lower, partial_lower) as bound from rg left join hr on hr.trial=rg.factor_id||'|{PRIMARY}' left join lt on lt.factor_id=rg.factor_id),
 hl as (select *, max(step) over (partition by role order by coalesce(raw,1.0), factor_id rows unbounded preceding) as p_holm from (select *, least(1.0, coalesce(raw,1.0)*(count(*) over (partition by role)-row_number() over (partition by role order by coalesce(raw,1.0), factor_id)+1)) as step from pm)),
 fl as (select *, list_sort(list_filter([{', '.join(f"case when not coalesce({e.format(**GATES)},false) then '{n}' end" for e, n in _FAIL)}], lambda x: x is not null)) as failed,
  coalesce(n_sessions,0)<{GATES['sessions']} or coalesce(first_half,0)<{GATES['half']} or coalesce(second_half,0)<{GATES['half']} or coalesce(partial_sessions,0)<{GATES['sessions']} as thin from hl),
 ok as (select * from fl where len(failed)=0 and not thin),
 al as (select factor_id, related from (select * from ok where role='candidate_alpha' qualify row_number() over (partition by related order by effect desc, bound desc, factor_id)=1) qualify row_number() over (order by effect desc, bound desc, factor_id)<={CAPS['candidate_alpha']}),
 gd as (select factor_id from ok where role='risk_guard' and exists (select 1 from al) and related not in (select related from al) order by effect desc, bound desc, factor_id limit {CAPS['risk_guard']})
 select factor_id, role, related, case when thin then 'inconclusive_data' when len(failed)>0 then 'rejected_screen' when factor_id in (select factor_id from al union all select factor_id from gd) then 'selected_model_candidate' else 'qualified_not_selected_cap' end as status,
  {R('raw')} as raw, {R('p_holm')} as p_holm, {R('effect')} as effect, {R('bound')} as bound, array_to_string(failed,'|') as failed from fl""")
def _(t):
    d = P.screening_decisions(_results(t), REGISTRY, PRIMARY, DECAY, GATES, CAPS)
    return d.select("factor_id", "role", "related", "status", *[rnd(c).alias(c) for c in ("raw", "p_holm", "effect", "bound")], "failed")
