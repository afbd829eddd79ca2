"""JOB-48: factor diagnostics, pair report and qualification decisions; the SQL reads the panel, the queries merged blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.aggregates import _pair_sql
from sessionloom.catalog.core import R, query
from sessionloom.catalog.sqltext import bars as B, ret
from sessionloom.functions.numeric import rnd
from sessionloom.operators import windows as W
from sessionloom.plans import qualification as Q
from sessionloom.sources.fixtures import bars, session_range

#: factor: role, related group, priority within it
REGISTRY = {"f_ret5": ("candidate_alpha", "trend", 1), "f_ret20": ("candidate_alpha", "trend", 2), "f_range": ("risk_guard", "variation", 1), "f_span": ("risk_guard", "variation", 2),
            "f_volume": ("applicability_input", "volume", 1), "f_dollar": ("applicability_input", "turnover", 1), "f_gain": ("setup_conditioner", "trend", 3)}
FACTORS = list(REGISTRY)
MINIMUM = 30
FLOORS = dict(availability=0.9, sessions=50, half=24, distinct=100, ties=0.95, alphas=2)
RULE = dict(sessions=40, correlation=0.9, share=0.8, sign=0.9)
QS = ("p01", "p05", "p25", "p50", "p75", "p95", "p99")
_PAIRS = [(a, b) for i, a in enumerate(FACTORS) for b in FACTORS[i + 1:]]
_X = ["session", "instrument"]
_C = ["n_parts", "max_share", "top_share", "herfindahl"]


def panel(t, *prices: str):
    """Monthly bars with the registered factors, and further columns of the bars."""
    b = bars(t, grain="month")
    return b.select(*Q.ID, W.simple_return(5).alias("f_ret5"), W.simple_return(20).alias("f_ret20"), (F.col("high") / F.col("low")).alias("f_range"), (F.col("high") / F.col("low") - 1).alias("f_span"),
                    F.col("volume").cast("double").alias("f_volume"), (F.col("close") * F.col("volume")).alias("f_dollar"), (F.col("close") > F.col("open")).cast("double").alias("f_gain"), *prices)


def state(t):
    """The calendar folded as two blocks, history and the sessions after it, and merged."""
    p, (first, last) = panel(t), session_range(t)
    cut = first + 3 * (last - first) // 4
    return Q.merged([Q.fold(p.where(F.col("session_ix") <= cut), FACTORS, MINIMUM, "history"), Q.fold(p.where(F.col("session_ix") > cut), FACTORS, MINIMUM, "since")])


_FP = f"""{B(grain='month')}, fp as (select instrument_id, session_ix, {ret(5)} as f_ret5, {ret(20)} as f_ret20, high/low as f_range, high/low-1 as f_span, volume::double as f_volume, close*volume as f_dollar, case when close>open then 1.0 when close<=open then 0.0 end as f_gain from b)"""
_TL = "tl as (" + " union all ".join(f"select '{f}' as factor_id, instrument_id, session_ix, {f}::double as value from fp" for f in FACTORS) + ")"
_CV = f"""{_TL}, ss as (select factor_id, session_ix, count(*) as expected, count(value) as available, count(value)-count(distinct value) as ties from tl group by 1,2),
 hv as (select *, (row_number() over (partition by factor_id order by session_ix)-1)*2+1 < count(*) over (partition by factor_id) as first_ from ss),
 cv as (select factor_id, sum(expected)::bigint as expected, sum(available)::bigint as available, count(*) filter (available>={MINIMUM}) as eligible_sessions, count(*) filter (available>={MINIMUM} and first_) as first_half,
  count(*) filter (available>={MINIMUM} and not first_) as second_half, sum(ties)::bigint as tie_excess, sum(available)/nullif(sum(expected),0) as availability, sum(ties)/nullif(sum(available),0) as tie_rate from hv group by 1)"""
_DS = """dq as (select factor_id, quantile_cont(value,[0.01,0.05,0.25,0.5,0.75,0.95,0.99]) as q from tl where value is not null group by 1),
 ds as (select factor_id, any_value(q) as q, min(value) as lowest, max(value) as highest, count(distinct value) as n_distinct, avg(case when value<q[3]-3*(q[5]-q[3]) or value>q[5]+3*(q[5]-q[3]) then 1.0 else 0.0 end) as outlier_rate from tl join dq using (factor_id) where value is not null group by 1)"""
_PR = f"""pr as ({' union all '.join(_pair_sql(a, b) for a, b in _PAIRS)}), pe as (select split_part(pair_id,'/',1) as left_id, split_part(pair_id,'/',2) as right_id, n, rho from pr where n>={MINIMUM} and rho is not null and not isnan(rho)),
 pn(left_id, right_id) as (values {','.join(f"('{a}','{b}')" for a, b in _PAIRS)}),
 ps as (select left_id, right_id, count(rho) as n_sessions, coalesce(sum(n),0)::bigint as n_shared, sum(rho*n)/sum(n) as weighted_mean, quantile_cont(rho,0.05) as p05, quantile_cont(rho,0.5) as median, quantile_cont(rho,0.95) as p95,
  count(*) filter (abs(rho)>={RULE['correlation']}) as n_high, count(*) filter (rho>0) as n_positive, count(*) filter (rho<0) as n_negative from pn left join pe using (left_id, right_id) group by 1,2),
 pp as (select *, n_high/nullif(n_sessions,0) as high_share, greatest(n_positive,n_negative)/nullif(n_positive+n_negative,0) as sign_share from ps),
 pf as (select *, coalesce(n_sessions>={RULE['sessions']} and high_share>={RULE['share']} and sign_share>={RULE['sign']}, false) as near_duplicate from pp)"""


def _axis(axis: str) -> str:
    key = f"{axis}_{'ix' if axis == 'session' else 'id'}"
    return f"""c_{axis} as (select factor_id, count(*) as n_parts, max(n)/any_value(tot) as max_share, sum(n) filter (rn<=10)/any_value(tot) as top_share, sum(n*n)/any_value(tot)/any_value(tot) as herfindahl from
  (select *, row_number() over (partition by factor_id order by n desc, k) as rn, sum(n) over (partition by factor_id) as tot from (select factor_id, {key} as k, count(value) as n from tl where value is not null group by 1,2)) group by 1)"""


@query("job_48_factor_diagnostics", f"""with {_FP}, {_CV}, {_DS}, {_axis('session')}, {_axis('instrument')}
 select cv.factor_id, expected, available, eligible_sessions, first_half, second_half, cv.tie_excess, n_distinct, {R('availability')} as availability, {R('tie_rate')} as tie_rate, {', '.join(f"{R(f'q[{i + 1}]')} as {q}" for i, q in enumerate(QS))}, {R('lowest')} as lowest, {R('highest')} as highest, {R('outlier_rate')} as outlier_rate,
  {', '.join(f"c_{a}.n_parts as {a}_n_parts, " + ', '.join(f"{R(f'c_{a}.{c}', 8)} as {a}_{c}" for c in _C[1:]) for a in _X)}
 from cv left join ds on ds.factor_id=cv.factor_id left join c_session on c_session.factor_id=cv.factor_id left join c_instrument on c_instrument.factor_id=cv.factor_id""")
def _(t):
    d = Q.diagnostics(state(t), MINIMUM)
    return d.select("factor_id", "expected", "available", "eligible_sessions", "first_half", "second_half", "tie_excess", "n_distinct", *[rnd(c).alias(c) for c in ("availability", "tie_rate", *QS, "lowest", "highest", "outlier_rate")],
                    *[x for a in _X for x in (f"{a}_n_parts", *[rnd(f"{a}_{c}", 8).alias(f"{a}_{c}") for c in _C[1:]])])


@query("job_48_factor_pairs", f"""with {_FP}, {_PR} select left_id, right_id, n_sessions, n_shared, {', '.join(f'{R(c)} as {c}' for c in ('weighted_mean', 'p05', 'median', 'p95', 'high_share', 'sign_share'))},
 n_high, n_positive, n_negative, n_sessions-n_positive-n_negative as n_zero, near_duplicate from pf""")
def _(t):
    p = Q.pair_report(state(t), FACTORS, RULE)
    return p.select("left_id", "right_id", "n_sessions", "n_shared", *[rnd(c).alias(c) for c in ("weighted_mean", "p05", "median", "p95", "high_share", "sign_share")], "n_high", "n_positive", "n_negative", "n_zero", "near_duplicate")


@query("job_48_factor_qualification", f"""with recursive {_FP}, {_CV}, {_PR}, dd as (select factor_id, count(distinct value) as n_distinct from tl group by 1),
 rg(factor_id, ix, role, related, priority) as (values {','.join(f"('{f}',{i},'{r}','{g}',{k})" for i, (f, (r, g, k)) in enumerate(REGISTRY.items()))}),
 nd as (select l.factor_id as a, r.factor_id as b, l.ix as ai, r.ix as bi, l.related=r.related as within_, (l.priority,l.factor_id)<(r.priority,r.factor_id) as keeps_a from pf join rg l on l.factor_id=left_id join rg r on r.factor_id=right_id where near_duplicate),
 rep as (select factor_id, kept as repeats from (select *, row_number() over (partition by factor_id order by ai desc, bi desc) as rn from (select case when keeps_a then b else a end as factor_id, case when keeps_a then a else b end as kept, ai, bi from nd where within_)) where rn=1),
 reach as (select factor_id as f, ix as seen from rg union select e.f, n2.other from reach e join (select a as f0, ai as i0, bi as other from nd union all select b, bi, ai from nd) n2 on n2.i0=e.seen),
 comp as (select f as factor_id, min(seen) as lowest from reach group by 1),
 ac as (select coalesce(string_agg(a||'/'||b, '|' order by a||'/'||b),'') as across_groups from nd where not within_),
 dc as (select rg.*, repeats, array_to_string(list_sort(list_filter([case when coalesce(availability,0)<{FLOORS['availability']} then 'availability_below_floor' end, case when coalesce(eligible_sessions,0)<{FLOORS['sessions']} then 'eligible_sessions_below_floor' end,
   case when coalesce(first_half,0)<{FLOORS['half']} then 'first_half_sessions_below_floor' end, case when coalesce(second_half,0)<{FLOORS['half']} then 'second_half_sessions_below_floor' end, case when coalesce(n_distinct,0)<{FLOORS['distinct']} then 'distinct_values_below_floor' end,
   case when coalesce(tie_rate,0)>{FLOORS['ties']} then 'same_session_ties_above_ceiling' end, case when repeats is not null then 'lower_priority_within_group_near_duplicate' end], lambda x: x is not null)),'|') as failed
  from rg left join cv on cv.factor_id=rg.factor_id left join dd on dd.factor_id=rg.factor_id left join rep on rep.factor_id=rg.factor_id),
 al as (select count(*) filter (failed='' and role='candidate_alpha') as alphas from dc)
 select dc.factor_id, dc.role, dc.related, case when failed='' then 'eligible' else 'rejected' end as decision, failed, repeats, c.factor_id as component, across_groups,
  case when alphas<{FLOORS['alphas']} then 'too_few_candidate_alphas' when across_groups<>'' then 'cross_group_review' else 'ready' end as status from dc join comp on comp.factor_id=dc.factor_id join rg c on c.ix=comp.lowest, ac, al""")
def _(t):
    return Q.decisions(state(t), REGISTRY, MINIMUM, FLOORS, RULE)
