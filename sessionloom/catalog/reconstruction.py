"""JOB-67: lane decisions as intervals, gaps with coverage, evidence budgets of a market with warning labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.core import R, query
from sessionloom.catalog.filters import LOCAL_SQL, local_states
from sessionloom.functions.numeric import joined, rnd
from sessionloom.functions.staging import cut
from sessionloom.operators.aggregates import attach_one_row
from sessionloom.plans import reconstruction as P
from sessionloom.sources.fixtures import session_range

#: Of the target sessions, the first from which a listing counts as new.
START = 3


def observed(t):
    """States with their adjustment factor; a factor steps at sessions that differ by instrument."""
    s = local_states(t).withColumn("factor", F.floor((F.col("session_ix") + F.col("instrument_id") * 13) / 97))
    return P.with_changes(s)


def decided(t):
    return cut(P.lane(observed(t), session_range(t)[1]))


_LANE = f"""{LOCAL_SQL}, fin as (select max(session_ix) as z from b), w as (select *, (session_ix+instrument_id*13)//97 as factor from ls),
 ch as (select *, lag(session_ix) over i is not null and (lag(factor) over i is distinct from factor) as fc, max(session_ix) over (partition by instrument_id) as last_ix, z from w, fin window i as (partition by instrument_id order by session_ix)),
 ln as (select *, case when board='unknown' or fc or (session_ix=last_ix and session_ix<z) then 'quarantined' when warning_status not in ('none','unknown') then 'candidate_excluded' when warning_status='unknown' then 'quarantined' when trading_status='not_listed' then 'candidate_excluded'
   when trading_status='unknown' or session_ix>=z then 'quarantined' else 'candidate_included' end as disposition from ch),
 rd as (select *, list_sort(list_filter([case when trading_status='unknown' then 'trading_status_unknown' end, case when warning_status='unknown' then 'risk_warning_status_unknown' end, case when board='unknown' then 'price_limit_regime_unknown' end, case when fc then 'factor_change_candidate_window' end,
   case when session_ix=last_ix and session_ix<z then 'terminal_boundary_not_adjudicated' end, case when session_ix>=z then 'next_session_knowledge_clock_unavailable' else 'next_session_reconstructed_knowledge_clock' end, case when trading_status='not_listed' then 'not_listed_state_exclusion_candidate' end,
   case when trading_status='suspended' then 'suspension_observed_reconstructed' end, case when warning_status not in ('none','unknown') then 'risk_warning_exclusion_candidate' end, 'not_as_operated', 'source_available_at_unobserved'], lambda x: x is not null)) as reasons from ln)"""
# another way to the same runs: sessions minus their rank within the state are constant along a run
_RUNS = """rs as (select *, session_ix-row_number() over (partition by instrument_id, trading_status, warning_status, disposition order by session_ix) as grp from ln),
 ru as (select instrument_id, trading_status, warning_status, disposition, min(session_ix) as first_ix, max(session_ix) as last_ix, max(session_ix)-min(session_ix)+1 as length from rs group by instrument_id, trading_status, warning_status, disposition, grp),
 rb as (select *, lag(last_ix) over o as p, lead(first_ix) over o as f from ru window o as (partition by instrument_id order by first_ix))"""


@query("job_67_lane_decisions", f"with {_LANE} select instrument_id, session_ix, disposition, array_to_string(reasons,'|') as reasons, cast(case when session_ix<z then session_ix+1 end as int) as knowledge_ix from rd")
def _(t):
    return decided(t).select("instrument_id", "session_ix", "disposition", joined(F.col("reasons")).alias("reasons"), F.col("knowledge_ix").cast("int").alias("knowledge_ix"))


@query("job_67_state_intervals", f"""with {_LANE}, {_RUNS} select instrument_id, trading_status, warning_status, disposition, first_ix, last_ix, length, case when p is null then 'begins' when first_ix>p+1 then 'after_gap' else 'state_change' end as starts,
 case when f is null then 'ends' when f>last_ix+1 then 'before_gap' else 'state_change' end as stops from rb""")
def _(t):
    return P.islands(decided(t))


@query("job_67_gaps", f"""with {_LANE}, g as (select instrument_id, session_ix, lead(session_ix) over (partition by instrument_id order by session_ix) as nx from ls),
 cv as (select instrument_id, count(*)/(max(session_ix)-min(session_ix)+1) as coverage, count(*) filter (disposition='quarantined') as quarantined from ln group by 1)
 select g.instrument_id, session_ix+1 as first_missing, nx-1 as last_missing, nx-session_ix-1 as length, {R('coverage')} as coverage, cast(quarantined as bigint) as quarantined from g join cv using (instrument_id) where nx>session_ix+1""")
def _(t):
    runs = cut(P.islands(decided(t)))
    return P.gaps(runs).join(P.coverage(runs), "instrument_id").select("instrument_id", "first_missing", "last_missing", "length", rnd("coverage").alias("coverage"), F.col("quarantined").cast("bigint").alias("quarantined"))


@query("job_67_evidence_budget", f"""with {_LANE}, tg as (select s_suppkey as instrument_id, s_suppkey%25=0 as isolated, coalesce((select min(session_ix) from ls where ls.instrument_id=s_suppkey),0) as listed_ix from supplier), ob as (select ch.* from ch join tg using (instrument_id) where not isolated),
 pr as (select instrument_id, count(*) as n_states, count(*) filter (warning_status not in ('none','unknown')) as n_warned, count(*) filter (warning_status='unknown') as n_warning_unknown, count(*) filter (trading_status='unknown') as n_trading_unknown, count(*) filter (fc) as n_factor_changes, max(session_ix) as li from ob group by 1),
 j as (select tg.*, coalesce(n_states,0) as n_states, coalesce(n_warned,0) as n_warned, coalesce(n_warning_unknown,0) as n_warning_unknown, coalesce(n_trading_unknown,0) as n_trading_unknown, coalesce(n_factor_changes,0) as n_factor_changes, coalesce(li<(select z from fin),false) as terminal_boundary, isolated or listed_ix>={START} as listing_uncertain from tg left join pr using (instrument_id)),
 f as (select *, list_filter([case when n_factor_changes>0 then 'corporate_action' end, case when isolated or terminal_boundary or n_trading_unknown>0 or n_states=0 then 'lifecycle' end, case when listing_uncertain then 'listing_stage' end, case when n_warned>0 or n_warning_unknown>0 then 'risk_warning' end], lambda x: x is not null) as fam from j)
 select instrument_id, n_states, n_warned, n_warning_unknown, n_trading_unknown, n_factor_changes, terminal_boundary, listing_uncertain, array_to_string(fam,'|') as families, cast(4*list_contains(fam,'lifecycle')::int+list_contains(fam,'listing_stage')::int+list_contains(fam,'risk_warning')::int as int) as maximum_requests, (select count(*) from tg)*5 as blind_baseline from f where len(fam)>0""")
def _(t):
    states = observed(t)
    listed = states.groupBy("instrument_id").agg(F.min("session_ix").alias("listed_ix"))
    targets = t.supplier.select(F.col("s_suppkey").alias("instrument_id"), (F.col("s_suppkey") % 25 == 0).alias("isolated")).join(listed, "instrument_id", "left").fillna(0, ["listed_ix"])
    known = states.join(targets.where("not isolated").select("instrument_id"), "instrument_id")
    e = P.evidence_budget(targets, known, START, session_range(t)[1])
    e = attach_one_row(e, targets.agg((F.count(F.lit(1)) * P.BLIND).alias("blind_baseline")))
    return e.select("instrument_id", "n_states", "n_warned", "n_warning_unknown", "n_trading_unknown", "n_factor_changes", "terminal_boundary", "listing_uncertain", joined(F.col("families")).alias("families"), "maximum_requests", "blind_baseline")
