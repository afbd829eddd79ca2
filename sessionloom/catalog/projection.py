"""JOB-43 projected on sessions and linked securities, JOB-45 applicability of trailing endpoints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.catalog.core import query
from sessionloom.functions.staging import cut
from sessionloom.operators.aggregates import attach_one_row
from sessionloom.plans import projection as P
from sessionloom.sources.fixtures import CALENDAR_START, filings, session_index, session_range

_WEEK = "cast(floor(date_diff('day', date '1995-01-02', cast({d} as date))/7.0)+1 as int)"


def issuer_links(t, last: int):
    """Who stood for an issuer when: a security's issuer number holds until its next identity row; two numbers in one session admit neither."""
    c = F.col
    o = attach_one_row(t.orders, t.supplier.agg(F.count(F.lit(1)).alias("_n")))
    seen = o.select(session_index(F.to_date("o_orderdate"), "week").alias("first_ix"), ((c("o_custkey") + c("o_orderkey") % 2) % c("_n")).alias("instrument_id"), "o_custkey", "o_orderkey")
    seen = seen.groupBy("instrument_id", "first_ix").agg(F.min("o_custkey").alias("cik"), (F.min("o_custkey") == F.max("o_custkey")).alias("unique"), F.min("o_orderkey").alias("key"))
    until = F.lead("first_ix").over(Window.partitionBy("instrument_id").orderBy("first_ix")) - 1
    tier = F.when(c("key") % 13 == 0, None).when(c("key") % 3 == 0, 1).otherwise(0)
    links = seen.select("instrument_id", "first_ix", F.coalesce(until, F.lit(last)).alias("last_ix"), "cik", "unique", (c("instrument_id") % 5 != 0).alias("common"), tier.alias("tier"), (c("first_ix") + F.when(c("key") % 4 == 0, 3).otherwise(-1)).alias("observed_ix"))
    return links.where("unique and last_ix >= first_ix")


def change_points(t):
    """JOB-43: sessions at which an issuer's selected value or its status changes."""
    c = F.col
    f = filings(t).withColumn("session_ix", session_index(F.to_date(F.date_trunc("week", "available_at")), "week")).withColumn("v", F.round(c("value") / 100000))
    s = f.groupBy("cik", "concept", "session_ix").agg(F.max_by("v", F.struct("available_at", "accession")).alias("v"), (F.min("v") != F.max("v")).alias("bad"), F.max("period_end").alias("period_end"))
    s = s.withColumn("status", F.when(c("bad"), "quarantined_conflict").otherwise("selected")).withColumn("state", F.struct("v", "status", "period_end"))
    prev = F.lag("state").over(Window.partitionBy("cik", "concept").orderBy("session_ix"))
    return s.withColumn("_p", prev).where(c("_p").isNull() | (c("_p") != c("state"))).select("cik", "concept", "session_ix", "status", "period_end")


_LINKS = f"""od as (select {_WEEK.format(d='o_orderdate')} as first_ix, (o_custkey+o_orderkey%2)%(select count(*) from supplier) as instrument_id, o_custkey, o_orderkey from orders), fin as (select max({_WEEK.format(d='l_shipdate')}) as z from lineitem),
 se as (select instrument_id, first_ix, min(o_custkey) as cik, min(o_custkey)=max(o_custkey) as uq, min(o_orderkey) as key from od group by 1,2),
 lk as (select *, instrument_id%5<>0 as common, case when key%13=0 then null when key%3=0 then 1 else 0 end as tier, first_ix+case when key%4=0 then 3 else -1 end as observed from (select *, coalesce(lead(first_ix) over (partition by instrument_id order by first_ix)-1, (select z from fin)) as last_ix from se) where uq and last_ix>=first_ix)"""
# the other way round: a row for each linked session
_DAILY = """dl as (select lk.*, unnest(range(first_ix, last_ix+1)) as s from lk), dc as (select cik, s, count(*) as n_all, count(*) filter (common) as n_common, max(instrument_id) filter (common) as id, max(tier) filter (common) as tier, max(observed) filter (common) as observed, count(tier) filter (common) as has_tier from dl group by 1,2)"""
_POINTS = f"""fl as (select o_custkey as cik, o_orderpriority as concept, {_WEEK.format(d="o_orderdate + interval '16 hours 5 minutes'")} as session_ix, round(o_totalprice/100000) as v, cast(date_trunc('quarter', o_orderdate) - interval 1 day as date) as period_end, o_orderkey as accession from orders),
 pt as (select cik, concept, session_ix, case when min(v)<>max(v) then 'quarantined_conflict' else 'selected' end as status, max(period_end) as period_end from fl group by 1,2,3)"""
_BUCKET = " ".join(f"when age<={top} then '{name}'" for top, name in zip(P.AGES, P.bucket_names()))


@query("job_43_projection", f"""with {_LINKS}, {_DAILY}, {_POINTS}, cc as (select distinct cik, concept from fl), ev as (select dc.cik, concept, dc.id, case when tier=0 then 'as_operated' else 'reconstructed' end as tier, s+1 as e from dc join cc using (cik) where n_common=1 and has_tier=1 and s+1<=(select z from fin)),
 pj as (select ev.*, coalesce(pt.status,'unavailable') as status, case when pt.status='selected' then date_diff('day', pt.period_end, date '1995-01-02'+cast(7*(e-1) as int)) end as age from ev asof left join pt on pt.cik=ev.cik and pt.concept=ev.concept and ev.e>=pt.session_ix)
 select concept, tier, status, case when age is null then 'none' {_BUCKET} else '{P.bucket_names()[-1]}' end as age, count(*) as n_sessions, count(distinct id) as n_instruments from pj group by 1,2,3,4""")
def _(t):
    last = session_range(t)[1]
    points = cut(change_points(t))
    concepts = filings(t).select("cik", "concept").distinct()
    segments = P.projected(points, P.link_sweep(issuer_links(t, last)), concepts, last, F.lit(CALENDAR_START["week"]).cast("date"))
    return P.by_age(segments)


def endpoints(t):
    """Trailing endpoints of an issuer and year; the clock of one is that of its latest component, and unknown if a component has none."""
    f = filings(t).select("cik", F.year("available_at").alias("endpoint"), F.when(F.col("accession") % 31 != 0, session_index(F.to_date(F.date_trunc("week", "available_at")), "week") + 1).alias("ix"))
    return f.groupBy("cik", "endpoint").agg(F.when(F.count("ix") == F.count(F.lit(1)), F.max("ix")).alias("session_ix"))


_END = f"""{_LINKS}, {_DAILY}, en as (select o_custkey as cik, cast(year(o_orderdate) as int) as endpoint, case when count(*) filter (o_orderkey%31=0)=0 then max({_WEEK.format(d='o_orderdate')}+1) end as session_ix from orders group by 1,2),
 ap as (select en.*, coalesce(n_all,0) as n_linked, coalesce(n_common,0) as n_common, case when n_common=1 then id end as instrument_id, case when session_ix is null then 'financial_lineage_signal_session_missing' when session_ix>(select z from fin) then 'identity_link_session_unavailable' when coalesce(n_all,0)=0 then 'stable_security_cik_link_missing_or_quarantined'
   when n_common=0 then 'no_common_security_at_signal_session' when n_common>1 then 'multiple_common_securities_for_cik' when has_tier=0 or tier<>0 then 'identity_evidence_outcome_reconciliation_only' when observed>=session_ix then 'identity_evidence_not_known_by_signal_open' else 'security_form_not_effective_dated' end as blocker
   from en left join dc on dc.cik=en.cik and dc.s=en.session_ix)"""


def applied(t):
    last = session_range(t)[1]
    return P.applicability(endpoints(t), cut(P.link_sweep(issuer_links(t, last))), last)


@query("job_45_applicability", f"with {_END} select cik, endpoint, session_ix, n_linked, n_common, instrument_id, blocker from ap")
def _(t):
    return applied(t).select("cik", "endpoint", "session_ix", "n_linked", "n_common", "instrument_id", "blocker")


@query("job_45_census", f"with {_END} select blocker, count(*) as n_endpoints, count(distinct session_ix) as n_sessions, count(distinct instrument_id) as n_instruments, count(*) filter (n_linked>1) as n_multi_security from ap group by 1")
def _(t):
    return applied(t).groupBy("blocker").agg(F.count(F.lit(1)).alias("n_endpoints"), F.countDistinct("session_ix").alias("n_sessions"), F.countDistinct("instrument_id").alias("n_instruments"), F.count_if(F.col("n_linked") > 1).alias("n_multi_security"))
