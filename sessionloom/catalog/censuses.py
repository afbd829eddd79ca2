"""JOB-26, 29, 36, 39, 40, 68, 69, 72, 73: decision ledgers and censuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.core import ORACLES, query
from sessionloom.catalog.filters import LADDER_SQL, ladder, lifecycle_input
from sessionloom.catalog.joins import calendar
from sessionloom.catalog.sqltext import FILINGS, MASTER, SPLITS, bars as B
from sessionloom.functions.numeric import joined
from sessionloom.operators import filters as P
from sessionloom.operators.aggregates import attach_one_row
from sessionloom.plans import censuses as C
from sessionloom.sources.fixtures import bars, filings, master, session_index, splits

ID = ["instrument_id", "session_ix"]
IDS = "instrument_id, session_ix"
_WEEK = "cast(floor(date_diff('day', date '1995-01-02', cast({d} as date))/7.0)+1 as int)"


@query("job_26_policy_review", f"""with {LADDER_SQL}, s as (select session_ix, instrument_id, bool_or(disposition='included' and policy='A') as a, bool_or(disposition='included' and policy='B') as b from ld group by 1,2),
 p as (select session_ix+1 as session_ix, instrument_id, a as pa, b as pb from s),
 j as (select coalesce(s.session_ix,p.session_ix) as session_ix, coalesce(a,false) as a, coalesce(b,false) as b, coalesce(pa,false) as pa, coalesce(pb,false) as pb from s full join p on s.session_ix=p.session_ix and s.instrument_id=p.instrument_id)
 select session_ix, count(*) filter (a) as n_left, count(*) filter (b) as n_right, count(*) filter (a and not b) as left_only, count(*) filter (b and not a) as right_only, count(*) filter (a and not pa) as left_in, count(*) filter (pa and not a) as left_out,
  count(*) filter (b and not pb) as right_in, count(*) filter (pb and not b) as right_out from j group by 1""")
def _(t):
    return C.policy_review(ladder(t).select(*ID, "policy", "disposition"), "A", "B")


@query("job_29_actions_at_date", f"""with {B()}, {MASTER}, {SPLITS}, h as (select session_ix, case when (instrument_id+session_ix)%9=0 then 'S-NONE' when instrument_id%40=4 then 'S-TWIN' else ticker end as ticker, instrument_id from b join m using (instrument_id)),
 n as (select session_ix, ticker, count(distinct instrument_id) as n, min(instrument_id) as resolved from h group by 1,2),
 a as (select action_id, effective_ix, instrument_id, case when instrument_id%40=4 then 'S-TWIN' else ticker end as symbol from sp)
 select action_id, effective_ix, symbol, coalesce(n,0) as n_identities, case when n=1 then resolved end as resolved_id,
  case when coalesce(n,0)=0 then 'unresolved_no_identity_on_date' when n>1 then 'ambiguous_identity_on_date' when resolved<>a.instrument_id then 'resolved_to_other_security' else 'resolved' end as status
 from a left join n on n.session_ix=a.effective_ix and n.ticker=a.symbol""")
def _(t):
    k = F.col("instrument_id")
    symbol = F.when(k % 40 == 4, "S-TWIN").otherwise(F.col("ticker"))
    held = bars(t).select(*ID).join(master(t).select("instrument_id", "ticker"), "instrument_id").select(*ID, F.when((k + F.col("session_ix")) % 9 == 0, "S-NONE").otherwise(symbol).alias("ticker"))
    return C.actions_at_date(splits(t).select("action_id", "effective_ix", "instrument_id", symbol.alias("symbol")), held)


@query("job_39_filer_links", f"""with {B()}, {MASTER}, i as (select {_WEEK.format(d='o_orderdate')} as session_ix, o_custkey%(select count(*) from supplier) as instrument_id, case when o_orderkey%31=0 then 'S-OLD' end as other,
   case when o_custkey%37=0 then 'bad' when o_orderkey%11<>0 then lpad(cast(o_custkey//(select count(*) from supplier)%3 as varchar),10,'0') end as cik from orders),
 x as (select session_ix, instrument_id, count(*) as n_rows, bool_and(other is null) as same, count(distinct case when cik<>'bad' then cik end) as n_ciks, min(case when cik<>'bad' then cik end) as cik, coalesce(bool_or(cik='bad'),false) as inv from i group by 1,2),
 y as (select b.instrument_id, b.session_ix, coalesce(n_rows,0) as n_rows, coalesce(same,false) as same, coalesce(n_ciks,0) as n_ciks, x.cik, coalesce(inv,false) as inv, case when b.instrument_id%4=1 then '0000000001' end as mc from b left join x on x.session_ix=b.session_ix and x.instrument_id=b.instrument_id),
 z as (select *, coalesce(n_ciks=1 and mc<>cik,false) as mm from y),
 w as (select *, case when n_rows=0 or not same or inv or mm then 'quarantined_identity_mismatch' when n_ciks>1 then 'quarantined_conflicting_cik' when n_ciks=0 then 'quarantined_missing_cik' else 'admitted_unique_cik' end as link_status from z),
 v as (select {IDS}, link_status, n_rows, case when link_status='admitted_unique_cik' then cik end as cik, case when link_status='admitted_unique_cik' then '' else array_to_string(list_sort(list_filter([case when n_rows=0 then 'resolved_identity_missing' end, case when not same then 'effective_ticker_mismatch' end,
   case when inv then 'cik_invalid' end, case when n_ciks=0 then 'cik_missing' end, case when n_ciks>1 then 'cik_conflict' end, case when mm then 'instrument_master_cik_mismatch' end], lambda x: x is not null)),'|') end as reasons from w)
 select *, case when cik is not null then count(*) over (partition by session_ix, cik) end as cik_instruments from v""")
def _(t):
    n = t.supplier.agg(F.count(F.lit(1)).alias("_n"))
    o = attach_one_row(t.orders, n)
    home = master(t).select("instrument_id", "ticker")
    cik = F.when(F.col("o_custkey") % 37 == 0, "bad").when(F.col("o_orderkey") % 11 != 0, F.lpad((F.floor(F.col("o_custkey") / F.col("_n")) % 3).cast("string"), 10, "0"))
    ident = o.select(session_index(F.to_date("o_orderdate"), "week").alias("session_ix"), (F.col("o_custkey") % F.col("_n")).alias("instrument_id"), (F.col("o_orderkey") % 31 == 0).alias("old"), cik.alias("cik"))
    ident = ident.join(home, "instrument_id").withColumn("ticker", F.when(F.col("old"), "S-OLD").otherwise(F.col("ticker")))
    sec = bars(t).select(*ID).join(home, "instrument_id").withColumn("master_cik", F.when(F.col("instrument_id") % 4 == 1, "0000000001"))
    return C.filer_links(sec, ident)


@query("job_40_facts_census", f"""with {FILINGS}, d as (select cik, concept, period_end, cast(available_at as date) as day, count(*) as n, count(distinct value) as vals, min(value) as lo, max(value) as hi from f group by 1,2,3,4),
 p as (select cik, concept, period_end, sum(n) as n, sum(n-vals) as rep, count(*) filter (vals>1) as cd, count(*) as days, min(lo) as lo, max(hi) as hi, min(day) as fd, max(day) as ld from d group by 1,2,3)
 select concept, count(*) as n_keys, sum(n)::bigint as n_facts, sum(rep)::bigint as n_repeated, count(*) filter (cd>0) as n_conflicting_keys, count(*) filter (days>1 and lo<>hi) as n_revised_keys, count(distinct cik) as n_issuers, cast(min(fd) as varchar) as first_day, cast(max(ld) as varchar) as last_day from p group by 1""")
def _(t):
    c = C.facts_census(filings(t), ["cik", "concept", "period_end"])
    return c.withColumn("first_day", F.col("first_day").cast("string")).withColumn("last_day", F.col("last_day").cast("string"))


@query("job_68_calendar_evidence", f"""with {B()}, {MASTER}, l as (select unnest(range((select min(session_ix) from b), (select max(session_ix)+1 from b))) as session_ix), n as (select distinct {_WEEK.format(d='o_orderdate')} as session_ix from orders where o_orderpriority='1-URGENT'),
 o as (select distinct session_ix from b join m using (instrument_id) where exchange='ASIA'),
 x as (select coalesce(l.session_ix, n.session_ix, o.session_ix) as session_ix, l.session_ix is not null as in_library, n.session_ix is not null as in_notices, o.session_ix is not null as in_observed from l full join n on n.session_ix=l.session_ix full join o on o.session_ix=coalesce(l.session_ix, n.session_ix))
 select cast(session_ix as int) as session_ix, in_library, in_notices, in_observed, case when in_library and in_notices and in_observed then 'agreed' when not in_library then 'unknown_to_library' when not in_observed then 'not_observed' else 'not_announced' end as status from x""")
def _(t):
    notices = t.orders.where("o_orderpriority = '1-URGENT'").select(session_index(F.to_date("o_orderdate"), "week").alias("session_ix"))
    seen = bars(t).join(master(t).where("exchange = 'ASIA'").select("instrument_id"), "instrument_id")
    return C.calendar_evidence(calendar(t), notices, seen)


_YEAR = "year(date '1995-01-02' + cast((session_ix-1)*7 as int))"


@query("job_69_foundation_census", f"""with {B()}, {SPLITS}, fm as (select 'bars' as family, session_ix from b union all select 'actions', effective_ix from sp union all select 'filings', {_WEEK.format(d='o_orderdate')} from orders),
 l as (select unnest(range((select min(session_ix) from b), (select max(session_ix)+1 from b))) as session_ix), e as (select {_YEAR} as year, count(*) as expected from l group by 1),
 g as (select family, {_YEAR} as year, count(distinct session_ix) as covered, count(*) as n_rows from fm group by 1,2)
 select f.family, cast(e.year as int) as year, expected, coalesce(covered,0) as covered, coalesce(n_rows,0) as n_rows, case when coalesce(covered,0)>=expected then 'complete' when covered>0 then 'partial' else 'missing' end as status
 from (select distinct family from fm) f cross join e left join g on g.family=f.family and g.year=e.year""")
def _(t):
    fil = t.orders.select(F.lit("filings").alias("family"), session_index(F.to_date("o_orderdate"), "week").alias("session_ix"))
    fam = bars(t).select(F.lit("bars").alias("family"), "session_ix").unionByName(splits(t).select(F.lit("actions").alias("family"), F.col("effective_ix").alias("session_ix"))).unionByName(fil)
    year = F.year(F.date_add(F.lit("1995-01-02").cast("date"), (F.col("session_ix") - 1) * 7))
    return C.coverage_by_year(fam, year, calendar(t))


@query("job_72_type_evidence", """with n as (select count(*) as n from supplier), r0 as (select c_custkey as k, c_custkey%n as i from customer, n),
 r as (select case when k%23<>0 then i end as instrument_id, case when k%61=0 then 'ETF' when k%47=0 then 'ZZ' when i%5=0 then 'ADRC' else 'CS' end as type_code, 'row-'||cast(k//3 as varchar) as row_text from r0 union all select case when k%23<>0 then i end, case when k%61=0 then 'ETF' when k%47=0 then 'ZZ' when i%5=0 then 'ADRC' else 'CS' end, 'row-'||cast(k//3 as varchar) from r0 where k%10=0),
 d as (select instrument_id, type_code, row_text, count(*) as n from r group by 1,2,3), t as (select count(*) as nd, count(instrument_id) as nl from d),
 p as (select instrument_id, sum(n)::bigint as n_rows, count(*) as n_distinct_rows, count(distinct case when type_code<>'ZZ' then type_code end) as nt, min(case when type_code<>'ZZ' then type_code end) as only_, count(*) filter (type_code='ZZ') as nu from d where instrument_id is not null group by 1)
 select instrument_id, n_rows, n_distinct_rows, case when nt=1 then only_ end as type_code, case when nt>1 then 'ambiguous' when nt=0 then 'quarantined' else 'classified' end as status,
  array_to_string(list_sort(list_filter([case when nt>1 then 'conflicting_type_evidence' end, case when nt=0 then 'no_supported_type' end, case when nu>0 then 'unsupported_type_code' end], lambda x: x is not null)),'|') as reasons, round(nl/nd,6)+0.0 as linked_share, nl/nd>=0.9 as gate from p, t""")
def _(t):
    n = t.supplier.agg(F.count(F.lit(1)).alias("_n"))
    k = F.col("c_custkey")
    r = attach_one_row(t.customer.select("c_custkey"), n).withColumn("i", k % F.col("_n"))
    code = F.when(k % 61 == 0, "ETF").when(k % 47 == 0, "ZZ").when(F.col("i") % 5 == 0, "ADRC").otherwise("CS")
    r = r.select("c_custkey", F.when(k % 23 != 0, F.col("i")).alias("instrument_id"), code.alias("type_code"), F.concat(F.lit("row-"), F.floor(k / 3).cast("string")).alias("row_text"))
    e = C.type_evidence(r.unionAll(r.where(k % 10 == 0)).drop("c_custkey"), 0.9)
    return e.withColumn("linked_share", F.round("linked_share", 6) + 0.0)


@query("job_73_package_equivalence", f"""with {B()}, s as (select session_ix, instrument_id, cast(cast(volume as bigint) as varchar) as v from b),
 p as (select session_ix, 1 as candidate, instrument_id, case when (instrument_id+session_ix)%397=0 then v||'x' else v end as v from s where session_ix%33<>0 and not (session_ix%41=0 and instrument_id%10=0) union all select session_ix, 2, instrument_id, v from s where session_ix%20=0),
 w as (select session_ix, count(*) as n, sum(('0x'||substr(md5(cast(instrument_id as varchar)),1,15))::bigint::hugeint) as ids, sum(('0x'||substr(md5(instrument_id||'|'||v),1,15))::bigint::hugeint) as vals from s group by 1),
 g as (select session_ix, candidate, count(*) as n, sum(('0x'||substr(md5(cast(instrument_id as varchar)),1,15))::bigint::hugeint) as ids, sum(('0x'||substr(md5(instrument_id||'|'||v),1,15))::bigint::hugeint) as vals from p group by 1,2),
 j as (select w.session_ix, candidate, w.n=g.n as cm, w.ids=g.ids as im, w.vals=g.vals as vm from w left join g on g.session_ix=w.session_ix),
 a as (select session_ix, count(candidate) as n_candidates, count(*) filter (cm and im and vm) as n_exact, coalesce(bool_or(im),false) as identity_match, coalesce(bool_or(cm),false) as count_match, coalesce(bool_or(vm),false) as value_match from j group by 1)
 select *, case when n_candidates=0 then 'missing_source' when n_exact>1 then 'several_candidates' when n_exact=1 then 'exact_equivalent' else 'identity_snapshot_mismatch' end as status from a""")
def _(t):
    s = bars(t).select("session_ix", "instrument_id", F.col("volume").cast("bigint").cast("string").alias("value_text"))
    i, d = F.col("instrument_id"), F.col("session_ix")
    one = s.where((d % 33 != 0) & ~((d % 41 == 0) & (i % 10 == 0))).withColumn("value_text", F.when((i + d) % 397 == 0, F.concat("value_text", F.lit("x"))).otherwise(F.col("value_text"))).withColumn("candidate", F.lit(1))
    return C.package_equivalence(s, one.unionByName(s.where(d % 20 == 0).withColumn("candidate", F.lit(2))))


@query("job_36_lifecycle_resolution", ORACLES["fil_20_lifecycle_reasons"].replace("min(session_ix) as first_seen, max(session_ix) as last_seen", "min(session_ix) as first_seen, max(session_ix) as last_seen, count(*) as n_seen").replace(
    "end as last_seen from o left join", "end as last_seen, case when stable_id%15<>2 then n_seen end as n_seen from o left join").replace("r as (select instrument_id, list_sort", "r as (select instrument_id, stable_id, delisted, first_seen, last_seen, n_seen, list_sort").replace(
    "select instrument_id, array_to_string", "select instrument_id, stable_id, delisted, first_seen, last_seen, n_seen, delisted-last_seen as sessions_to_delisting, (last_seen-first_seen+1)-n_seen as n_gaps, case when len(codes)>0 then 'unresolved' when delisted-last_seen>5 then 'stopped_early' else 'resolved_inactive' end as resolution, array_to_string"))
def _(t):
    c = F.col
    df = P.lifecycle_reasons(lifecycle_input(t)).withColumn("n_codes", F.size("codes"))
    gap = c("delisted") - c("last_seen")
    return df.select("instrument_id", "stable_id", "delisted", "first_seen", "last_seen", "n_seen", gap.alias("sessions_to_delisting"), (c("last_seen") - c("first_seen") + 1 - c("n_seen")).alias("n_gaps"),
                     F.when(c("n_codes") > 0, "unresolved").when(gap > 5, "stopped_early").otherwise("resolved_inactive").alias("resolution"), joined(c("codes")).alias("codes"), "disposition")
