"""STR-*: batch forms of the streaming jobs over whole tables (stream forms are tested in tests/)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.catalog.core import R, query
from sessionloom.catalog.market import _composite_sql, daily_composite, regime_metrics
from sessionloom.catalog.sqltext import FILINGS, I, bars as B, lag
from sessionloom.functions.numeric import rnd
from sessionloom.functions.staging import cut, shared_folder
from sessionloom.operators.filters import members
from sessionloom.params.regime import DIMENSIONS
from sessionloom.plans import market as M
from sessionloom.sources import families as FT
from sessionloom.sources.fixtures import bars, filings, session_range, universe
from sessionloom.streaming import composite as C, folds, streams as S
from sessionloom.streaming.state import rocksdb

ID = ["instrument_id", "session_ix"]
IDS = "instrument_id, session_ix"


# the fold in SQL: a recursive walk over the calendar, one row per key and session
_BAND = "case when s>=70 then 'risk_on' when s>=50 then 'balanced' when s>=30 then 'defensive' else 'stress' end"
_DAYS = """d as (select user_id as universe_id, cast(date_diff('day', (select cast(min(ts) as date) from events), cast(ts as date))+1 as int) as session_ix, least(100.0, round(avg(value)*2,4)) as score from events group by 1,2)"""
_FOLD = f"""k as (select distinct universe_id from d), g as (select universe_id, cast(x.range as int) as session_ix from k, (select unnest(range((select min(session_ix) from d),(select max(session_ix)+1 from d))) as range) x),
 e as (select g.universe_id, g.session_ix, d.score as s, case when d.score is not null then {_BAND.replace('s>=', 'd.score>=')} end as cand from g left join d on d.universe_id=g.universe_id and d.session_ix=g.session_ix),
 w as (select universe_id, (select cast(min(session_ix)-1 as int) from d) as session_ix, null::varchar as conf, false as prov, null::varchar as pend, 0 as cnt, null::varchar as status from k
  union all select universe_id, session_ix, x.conf, x.prov, x.pend, x.cnt, x.status from (
   select e.universe_id, e.session_ix, case
     when e.s is null then {{'conf': w.conf, 'prov': w.prov, 'pend': w.pend, 'cnt': w.cnt, 'status': case when w.conf is not null then 'unavailable_stale' else 'unavailable_uninitialized' end}}
     when w.conf is null and w.pend is null then {{'conf': null, 'prov': false, 'pend': e.cand, 'cnt': 1, 'status': 'initialization_pending'}}
     when w.conf is null and w.pend=e.cand then {{'conf': e.cand, 'prov': false, 'pend': null, 'cnt': 0, 'status': 'initialized_confirmed'}}
     when w.conf is null then {{'conf': case when list_position(['risk_on','balanced','defensive','stress'], w.pend)>list_position(['risk_on','balanced','defensive','stress'], e.cand) then w.pend else e.cand end, 'prov': true, 'pend': null, 'cnt': 0, 'status': 'initialized_provisional'}}
     when w.prov and e.cand=w.conf then {{'conf': w.conf, 'prov': false, 'pend': null, 'cnt': 0, 'status': 'provisional_cleared'}}
     when w.conf<>'stress' and e.s<=20 then {{'conf': 'stress', 'prov': false, 'pend': null, 'cnt': 0, 'status': 'immediate_stress_override'}}
     when r.tgt is null then {{'conf': w.conf, 'prov': w.prov, 'pend': null, 'cnt': 0, 'status': case when w.pend is not null then 'pending_reversed' when e.cand<>w.conf then 'hysteresis_held' else 'held' end}}
     when (case when w.pend=r.tgt then w.cnt+1 else 1 end)>=r.n then {{'conf': r.tgt, 'prov': false, 'pend': null, 'cnt': 0, 'status': 'switched'}}
     else {{'conf': w.conf, 'prov': w.prov, 'pend': r.tgt, 'cnt': case when w.pend=r.tgt then w.cnt+1 else 1 end, 'status': 'pending'}} end as x
   from w join e on e.universe_id=w.universe_id and e.session_ix=w.session_ix+1
   left join (values ('risk_on','balanced',-1e9,65.0,2),('balanced','risk_on',70.0,1e9,2),('balanced','defensive',-1e9,45.0,2),('defensive','balanced',55.0,1e9,2),('defensive','stress',-1e9,30.0,2),('stress','defensive',35.0,1e9,3)) r(src,tgt,lo,hi,n) on r.src=w.conf and e.s>=r.lo and e.s<r.hi))"""


@query("str_02_regime_state", f"with recursive {_DAYS}, {_FOLD} select w.universe_id, w.session_ix, conf as confirmed, prov as provisional, pend as pending, w.cnt as pending_count, status, cand as candidate from w join e on e.universe_id=w.universe_id and e.session_ix=w.session_ix")
def _(t):
    h = folds.state_history(*daily_composite(t))
    return h.select("universe_id", "session_ix", "confirmed", "provisional", "pending", "pending_count", "status", "candidate")


@query("job_08_market_state", f"with recursive {_composite_sql()}, d as (select 1::bigint as universe_id, cast(session_ix as int) as session_ix, regime_score as score from cp), {_FOLD} select w.session_ix, {R('e.s', 4)} as score, cand as candidate, conf as confirmed, prov as provisional, pend as pending, w.cnt as pending_count, status from w join e on e.universe_id=w.universe_id and e.session_ix=w.session_ix")
def _(t):
    c = M.composite(regime_metrics(t)).select(F.lit(1).cast("bigint").alias("universe_id"), "session_ix", F.col("regime_score").alias("score"))
    h = folds.state_history(c, *session_range(t, "month"))
    return h.select("session_ix", rnd("score", 4).alias("score"), "candidate", "confirmed", "provisional", "pending", "pending_count", "status")


@query("str_07_late_rows", f"with {B()} select session_ix, case when session_ix>300 then 'new' when (instrument_id+session_ix)%30=0 then 'quarantined_changed' else 'accepted_equal' end as verdict, count(*) as n from b group by 1,2")
def _(t):
    b = bars(t).select(*ID, "close", "volume")
    late = b.withColumn("close", F.when((F.col("instrument_id") + F.col("session_ix")) % 30 == 0, F.col("close") + 1).otherwise(F.col("close")))
    return S.late_rows(late, b.where("session_ix <= 300"), ID, ["close", "volume"]).groupBy("session_ix", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("str_08_knowledge_cutoff", f"with {FILINGS} select concept, count(*) as n, cast(max(available_at) as varchar) as latest from f where available_at<=timestamp '1998-06-30 12:00:00' group by 1")
def _(t):
    f = S.knowledge_cutoff(filings(t), F.lit("1998-06-30 12:00:00").cast("timestamp"))
    return f.groupBy("concept").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max("available_at"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("str_09_pending_outcomes", f"with {B()} select s.instrument_id, s.session_ix, {R('x.close/s.close-1')} as outcome, case when x.close is null then 'pending' else 'mature' end as maturity from b s left join b x on x.instrument_id=s.instrument_id and x.session_ix=s.session_ix+3")
def _(t):
    b = bars(t).select(*ID, "close")
    return S.outcomes(b, b, 3).select(*ID, rnd("outcome").alias("outcome"), "maturity")


@query("str_10_freshness", f"with {B()}, l as (select cast(floor(date_diff('day', date '1995-01-02', cast(max(l_shipdate) as date))/7.0)+2 as int) as ix from lineitem) select max(session_ix) as last_ix, (select max(ix) from l)-max(session_ix) as lag_sessions, case when (select max(ix) from l)-max(session_ix)=0 then 'fresh' when (select max(ix) from l)-max(session_ix)<=2 then 'stale' else 'unavailable' end as status from b")
def _(t):
    # the session that is due next after the last shipped day
    return S.freshness(bars(t), session_range(t)[1] + 1)


@query("str_11_event_windows", "select strftime(date_trunc('day', ts),'%Y-%m-%d') as window_start, event_type, count(*) as n from events group by 1,2")
def _(t):
    w = S.event_windows(t.events)
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "event_type", "n")


def composite_panel(t):
    """Bars of members, broad benchmarks and the market, as the composite's stream reads them, and its settings."""
    u = universe(t)
    kinds = [("member", members(bars(t, grain="month"), u)), ("broad", bars(t, "region", "month")), ("market", bars(t, "market", "month"))]
    rows = [b.select(F.lit(k).alias("kind"), F.col("instrument_id").cast("string").alias("instrument_id"), "session_ix", "open", "high", "low", "close", "volume") for k, b in kinds]
    return cut(reduce(DataFrame.unionByName, rows)), C.Panel("primary", u.count(), 10, 4, 5, 3)


def streamed_composite(panel, settings, parts: int = 4) -> tuple[str, str]:
    """Feed a panel session by session in ``parts`` files, stopping half-way, with rows that come too late; returns the store and the quarantine."""
    spark, folder = panel.sparkSession, shared_folder(panel.sparkSession, "composite")
    first, last = panel.agg(F.min("session_ix"), F.max("session_ix")).first()
    step = -(-(last - first + 1) // parts)
    with rocksdb(spark):
        for k in range(parts):
            lo = first + k * step
            part = panel.where(F.col("session_ix").between(lo, lo + step - 1))
            if k == parts - 1:  # a price of the second session, corrected much later
                part = part.unionByName(panel.where(F.col("session_ix") == first + 1).withColumn("close", F.col("close") * 2))
            part.coalesce(1).write.mode("append").parquet(f"{folder}/source")
            if k in (parts // 2 - 1, parts - 1):  # the second run starts from the checkpoint of the first
                C.accept_sessions(spark, f"{folder}/source", f"{folder}/accepted", f"{folder}/late", f"{folder}/check-a").awaitTermination()
                C.run_composite(spark, f"{folder}/accepted", f"{folder}/store", settings, f"{folder}/check-b").awaitTermination()
    return f"{folder}/store", f"{folder}/late"


@query("str_06_rolling_composite", f"with {_composite_sql()} select session_ix, cast(weight_available as int) as weight_available, " + ", ".join(f"{R(d + '_score', 4)} as {d}_score" for d in DIMENSIONS)
       + f", {R('regime_score', 4)} as regime_score, (select count(*) from b where session_ix=(select min(session_ix)+1 from b))+(select count(*) from rg where session_ix=(select min(session_ix)+1 from b))+1 as n_quarantined from cp where session_ix>=(select min(session_ix) from b)+20")
def _(t):
    panel, settings = composite_panel(t)
    store, late = streamed_composite(panel, settings)
    n_late = t.spark.read.schema(C.BARS).parquet(late).count()
    s = FT.read(t.spark, store, C.SCORES)
    return s.select("session_ix", "weight_available", *[rnd(f"{d}_score", 4).alias(f"{d}_score") for d in DIMENSIONS], rnd("regime_score", 4).alias("regime_score"), F.lit(n_late).cast("bigint").alias("n_quarantined"))
