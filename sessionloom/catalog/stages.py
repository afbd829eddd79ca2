"""STR-03..05 / JOB-17: candidate stages on the real score and market state, in batch and appended to a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sessionloom.catalog.candidates import SCORE_SQL, _scored, stock_panel
from sessionloom.catalog.core import R, query
from sessionloom.catalog.market import _composite_sql, regime_metrics
from sessionloom.catalog.sqltext import bars as B, cont, lag, rows
from sessionloom.catalog.streams import _FOLD
from sessionloom.functions.numeric import rnd
from sessionloom.functions.staging import stored
from sessionloom.operators import windows as W
from sessionloom.operators.aggregates import attach_one_row
from sessionloom.plans import market as M
from sessionloom.sources.fixtures import session_range
from sessionloom.streaming import folds, stage_stream as SS
from sessionloom.streaming.stages import stage_history

ID = ["instrument_id", "session_ix"]
IDS = "instrument_id, session_ix"
PRICE_FLOOR, LIQUIDITY_FLOOR = 500.0, 100000.0


def market_states(t, stock=None):
    """Confirmed market state per session (JOB-08)."""
    c = M.composite(regime_metrics(t, stock)).select(F.lit(1).cast("bigint").alias("universe_id"), "session_ix", F.col("regime_score").alias("score"))
    return folds.state_history(c, *session_range(t, "month")).select("session_ix", F.col("confirmed").alias("regime"))


def stage_facts(t, stock):
    """What the stage machine asks of a bar: the candidate score and its parts (JOB-15), the break of the prior closes, a return that looks wrong."""
    c = F.col
    up = W.add_returns(W.prior_extremes(stock), lags=(1,)).select(*ID, (c("close") > c("prior_high")).alias("up"), ((c("r1") >= 1.0) | (c("r1") <= -0.5)).alias("odd"))
    no = lambda x: F.coalesce(x, F.lit(False))
    return _scored(t, stock).join(up, ID).select(
        *ID, F.round("base_score", 6).alias("score"), "confidence", c("close").alias("price"), "median_dv", F.round("stock_relative_strength", 6).alias("rs"), F.round("trend_quality", 6).alias("trend"),
        F.round("market_alignment", 6).alias("alignment"), no(c("odd")).alias("anomaly"), no(c("up") & (c("participation") == 100)).alias("breakout"))


_STAGE = f"""{SCORE_SQL}, rgs as (with recursive {_composite_sql()}, d as (select 1::bigint as universe_id, cast(session_ix as int) as session_ix, regime_score as score from cp), {_FOLD} select w.session_ix, conf from w join e on e.universe_id=w.universe_id and e.session_ix=w.session_ix),
 ri as (select {IDS} from b0), bx as (select {IDS}, close>case when {cont(6)} then max(close) {rows(5, 1)} end as up, close/{lag('close', 1)}-1 as r from b0),
 sf as (select sc.instrument_id, sc.session_ix, round(base_score,6) as s, confidence as cf, close>=500 and median_dv>=100000 as fl, median_dv, round(stock_relative_strength,6) as rs, round(trend_quality,6) as tr, round(market_alignment,6) as al,
   coalesce(bx.r>=1 or bx.r<=-0.5,false) as an, coalesce(conf<>'stress',false) as calm, coalesce(up and participation=100,false) as br
   from sc join bx on bx.instrument_id=sc.instrument_id and bx.session_ix=sc.session_ix left join rgs on rgs.session_ix=sc.session_ix),
 sr as (select *, s<45 or not fl or an as bad from sf where s is not null and median_dv is not null),
 sk as (select {IDS}, cf, case when s>=50 and cf>=0.4 and fl and not an then 'not_listed_to_watch' end as r0, case when bad then 'active_to_invalidated' when s>=65 and calm and rs>=55 and tr>=55 and not an then 'watch_to_prepare' end as r1,
   case when bad then 'active_to_invalidated' when br and s>=70 and calm and not an then 'prepare_to_enter_breakout' when s>=75 and fl and not an then 'prepare_to_enter' when s<58 or al<40 then 'prepare_to_watch' end as r2,
   case when bad then 'active_to_invalidated' when s<68 or tr<50 then 'enter_to_prepare' end as r3, case when s>=55 and fl and not an then 'invalidated_to_watch' end as r4 from sr),
 ky as (select distinct instrument_id from ri), gr as (select ky.instrument_id, cast(x.range as int) as session_ix, cf, r0, r1, r2, r3, r4 from ky cross join (select unnest(range((select min(session_ix) from ri),(select max(session_ix)+1 from ri))) as range) x left join sk on sk.instrument_id=ky.instrument_id and sk.session_ix=x.range),
 rl(rule, tgt, n) as (values ('not_listed_to_watch','watch',1),('watch_to_prepare','prepare',2),('prepare_to_enter','enter',2),('prepare_to_enter_breakout','enter',1),('enter_to_prepare','prepare',2),('prepare_to_watch','watch',2),('active_to_invalidated','invalidated',1),('invalidated_to_watch','watch',3)),
 wk as (select instrument_id, (select min(session_ix)-1 from ri) as session_ix, null::varchar as stage, null::varchar as pend, 0 as cnt, 0 as miss, 0 as held, null::varchar as status, null::double as conf from ky
  union all select instrument_id, session_ix, x.stage, x.pend, x.cnt, x.miss, x.held, x.status, conf from (
   select g.instrument_id, g.session_ix, g.cf+0.15::double*least(w.held/3,1.0) as conf, case
    when g.cf is null and w.miss=0 then {{'stage': w.stage, 'pend': w.pend, 'cnt': w.cnt, 'miss': 1, 'held': w.held, 'status': 'unavailable_stale'}}
    when g.cf is null then {{'stage': null, 'pend': null, 'cnt': 0, 'miss': w.miss+1, 'held': 0, 'status': 'unavailable_null'}}
    when rl.rule is null then {{'stage': w.stage, 'pend': null, 'cnt': 0, 'miss': 0, 'held': case when w.stage is null then 0 else least(w.held+1,3) end, 'status': case when w.pend is not null then 'pending_reversed' when w.stage is null then 'not_listed' else 'held' end}}
    when (case when w.pend=rl.rule then w.cnt+1 else 1 end)<rl.n then {{'stage': w.stage, 'pend': rl.rule, 'cnt': case when w.pend=rl.rule then w.cnt+1 else 1 end, 'miss': 0, 'held': case when w.stage is null then 0 else least(w.held+1,3) end, 'status': 'pending'}}
    else {{'stage': rl.tgt, 'pend': null, 'cnt': 0, 'miss': 0, 'held': 1, 'status': case when rl.rule='not_listed_to_watch' then 'listed' when rl.tgt='invalidated' then 'invalidated' else 'switched' end}} end as x
   from wk w join gr g on g.instrument_id=w.instrument_id and g.session_ix=w.session_ix+1
   left join rl on rl.rule=case when w.stage is null then r0 when w.stage='watch' then r1 when w.stage='prepare' then r2 when w.stage='enter' then r3 else r4 end))"""


def _stages(t):
    stock = stock_panel(t)
    return stage_history(stage_facts(t, stock).join(stored(market_states(t, stock), "states"), "session_ix", "left"), *session_range(t, "month"), PRICE_FLOOR, LIQUIDITY_FLOOR)


@query("str_03_candidate_stages", f"with recursive {_STAGE} select {IDS}, stage, pend as pending_rule, cnt as pending_count, status, held as stage_count, {R('conf')} as confidence from wk where session_ix>=(select min(session_ix) from ri)")
def _(t):
    return _stages(t).select(*ID, "stage", "pending_rule", "pending_count", "status", "stage_count", rnd("confidence").alias("confidence"))


@query("job_17_stage_summary", f"with recursive {_STAGE} select session_ix, coalesce(stage,'none') as stage, count(*) as n from wk where session_ix>=(select min(session_ix) from ri) group by 1,2")
def _(t):
    return _stages(t).groupBy("session_ix", F.coalesce("stage", F.lit("none")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("str_05_append_vs_replay", f"""with recursive {_STAGE}, fs as (select instrument_id, min(session_ix) as f from ri group by 1), w2 as (select wk.* from wk join fs on fs.instrument_id=wk.instrument_id and wk.session_ix>=f)
 select count(*) as n_append, count(*) as n_replay, cast(0 as bigint) as only_append, cast(0 as bigint) as only_replay, (select count(*) from ri where session_ix=(select min(session_ix)+2 from ri)) as n_late, count(*) filter (status='switched') as n_switched, count(distinct stage) as n_stages from w2""")
def _(t):
    first, last = session_range(t, "month")
    stock = stock_panel(t)
    facts, states = stored(stage_facts(t, stock), "facts"), stored(market_states(t, stock).where("regime is not null"), "states")
    replay = stage_history(facts.join(states, "session_ix", "left"), first, last, PRICE_FLOOR, LIQUIDITY_FLOOR)
    listed = facts.groupBy("instrument_id").agg(F.min("session_ix").alias("_f"))
    replay = replay.join(listed, "instrument_id").where("session_ix >= _f")
    appended = SS.appended(facts, states, first, last, PRICE_FLOOR, LIQUIDITY_FLOOR)
    columns = [*ID, "stage", "pending_rule", "pending_count", "status", "stage_count", F.round("confidence", 9).alias("confidence")]
    append, replay = stored(appended.where("not late").select(columns), "append"), stored(replay.select(columns), "replay")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [count(append, "n_append"), count(replay, "n_replay"), count(append.exceptAll(replay), "only_append"), count(replay.exceptAll(append), "only_replay"), count(appended.where("late"), "n_late"),
             append.agg(F.count_if(F.col("status") == "switched").alias("n_switched"), F.countDistinct("stage").alias("n_stages"))]
    return reduce(attach_one_row, parts)
