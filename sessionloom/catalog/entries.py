"""JOB-18 to 21, 23, 64: entry review, continuation facts, channels and their overlap, publication lanes, execution costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.candidates import MODES, SCORE_SQL, _scored, stock_panel
from sessionloom.catalog.core import R, query
from sessionloom.catalog.filters import RISK_SQL, risk_input
from sessionloom.catalog.scalars import ASSUMPTIONS
from sessionloom.catalog.sqltext import I, bars as B, cont, full, lag, lr, needs, ret, rows
from sessionloom.functions import scalars as S
from sessionloom.functions.numeric import rnd
from sessionloom.functions.staging import stored
from sessionloom.params import entry as E
from sessionloom.plans import entries as P
from sessionloom.sources.fixtures import bars, master

ID = ["instrument_id", "session_ix"]
IDS = "instrument_id, session_ix"

_TR = f"case when {lag('close', 1)} is not null then greatest(high-low, abs(high-{lag('close', 1)}), abs(low-{lag('close', 1)})) end"
_RUN = " ".join(f"when coalesce(lag(up,{k}) {I},0)=0 then {k}" for k in range(1, 5))
GEOMETRY_SQL = f"""{SCORE_SQL}, g1 as (select *, {_TR} as tr, coalesce((close>{lag('close', 1)})::int,0) as up, {cont(20)} as whole, {lag('close', 1)} as pc,
   case when {cont(6)} then max(close) {rows(5, 1)} end as ph, case when {cont(6)} then min(close) {rows(5, 1)} end as pl from sc),
 g2 as (select *, {needs('tr', 14, 'avg(tr)')} as atr, case when up=0 then 0 {_RUN} else 5 end as run from g1),
 g3 as (select *, coalesce(whole and atr>0 and rv10>0 and vr is not null and high>low, false) as available, base_score as score, stock_relative_strength as relative, trend_quality as trend from g2),
 g4 as (select *, case when available then (close-s10)/atr end as d10, case when available then (close-s20)/atr end as d20, case when available then r5/(rv10/sqrt(252)*sqrt(5)) end as mv, case when available then (open-pc)/atr end as ga,
   case when available then (high-low)/atr end as rg, case when available then (close-low)/(high-low) end as lc, case when available then (close-ph)/atr end as bd,
   case when available then greatest(case when s20<=close then s20 end, case when pl<=close then pl end) end as support from g3),
 g5 as (select *, case when not available then 'unavailable' when d20>=3.5 or mv>=2.5 or (ga>=1.5 and d20>=2.5) then 'extreme' when d20>=2.5 or mv>=1.75 or (run>=4 and d10>=1.5) or (vr>=2 and rg>=1.5 and lc>=0.75) then 'high'
   when d20>=1.5 or mv>=1 or (run>=3 and d10>=1) or ga>=1 then 'moderate' else 'low' end as extension, coalesce(score>=65 and relative>=55 and trend>=55, false) as strong from g4),
 g6 as (select *, case when not available then 'unavailable' when score is null or score<50 then 'weak' when extension in ('high','extreme') then 'extended' when not strong then 'none'
   when score>=70 and bd>0 and bd<=0.75 and vr between 1.2 and 2.5 and lc>=0.6 then 'breakout_confirmed' when close>=s20 and abs(d10)<=0.75 and -bd between 0.25 and 2 and vr<=1.2 and lc>=0.35 then 'pullback'
   when bd between -0.75 and 0 and vr<=2 then 'breakout_watch' else 'none' end as k from g5),
 g7 as (select *, case when k='unavailable' then 'unavailable' when k='extended' and strong then 'strong_but_extended' when k in ('breakout_confirmed','pullback','breakout_watch') then k else 'no_viable_setup' end as setup,
   case when k='unavailable' then 'not_assessable' when k='weak' then 'deprioritized' when k='extended' then 'wait_for_reset' when k in ('breakout_confirmed','pullback') then 'technical_review_ready' else 'monitor_for_trigger' end as posture,
   case k when 'unavailable' then 'entry_geometry_required_facts_unavailable' when 'weak' then 'candidate_score_below_research_floor' when 'extended' then 'extension_risk_'||extension when 'breakout_watch' then 'breakout_not_confirmed' when 'none' then 'no_viable_entry_geometry' end as reason,
   case k when 'extended' then 'wait_reset' when 'breakout_confirmed' then 'review_now' when 'pullback' then 'review_now' when 'unavailable' then 'other_research' when 'weak' then 'other_research' else 'watch_trigger' end as lane from g6)"""
_OUT = {"to_sma10": "d10", "to_sma20": "d20", "move5": "mv", "gap": "ga", "range": "rg", "location": "lc", "breakout": "bd", "support": "support"}


_PARTS = ["stock_relative_strength", "trend_quality", "volume_participation", "volatility_risk", "liquidity_suitability"]


def reviewed(t):
    """Entry review of every scored bar."""
    stock = stock_panel(t)
    s = _scored(t, stock).select(*ID, F.col("base_score").alias("score"), F.col("stock_relative_strength").alias("relative"), F.col("trend_quality").alias("trend"), *_PARTS, "driver", "median_dv", "rv10", "max_gap", "confidence", F.lit(False).alias("blocked"))
    return P.entry_review(P.geometry_facts(stock).join(s, ID))


@query("job_18_entry_geometry", f"with {GEOMETRY_SQL} select {IDS}, available, extension, setup, posture, reason, lane, case when available then cast(run as int) end as up_run, " + ", ".join(f"{R(c, 8 if n == 'support' else 5)} as \"{n}\"" for n, c in _OUT.items()) + " from g7")
def _(t):
    r = reviewed(t)
    return r.select(*ID, "available", "extension", "setup", "posture", "reason", "lane", F.when(F.col("available"), F.col("up_run")).cast("int").alias("up_run"), *[rnd(n, 8 if n == "support" else 5).alias(n) for n in _OUT])


SHARES = {"conservative": 0.4, "balanced": 0.25, "aggressive": 0.35}


def _gate_sql(m):
    p = MODES[m]
    return (f"select *, '{m}' as mode, {max(1, int(E.LANE_CAP * SHARES[m]))} as most from g7 where score>=45 and confidence>={p['minimum_confidence']} and median_dv>={p['minimum_median_dollar_volume']} "
            f"and rv10<={p['maximum_annualized_volatility']} and max_gap<={p['maximum_absolute_open_gap']}")


@query("job_23_publication_lanes", f"""with {GEOMETRY_SQL}, md as ({' union all '.join(map(_gate_sql, SHARES))}), mg as (select *, coalesce(driver,'unclassified') as drv, count(*) over (partition by session_ix, mode, lane) as qualifying from md),
 m1 as (select *, row_number() over (partition by session_ix, mode, lane, drv order by round(score,6) desc, round(relative,6) desc, instrument_id) as gr from mg),
 m2 as (select *, row_number() over (partition by session_ix, mode, lane order by round(score,6) desc, round(relative,6) desc, instrument_id) as rank from m1 where gr<=most)
 select session_ix, mode, lane, rank, instrument_id, drv as driver, qualifying from m2 where rank<={E.LANE_CAP}""")
def _(t):
    c = F.col
    gates = {m: (c("score") >= 45) & (c("confidence") >= p["minimum_confidence"]) & (c("median_dv") >= p["minimum_median_dollar_volume"]) & (c("rv10") <= p["maximum_annualized_volatility"]) & (c("max_gap") <= p["maximum_absolute_open_gap"])
             for m, p in MODES.items() if m in SHARES}
    return P.publication_lanes(stored(reviewed(t).select(*ID, "lane", "driver", "score", "relative", "confidence", "median_dv", "rv10", "max_gap"), "reviewed"), gates, SHARES).withColumn("rank", F.col("rank").cast("bigint"))


_FACTS = ["net_return_10", "information_discreteness_10", "path_efficiency_10", "largest_share_10", "positive_share_10", "above_sma10_share_10", "sma10_slope_5_atr", "atr_5_to_14", "drawdown_20_atr", "low_vs_prior_5_atr", "high_vs_prior_5_atr",
          "volume_5_to_prior_15", "base_range_10_atr", "prior_atr_5_to_14", "close_vs_high_20_atr", "close_move_atr", "intraday_move_atr", "current_share_10"]
_FSQL = {
    "net_return_10": "nr", "information_discreteness_10": "coalesce(sign(net)*(ng-ps)/nullif(ng+ps,0),0.0)", "path_efficiency_10": "coalesce(abs(net)/nullif(path,0),0.0)", "largest_share_10": "coalesce(big/nullif(path,0),0.0)",
    "positive_share_10": "ps/10.0", "above_sma10_share_10": "ov/10.0", "sma10_slope_5_atr": "(s10-s105)/a14", "atr_5_to_14": "a5/a14", "drawdown_20_atr": "(tp-close)/a14", "low_vs_prior_5_atr": "(lo-plo)/a14", "high_vs_prior_5_atr": "(hi-phi)/a14",
    "volume_5_to_prior_15": "v5/v15", "base_range_10_atr": "(bhi-blo)/p14", "prior_atr_5_to_14": "p5/p14", "close_vs_high_20_atr": "(close-h20)/p14", "close_move_atr": "(close-pc)/p14", "intraday_move_atr": "(close-open)/p14",
    "current_share_10": "coalesce(abs(lr)/nullif(path,0),0.0)",
}


@query("job_19_continuation_facts", f"""with {B(grain='month')}, c1 as (select *, {lr()} as lr, {_TR} as tr, {full('avg(close)', 10)} as s10, {cont(21)} as whole, {ret(10)} as nr, lag(close) {I} as pc from b),
 c2 as (select *, {needs('tr', 14, 'avg(tr)')} as a14, {needs('tr', 5, 'avg(tr)')} as a5, sum(lr) {rows(10)} as net, sum(abs(lr)) {rows(10)} as path, max(abs(lr)) {rows(10)} as big, count(*) filter (lr>0) {rows(10)} as ps, count(*) filter (lr<0) {rows(10)} as ng,
   count(*) filter (close>s10) {rows(10)} as ov, lag(s10,5) {I} as s105, max(close) {rows(21)} as tp, min(close) {rows(5)} as lo, max(close) {rows(5)} as hi, min(close) {rows(5, 5)} as plo, max(close) {rows(5, 5)} as phi,
   max(close) {rows(10, 1)} as bhi, min(close) {rows(10, 1)} as blo, max(close) {rows(20, 1)} as h20, median(volume) {rows(5)} as v5, median(volume) {rows(15, 5)} as v15 from c1),
 c3 as (select *, lag(a14) {I} as p14, lag(a5) {I} as p5 from c2), c4 as (select *, coalesce(whole and a14>0 and p14>0 and v15>0, false) as ok from c3)
 select {IDS}, ok as available, {', '.join(f"case when ok then {R(e, 5)} end as {n}" for n, e in _FSQL.items())} from c4""")
def _(t):
    f = P.continuation_facts(bars(t, grain="month"))
    return f.select(*ID, "available", *[rnd(n, 5).alias(n) for n in _FACTS])


ORDER = 20000.0
_ASSUME = ",".join(f"('{a['name']}',{a['coefficient']},{a['commission']},{a['half_spread']},{a['delay']})" for a in ASSUMPTIONS)


@query("job_64_execution_costs", f"""with {RISK_SQL}, o as (select {IDS}, volatility/sqrt(252) as v, {ORDER}::double/median_dv as p from ri where volatility is not null and median_dv is not null), a(scenario, k, cm, hs, dl) as (values {_ASSUME}),
 u as (select {IDS}, scenario, round(p,8) as participation, round(k*v*sqrt(p)*1e4,4) as impact, round(k*v*sqrt(p)*1e4,4)+cm+hs+dl as total from o, a)
 select {IDS}, scenario, {R('participation', 8)} as participation, {R('total', 4)} as total_bps, {R(f'{ORDER}::double*total/1e4', 4)} as total_cost, case when participation<=0.1 then 'within_participation_limit' else 'above_participation_limit' end as capacity from u""")
def _(t):
    r = risk_input(t).where("volatility is not null and median_dv is not null")
    v, p = F.col("volatility") / F.sqrt(F.lit(252.0)), ORDER / F.col("median_dv")
    rows_ = F.array(*[F.struct(F.lit(a["name"]).alias("scenario"), S.impact_cost_bps(v, p, dict(a, commission=0.0, half_spread=0.0, delay=0.0)).alias("impact"), F.lit(a["commission"] + a["half_spread"] + a["delay"]).alias("fixed")) for a in ASSUMPTIONS])
    u = r.select(*ID, F.round(p, 8).alias("participation"), F.explode(rows_).alias("x")).select(*ID, "participation", "x.scenario", (F.round("x.impact", 4) + F.col("x.fixed")).alias("total"))
    return u.select(*ID, "scenario", rnd("participation", 8).alias("participation"), rnd("total", 4).alias("total_bps"), rnd(F.col("total") * (ORDER / 1e4), 4).alias("total_cost"),
                    F.when(F.col("participation") <= 0.1, "within_participation_limit").otherwise("above_participation_limit").alias("capacity"))


def _channel_sql(name):
    setup = " ".join(f"when '{k}' then {v}" for k, v in E.SETUP_SCORES[name].items())
    score = "0.0::double+" + "+".join(f"({k if k != 'setup' else f'(case setup {setup} end)'})*{w}::double" for k, w in E.CHANNEL_WEIGHTS[name].items())
    status = {
        "momentum_breakout": "case when setup='breakout_confirmed' then 'advance_to_research' when setup in ('breakout_watch','strong_but_extended') then 'watch_for_trigger' else 'deprioritized' end",
        "strong_stock_pullback": "case when setup='pullback' then 'advance_to_research' when setup='strong_but_extended' then 'watch_for_trigger' else 'deprioritized' end",
        "trend_continuation": "case when advanced and extension in ('low','moderate') and stock_relative_strength>=65 and trend_quality>=65 then 'advance_to_research' when score>=65 and stock_relative_strength>=55 and trend_quality>=55 then 'watch_for_trigger' else 'deprioritized' end",
    }[name]
    return f"select {IDS}, '{name}' as channel, case when available and ({score}) is not null then {status} else 'unavailable' end as status, case when available then round({score},6) end as cs from g8"


CHANNEL_SQL = f"""{GEOMETRY_SQL}, tk as (select s_suppkey as instrument_id, s_name as ticker from supplier), g8 as (select *, coalesce(strong and {lag('strong', 1)}, false) as advanced from g7), ch as ({' union all '.join(map(_channel_sql, E.CHANNEL_WEIGHTS))})"""


_ASSESSED = [*ID, "ticker", "available", "setup", "extension", "strong", "score", *_PARTS]


@query("job_20_strategy_channels", f"""with {CHANNEL_SQL}, rk as (select {IDS}, channel, row_number() over (partition by session_ix, channel order by status, cs desc, ticker, instrument_id) as rank from ch join tk using (instrument_id) where status in ('advance_to_research','watch_for_trigger'))
 select ch.instrument_id, ch.session_ix, ch.channel, status, {R('cs', 6)} as channel_score, rank from ch left join rk on rk.instrument_id=ch.instrument_id and rk.session_ix=ch.session_ix and rk.channel=ch.channel""")
def _(t):
    r = reviewed(t).join(master(t).select("instrument_id", "ticker"), "instrument_id")
    return P.channels(stored(r.select(*_ASSESSED), "reviewed")).select(*ID, "channel", "status", rnd("channel_score", 6).alias("channel_score"), "rank")


@query("job_21_channel_overlap", f"""with {CHANNEL_SQL}, s as (select session_ix, instrument_id, {', '.join(f"bool_or(channel='{n}' and status in ('advance_to_research','watch_for_trigger')) as {n}" for n in E.CHANNEL_WEIGHTS)} from ch group by 1,2),
 p as ({' union all '.join(f"select session_ix, '{a}' as left_channel, '{b}' as right_channel, {a} as l, {b} as r from s" for i, a in enumerate(E.CHANNEL_WEIGHTS) for b in list(E.CHANNEL_WEIGHTS)[i + 1:])}),
 g as (select session_ix, left_channel, right_channel, count(*) filter (l) as n_left, count(*) filter (r) as n_right, count(*) filter (l and r) as n_both, count(*) filter (l or r) as n_union, count(*) filter (l and not r) as left_only, count(*) filter (r and not l) as right_only from p group by 1,2,3)
 select *, {R('case when n_union>0 then n_both/n_union else 0.0 end')} as jaccard, left_only=0 as left_in_right, right_only=0 as right_in_left from g""")
def _(t):
    r = reviewed(t).join(master(t).select("instrument_id", "ticker"), "instrument_id")
    return P.channel_overlap(P.channels(stored(r.select(*_ASSESSED), "reviewed"))).withColumn("jaccard", rnd("jaccard"))
