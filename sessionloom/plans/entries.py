"""Entry review of candidates: geometry facts, extension risk, setup and posture, lanes, continuation facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.numeric import first_failing, sorted_middle
from sessionloom.operators import windows as W
from sessionloom.operators.filters import entry_lane
from sessionloom.params import entry as E


def geometry_facts(bars: DataFrame) -> DataFrame:
    """JOB-18 facts of each bar that ends twenty contiguous sessions; distances are in units of ATR(14)."""
    df = W.prior_extremes(W.average_true_range(W.trailing_means(W.realised_volatility(W.volume_ratio(W.up_run(bars)), windows=(10,)))))
    df = df.select("*", W.contiguous(20).alias("_whole"), W.simple_return(5).alias("return5"), W.lagged("close", 1).alias("_pc"))
    c = F.col
    ok = c("_whole") & (c("atr14") > 0) & (c("rv10") > 0) & c("volume_ratio").isNotNull() & (c("high") > c("low"))
    df = df.withColumn("available", F.coalesce(ok, F.lit(False)))
    unit = F.when(c("available"), c("atr14"))
    base = df.select(
        "instrument_id", "session_ix", "available", "close", "sma20", "up_run", "volume_ratio", "prior_low",
        ((c("close") - c("sma10")) / unit).alias("to_sma10"), ((c("close") - c("sma20")) / unit).alias("to_sma20"),
        F.when(c("available"), c("return5") / (c("rv10") / F.sqrt(F.lit(252.0)) * F.sqrt(F.lit(5.0)))).alias("move5"),
        ((c("open") - c("_pc")) / unit).alias("gap"), ((c("high") - c("low")) / unit).alias("range"),
        F.when(c("available"), (c("close") - c("low")) / (c("high") - c("low"))).alias("location"), ((c("close") - c("prior_high")) / unit).alias("breakout"))
    support = F.greatest(F.when(c("sma20") <= c("close"), c("sma20")), F.when(c("prior_low") <= c("close"), c("prior_low")))
    return base.withColumn("support", F.when(c("available"), support))


def entry_review(facts: DataFrame) -> DataFrame:
    """Extension, setup, posture, reason and lane of facts that carry score, relative strength, trend and quality.

    A reason is null where the setup is ready for review.
    """
    c = F.col
    climax = (c("volume_ratio") >= E.CLIMAX_VOLUME) & (c("range") >= E.CLIMAX_RANGE) & (c("location") >= E.CLIMAX_LOCATION)
    beyond = lambda k: (c("to_sma20") >= E.EXTENDED[k][0]) | (c("move5") >= E.EXTENDED[k][1])
    rising = lambda k: (c("up_run") >= E.RUN[k][0]) & (c("to_sma10") >= E.RUN[k][1])
    extension = first_failing(
        (~c("available"), "unavailable"),
        (beyond("extreme") | ((c("gap") >= E.GAP["extreme"]) & (c("to_sma20") >= E.EXTENDED["high"][0])), "extreme"),
        (beyond("high") | rising("high") | climax, "high"),
        (beyond("moderate") | rising("moderate") | (c("gap") >= E.GAP["moderate"]), "moderate"), ok="low")
    df = facts.withColumn("extension", extension)
    strong = F.coalesce((c("score") >= E.STRONG_SCORE) & (c("relative") >= E.COMPONENT_FLOOR) & (c("trend") >= E.COMPONENT_FLOOR), F.lit(False))
    breakout = (c("score") >= E.BREAKOUT_SCORE) & (c("breakout") > 0) & (c("breakout") <= E.BREAKOUT_DISTANCE) & c("volume_ratio").between(*E.BREAKOUT_VOLUME) & (c("location") >= E.BREAKOUT_LOCATION)
    pullback = (c("close") >= c("sma20")) & (F.abs("to_sma10") <= E.PULLBACK_NEAR) & (-c("breakout")).between(*E.PULLBACK_DEPTH) & (c("volume_ratio") <= E.PULLBACK_VOLUME) & (c("location") >= E.PULLBACK_LOCATION)
    watch = c("breakout").between(-E.WATCH_DISTANCE, 0.0) & (c("volume_ratio") <= E.WATCH_VOLUME)
    case = first_failing(
        (~c("available"), "unavailable"), (c("blocked"), "blocked"), (c("score").isNull() | (c("score") < E.SCORE_FLOOR), "weak"),
        (c("extension").isin("high", "extreme"), "extended"), (~strong, "none"), (breakout, "breakout_confirmed"), (pullback, "pullback"), (watch, "breakout_watch"), ok="none")
    df = df.withColumn("_case", case).withColumn("strong", strong)
    k = c("_case")
    ready = k.isin("breakout_confirmed", "pullback")
    setup = F.when(k == "unavailable", "unavailable").when((k == "extended") & c("strong"), "strong_but_extended").when(ready | (k == "breakout_watch"), k).otherwise("no_viable_setup")
    posture = F.when(k == "unavailable", "not_assessable").when(k.isin("blocked", "weak"), "deprioritized").when(k == "extended", "wait_for_reset").when(ready, "technical_review_ready").otherwise("monitor_for_trigger")
    reason = (F.when(k == "unavailable", "entry_geometry_required_facts_unavailable").when(k == "blocked", "candidate_source_quality_blocked").when(k == "weak", "candidate_score_below_research_floor")
              .when(k == "extended", F.concat(F.lit("extension_risk_"), c("extension"))).when(k == "breakout_watch", "breakout_not_confirmed").when(k == "none", "no_viable_entry_geometry"))
    df = df.withColumn("setup", setup).withColumn("posture", posture).withColumn("reason", reason)
    return df.withColumn("lane", entry_lane(c("posture"))).drop("_case")


def publication_lanes(reviewed: DataFrame, gates: dict[str, Column], shares: dict[str, float], cap: int = E.LANE_CAP) -> DataFrame:
    """JOB-23: for each mode, the members of a lane that pass its gate, in leadership order.

    A driver fills at most its share of a lane; ``qualifying`` counts the lane before both limits.
    """
    modes = F.array_compact(F.array(*[F.when(gate, F.struct(F.lit(m).alias("mode"), F.lit(max(1, int(cap * shares[m]))).alias("most"))) for m, gate in gates.items()]))
    df = reviewed.withColumn("_m", F.explode(modes)).select("*", "_m.mode", "_m.most").drop("_m").withColumn("driver", F.coalesce("driver", F.lit("unclassified")))
    counts = df.groupBy("session_ix", "mode", "lane").agg(F.count(F.lit(1)).alias("qualifying"))
    order = [F.desc(F.round("score", 6)), F.desc(F.round("relative", 6)), F.col("instrument_id")]
    one = df.withColumn("_g", F.row_number().over(Window.partitionBy("session_ix", "mode", "lane", "driver").orderBy(*order))).where("_g <= most")
    top = one.withColumn("rank", F.row_number().over(Window.partitionBy("session_ix", "mode", "lane").orderBy(*order))).where(F.col("rank") <= cap)
    return top.join(counts, ["session_ix", "mode", "lane"]).select("session_ix", "mode", "lane", "rank", "instrument_id", "driver", "qualifying")


def continuation_facts(bars: DataFrame) -> DataFrame:
    """JOB-19: how orderly the last ten returns were, and how tight the base was as known one session before."""
    df = W.true_range(W.path_shape(bars))
    df = df.select("*", W.full(F.avg("close"), 10).alias("_s10"), W.needs("tr", 14, F.avg("tr")).alias("_a14"), W.needs("tr", 5, F.avg("tr")).alias("_a5"), W.contiguous(21).alias("_whole"))
    c, rows = F.col, W.rows
    df = df.select(
        "*", W.simple_return(10).alias("_net"), F.lag("_a14").over(W.BY).alias("_p14"), F.lag("_a5").over(W.BY).alias("_p5"), F.lag("_s10", 5).over(W.BY).alias("_s10_5"),
        F.lag("close").over(W.BY).alias("_pc"), F.sum((c("close") > c("_s10")).cast("int")).over(rows(10)).alias("_over"), F.max("close").over(rows(21)).alias("_top"),
        F.min("close").over(rows(5)).alias("_lo"), F.max("close").over(rows(5)).alias("_hi"), F.min("close").over(rows(5, 5)).alias("_plo"), F.max("close").over(rows(5, 5)).alias("_phi"),
        F.max("close").over(rows(10, 1)).alias("_bhi"), F.min("close").over(rows(10, 1)).alias("_blo"), F.max("close").over(rows(20, 1)).alias("_high20"),
        sorted_middle(F.collect_list("volume").over(rows(5))).alias("_v5"), sorted_middle(F.collect_list("volume").over(rows(15, 5))).alias("_v15"), F.sum(F.abs("lr")).over(rows(10)).alias("_path"))
    ok = F.coalesce(c("_whole") & (c("_a14") > 0) & (c("_p14") > 0) & (c("_v15") > 0), F.lit(False))
    unit, before = F.when(ok, c("_a14")), F.when(ok, c("_p14"))
    whole = lambda x: F.when(ok, x)
    return df.select(
        "instrument_id", "session_ix", ok.alias("available"), whole(c("_net")).alias("net_return_10"), whole(F.coalesce("discreteness", F.lit(0.0))).alias("information_discreteness_10"),
        whole(F.coalesce(F.abs("path_efficiency"), F.lit(0.0))).alias("path_efficiency_10"), whole(F.coalesce("largest_share", F.lit(0.0))).alias("largest_share_10"), whole(c("positive_share")).alias("positive_share_10"),
        whole(c("_over") / 10.0).alias("above_sma10_share_10"), ((c("_s10") - c("_s10_5")) / unit).alias("sma10_slope_5_atr"), (c("_a5") / unit).alias("atr_5_to_14"), ((c("_top") - c("close")) / unit).alias("drawdown_20_atr"),
        ((c("_lo") - c("_plo")) / unit).alias("low_vs_prior_5_atr"), ((c("_hi") - c("_phi")) / unit).alias("high_vs_prior_5_atr"), whole(c("_v5") / c("_v15")).alias("volume_5_to_prior_15"),
        ((c("_bhi") - c("_blo")) / before).alias("base_range_10_atr"), (c("_p5") / before).alias("prior_atr_5_to_14"), ((c("close") - c("_high20")) / before).alias("close_vs_high_20_atr"),
        ((c("close") - c("_pc")) / before).alias("close_move_atr"), ((c("close") - c("open")) / before).alias("intraday_move_atr"), whole(F.when(c("_path") > 0, F.abs("lr") / c("_path")).otherwise(0.0)).alias("current_share_10"))


def _channel_status(channel: str) -> Column:
    """advance / watch / deprioritized of an assessable candidate."""
    setup, c = F.col("setup"), F.col
    if channel == "momentum_breakout":
        return first_failing((setup == "breakout_confirmed", "advance_to_research"), (setup.isin("breakout_watch", "strong_but_extended"), "watch_for_trigger"), ok="deprioritized")
    if channel == "strong_stock_pullback":
        return first_failing((setup == "pullback", "advance_to_research"), (setup == "strong_but_extended", "watch_for_trigger"), ok="deprioritized")
    high = c("stock_relative_strength") >= E.TREND_ADVANCE
    advance = c("advanced") & c("extension").isin("low", "moderate") & high & (c("trend_quality") >= E.TREND_ADVANCE)
    watch = (c("score") >= E.TREND_WATCH_BASE) & (c("stock_relative_strength") >= E.TREND_WATCH) & (c("trend_quality") >= E.TREND_WATCH)
    return first_failing((advance, "advance_to_research"), (watch, "watch_for_trigger"), ok="deprioritized")


def channels(reviewed: DataFrame) -> DataFrame:
    """JOB-20: status, score and rank of every candidate in each channel that prices and volumes can answer.

    A candidate has advanced when it was strong in this session and the one before (two sessions confirm a step). Ranks count those that
    advance or are watched, in that order, by score and ticker; a session's ranks are distributed, not one window.
    """
    from sessionloom.functions.ranking import rank_table

    df = reviewed.withColumn("advanced", F.coalesce(F.col("strong") & W.lagged("strong", 1), F.lit(False)))
    made = []
    for name, weights in E.CHANNEL_WEIGHTS.items():
        setup = F.element_at(F.create_map(*[F.lit(x) for kv in E.SETUP_SCORES[name].items() for x in kv]), F.col("setup"))
        score = sum((F.col(k) * w if k != "setup" else setup * w for k, w in weights.items()), F.lit(0.0))
        ok = F.col("available") & score.isNotNull()
        made.append(F.struct(F.lit(name).alias("channel"), F.when(ok, _channel_status(name)).otherwise("unavailable").alias("status"), F.when(ok, F.round(score, 6)).alias("channel_score")))
    df = df.withColumn("_c", F.explode(F.array(*made))).select("session_ix", "instrument_id", "ticker", "_c.*")
    listed = df.where(F.col("status").isin("advance_to_research", "watch_for_trigger")).withColumn("below", -F.col("channel_score"))
    tied = ["session_ix", "channel", "status", "below"]
    r = rank_table(listed, tied[:3], "below").select(*tied, "n_lower")
    first = listed.groupBy("session_ix", "channel").agg(F.count_if(F.col("status") == "advance_to_research").alias("n_first"))
    among = F.row_number().over(Window.partitionBy(*tied).orderBy("ticker", "instrument_id"))
    ranked = listed.withColumn("_among", among).join(r, tied).join(first, ["session_ix", "channel"])
    rank = F.col("n_lower") + F.col("_among") + F.when(F.col("status") == "watch_for_trigger", F.col("n_first")).otherwise(0)
    ranked = ranked.select("session_ix", "channel", "instrument_id", rank.cast("bigint").alias("rank"))
    return df.join(ranked, ["session_ix", "channel", "instrument_id"], "left")


def channel_overlap(assessed: DataFrame) -> DataFrame:
    """JOB-21: per session and pair of channels, how far their members coincide; counts per instrument come first."""
    names = list(E.CHANNEL_WEIGHTS)
    listed = F.col("status").isin("advance_to_research", "watch_for_trigger")
    sets = assessed.groupBy("session_ix", "instrument_id").agg(*[F.bool_or(listed & (F.col("channel") == n)).alias(n) for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows = F.array(*[F.struct(F.lit(a).alias("left_channel"), F.lit(b).alias("right_channel"), F.col(a).alias("l"), F.col(b).alias("r")) for a, b in pairs])
    per = sets.select("session_ix", F.explode(rows).alias("p")).select("session_ix", "p.*")
    c, n = F.col, F.count_if
    g = per.groupBy("session_ix", "left_channel", "right_channel").agg(
        n(c("l")).alias("n_left"), n(c("r")).alias("n_right"), n(c("l") & c("r")).alias("n_both"), n(c("l") | c("r")).alias("n_union"), n(c("l") & ~c("r")).alias("left_only"), n(c("r") & ~c("l")).alias("right_only"))
    return g.withColumn("jaccard", F.when(c("n_union") > 0, c("n_both") / c("n_union")).otherwise(0.0)).withColumn("left_in_right", c("left_only") == 0).withColumn("right_in_left", c("right_only") == 0)
