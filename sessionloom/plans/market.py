"""Market regime plans: dimension metrics of every session at once, composite score, alignment, rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.numeric import normalised, quantise, ratio, redistribute, sorted_middle
from sessionloom.functions.ranking import median_mad
from sessionloom.operators import windows as W
from sessionloom.operators.aggregates import top_decile_share
from sessionloom.params.regime import DIMENSIONS, MINIMUM_COMPOSITE_WEIGHT, MINIMUM_DIMENSION_WEIGHT, REQUIRED_DIMENSIONS

S = "session_ix"


def benchmark_metrics(broad: DataFrame, market: DataFrame, required: int, minimum: int) -> DataFrame:
    """JOB-02: broad benchmark returns, share above SMA20, direction agreement; market realised volatility.

    A session holds a handful of registered benchmarks, so short arrays carry the medians.
    """
    b = W.trailing_means(W.add_returns(broad, lags=(5, 20)))
    g = b.groupBy(S).agg(
        F.collect_list("r20").alias("a20"), F.collect_list("r5").alias("a5"),
        F.count("above20").alias("n_sma"), F.avg(F.col("above20").cast("double")).alias("sma"))
    med5 = sorted_middle(F.col("a5"))
    agree = F.size(F.filter("a5", lambda x: F.signum(x) == F.signum(F.col("m5")))) / F.size("a5")
    g = g.withColumn("m5", med5)
    vol = W.realised_volatility(market, windows=(10,)).select(S, F.col("rv10").alias("spy_realized_volatility_10"))
    enough = F.size("a5") >= minimum
    return g.select(
        S,
        F.when(F.size("a20") == required, sorted_middle(F.col("a20"))).alias("broad_return_20"),
        F.when(F.size("a5") == required, F.col("m5")).alias("broad_return_5"),
        F.when(F.col("n_sma") >= minimum, F.col("sma")).alias("broad_above_sma20_share"),
        F.when(enough, agree).alias("broad_direction_agreement"),
        F.when(enough, agree).alias("benchmark_direction_agreement_5"),
    ).join(vol, S, "left")


def member_features(members: DataFrame) -> DataFrame:
    """What a session needs of each member: returns, trailing extremes and means, volatility, dollar volume. No frame is longer than 26 sessions."""
    b = W.volume_ratio(W.realised_volatility(W.trailing_means(W.add_returns(members, lags=(1, 5))), windows=(10,)))
    return b.select("*", W.full(F.max("close"), 20).alias("hi20"), W.full(F.min("close"), 20).alias("lo20"), (F.col("close") * F.col("volume")).alias("dv"))


def cross_sections(b: DataFrame, min_positive: int) -> DataFrame:
    """One row per session of member features: counts, shares, sums and robust spreads."""
    c = F.col
    share = lambda cond, known: F.avg(F.when(known, cond.cast("double")))
    has1 = c("r1").isNotNull()
    g = b.groupBy(S).agg(
        F.count(F.lit(1)).alias("n_bars"), F.count("r1").alias("n1"), F.count("r5").alias("n5"), F.count("sma20").alias("n20"), F.count("rv10").alias("nv"),
        share(c("r1") > 0, has1).alias("adv"), share(c("r5") > 0, c("r5").isNotNull()).alias("pos5"), F.avg(c("above20").cast("double")).alias("above"),
        (F.avg(F.when(c("hi20").isNotNull(), (c("close") == c("hi20")).cast("double") - (c("close") == c("lo20")).cast("double")))).alias("balance"),
        F.count_if(c("r1") <= -0.04).alias("n_tail"), F.sum("dv").alias("dv_all"), F.sum(F.when(has1, c("dv"))).alias("dv1"),
        F.sum(F.when(has1 & (c("r1") > 0), c("dv")).otherwise(0.0)).alias("dv_up"),
        F.count("prior_median_volume").alias("n_own"), F.avg((c("volume") > c("prior_median_volume")).cast("double")).alias("own"))
    tall = b.select(S, F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), c(k).alias("x")) for k in ("r1", "r5", "rv10")])).alias("_e")).select(S, "_e.*")
    mm = median_mad(tall, [S, "metric"], "x").groupBy(S).agg(
        F.max(F.when(c("metric") == "r1", c("mad"))).alias("mad1"), F.max(F.when(c("metric") == "r5", c("mad"))).alias("mad5"), F.max(F.when(c("metric") == "rv10", c("med"))).alias("med_rv"))
    top = top_decile_share(b, [S], "r5", min_positive).select(S, c("concentration"))
    return g.join(mm, S, "left").join(top, S, "left")


def metrics_of_sessions(g: DataFrame, n_members: int | Column, min_obs: int) -> DataFrame:
    """JOB-03..06 from one row per session; the windows run over the calendar, the longest over 21 sessions."""
    c, total = F.col, F.lit(n_members) if isinstance(n_members, int) else n_members
    cal = Window.orderBy(S)
    last5, prior20 = cal.rangeBetween(-4, 0), cal.rangeBetween(-20, -1)
    g = g.withColumn("_dvc", F.when(c("n_bars") / total >= 0.80, c("dv_all")))
    ref = sorted_middle(F.collect_list("_dvc").over(prior20))
    cov = lambda n, floor: c(n) / total >= floor
    g = g.select(
        "*", F.sum("n1").over(last5).alias("n_possible"), F.sum("n_tail").over(last5).alias("n_tail5"),
        F.count("_dvc").over(prior20).alias("n_ref"), ref.alias("ref"))
    return g.select(
        S,
        F.when(cov("n1", 0.80) & (c("n1") >= min_obs), c("adv")).alias("advancer_share_1"),
        F.when(cov("n5", 0.80), c("pos5")).alias("positive_return_share_5"),
        F.when(cov("n20", 0.75), c("above")).alias("above_sma20_share"),
        F.when(cov("n20", 0.75), c("balance")).alias("high_low_balance_20"),
        F.when(cov("nv", 0.70), c("med_rv")).alias("median_stock_realized_volatility_10"),
        F.when(c("n_possible") / (total * 5) >= 0.70, c("n_tail5") / c("n_possible")).alias("downside_tail_frequency_5"),
        F.when(c("n1") >= min_obs, 1.4826 * c("mad1")).alias("cross_sectional_dispersion_1"),
        F.when(cov("n_bars", 0.80) & (c("n_ref") >= 18), ratio("dv_all", "ref")).alias("aggregate_participation_ratio"),
        F.when(cov("n1", 0.80), ratio("dv_up", "dv1")).alias("up_participation_share"),
        F.when(cov("n_own", 0.70), c("own")).alias("above_own_volume_median_share"),
        F.when(cov("n5", 0.70), c("concentration")).alias("winner_concentration_5"),
        F.when(c("n5") >= min_obs, 1.4826 * c("mad5")).alias("return_dispersion_5"),
    )


def member_metrics(members: DataFrame, n_members: int | Column, min_obs: int, min_positive: int) -> DataFrame:
    """JOB-03..06: breadth, volatility, participation and leadership metrics per session."""
    return metrics_of_sessions(cross_sections(member_features(members), min_positive), n_members, min_obs)


def _weighted(score: Column, weight: Column) -> Column:
    """score * weight / 100 to four digits, half-even on exact decimals (a binary product can miss a tie)."""
    exact = score.cast("decimal(14,10)") * weight.cast("decimal(7,4)") * F.lit("0.01").cast("decimal(3,2)")
    return F.bround(exact, 4).cast("double")


def composite(metrics: DataFrame) -> DataFrame:
    """JOB-07: normalise, spread weights over available metrics, null when a floor fails."""
    df = metrics
    for dim, (_, items) in DIMENSIONS.items():
        weights = redistribute([(F.col(m).isNotNull(), w) for m, *_, w in items])
        have = sum((F.when(F.col(m).isNotNull(), w).otherwise(0) for m, *_, w in items), F.lit(0))
        total = F.lit(0.0)
        for (m, method, low, high, center, _), eff in zip(items, weights):
            score = quantise(normalised(m, method, low, high, center), 10)
            total = total + F.coalesce(_weighted(score, eff), F.lit(0.0))
        df = df.withColumn(f"{dim}_score", F.when(have >= MINIMUM_DIMENSION_WEIGHT, quantise(total)))
    parts = [(d, w, F.col(f"{d}_score")) for d, (w, _) in DIMENSIONS.items()]
    weight = sum((F.when(s.isNotNull(), w).otherwise(0) for _, w, s in parts), F.lit(0))
    needed = F.lit(True)
    for d in REQUIRED_DIMENSIONS:
        needed = needed & F.col(f"{d}_score").isNotNull()
    value = sum((F.coalesce(_weighted(s, F.lit(w)), F.lit(0.0)) for _, w, s in parts), F.lit(0.0))
    return df.select("*", weight.alias("weight_available"), F.when((weight >= MINIMUM_COMPOSITE_WEIGHT) & needed, quantise(value)).alias("regime_score"))


def relationship_state(pairs: DataFrame) -> DataFrame:
    """JOB-10: pair state (break > rotation > divergence > synchronous > neutral) and confidence."""
    df = W.ratio_statistics(W.pair_windows(pairs))
    c = F.col
    prior_corr, prior_z, prior_spread = W.lagged("corr20", 5), W.lagged("ratio_z", 1), W.lagged("spread5", 1)
    df = df.select("*", prior_corr.alias("corr_prior"), prior_z.alias("z_prior"), prior_spread.alias("spread_prior"),
                   F.count(F.lit(1)).over(W.BY.rowsBetween(Window.unboundedPreceding, 0)).alias("n_paired"))
    same = lambda a, b: (F.signum(a) == F.signum(b)) & (F.signum(a) != 0)
    brk = (c("corr_prior") >= 0.60) & (c("corr20") <= 0.20) & (c("corr20") - c("corr_prior") <= -0.40)
    rot = (F.abs("ratio_z") >= 2.0) & (F.abs("z_prior") >= 2.0) & same(c("ratio_z"), c("spread5")) & same(c("z_prior"), c("spread_prior"))
    state = (
        F.when(c("spread5").isNull(), "unavailable").when(brk, "relationship_break_candidate").when(rot, "rotation_candidate")
        .when((c("left_ret5") * c("right_ret5") < 0) & (F.abs("spread5") >= 0.02), "divergence")
        .when((c("left_ret5") > 0) & (c("right_ret5") > 0) & (c("corr20") >= 0.35), "synchronous_strengthening")
        .when((c("left_ret5") < 0) & (c("right_ret5") < 0) & (c("corr20") >= 0.35), "synchronous_weakening").otherwise("neutral"))
    conf = (
        F.when(c("n_paired") < 21, "insufficient").when(c("n_paired") < 60, "low")
        .when(~c("perturbation_consistent"), "low").when(c("n_paired") < 120, "medium")
        .when(c("nonoverlap_consistent"), "high").otherwise("medium"))
    return df.select("*", state.alias("relationship_state"), conf.alias("confidence"))


def rotation(df: DataFrame) -> DataFrame:
    """JOB-13: relative returns, peer ranks, acceleration, posture and leadership run of sector funds."""
    from sessionloom.operators.crosssection import peer_rank

    df = peer_rank(W.relative_strength(df), "rel20")
    r, a = F.col("rel20"), F.col("acceleration")
    posture = (
        F.when(r.isNull() | a.isNull(), "unavailable").when((r == 0) | (a == 0), "neutral").when((r > 0) & (a > 0), "leading_improving")
        .when(r > 0, "leading_weakening").when(a > 0, "lagging_improving").otherwise("lagging_weakening"))
    df = df.select("*", posture.alias("posture"), F.signum("rel5").cast("int").alias("lead_sign"))
    runs = W.state_runs(df.where("rel5 is not null"), "lead_sign").select("instrument_id", S, "run_length", "reaches_start")
    return df.join(runs, ["instrument_id", S], "left")
