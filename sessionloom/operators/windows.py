"""Per-instrument window metrics over bars.

Every frame counts sessions, not rows: a missing bar voids the metric (or, where a
minimum count applies, lowers the count).  All columns of one call share one
partition and sort, and a group is bounded by the calendar (one row per session).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sessionloom.functions.numeric import col, ratio, sorted_middle

ANNUAL = 252.0


def series() -> WindowSpec:
    """One instrument in session order."""
    return Window.partitionBy("instrument_id").orderBy("session_ix")


def __getattr__(name: str):
    # a window needs a running session, so the shared one is built on use, not on import
    if name == "BY":
        return series()
    raise AttributeError(name)


def rows(n: int, end: int = 0, by=None):
    """The last ``n`` rows ending ``end`` rows before the current one."""
    return (by or series()).rowsBetween(-(n - 1) - end, -end)


def sessions(n: int, end: int = 0, by=None):
    """The last ``n`` sessions ending ``end`` sessions before the current one."""
    return (by or series()).rangeBetween(-(n - 1) - end, -end)


def lagged(x: str | Column, k: int, by=None) -> Column:
    """Value exactly ``k`` sessions ago; null when that session has no bar."""
    by = by or series()
    return F.when(F.col("session_ix") - F.lag("session_ix", k).over(by) == k, F.lag(col(x), k).over(by))


def contiguous(n: int, by=None) -> Column:
    """The last ``n`` sessions all have a bar."""
    return F.col("session_ix") - F.lag("session_ix", n - 1).over(by or series()) == n - 1


def full(agg: Column, n: int, by=None) -> Column:
    return F.when(contiguous(n, by), agg.over(rows(n, by=by)))


def simple_return(k: int, by=None) -> Column:
    return F.col("close") / lagged("close", k, by) - 1


def add_returns(df: DataFrame, lags=(1, 5, 20), by=None) -> DataFrame:
    return df.select("*", *[simple_return(k, by).alias(f"r{k}") for k in lags])


def add_log_return(df: DataFrame, by=None) -> DataFrame:
    return df.withColumn("lr", F.log(F.col("close") / lagged("close", 1, by)))


def needs(x: str, n: int, agg: Column, by=None) -> Column:
    """``agg`` over the last n rows when all n values of ``x`` are present."""
    return F.when(F.count(x).over(rows(n, by=by)) == n, agg.over(rows(n, by=by)))


def trailing_means(df: DataFrame) -> DataFrame:
    """WIN-03: SMA10 / SMA20, close above each, slope of SMA20 against five sessions ago."""
    df = df.select(
        "*", full(F.avg("close"), 10).alias("sma10"), full(F.avg("close"), 20).alias("sma20")
    )
    return df.select(
        "*",
        (F.col("close") > F.col("sma10")).alias("above10"),
        (F.col("close") > F.col("sma20")).alias("above20"),
        (F.col("sma10") / F.col("sma20") - 1).alias("sma_spread"),
        (F.col("sma20") / lagged("sma20", 5) - 1).alias("sma20_slope5"),
    )


def realised_volatility(df: DataFrame, windows=(10, 20)) -> DataFrame:
    """WIN-04: annualised sample deviation of n contiguous log returns."""
    return add_log_return(df).select(
        "*", *[(needs("lr", n, F.stddev_samp("lr")) * F.sqrt(F.lit(ANNUAL))).alias(f"rv{n}") for n in windows]
    )


def true_range(df: DataFrame) -> DataFrame:
    pc = lagged("close", 1)
    return df.withColumn("tr", F.when(pc.isNotNull(), F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))))


def average_true_range(df: DataFrame) -> DataFrame:
    """WIN-08: ATR(14) up to the current bar, and ATR(14) / ATR(5) that leave it out."""
    df = true_range(df)
    return df.select(
        "*",
        needs("tr", 14, F.avg("tr")).alias("atr14"),
        F.when((F.count("tr").over(rows(14, 1)) == 14) & contiguous(2), F.avg("tr").over(rows(14, 1))).alias("atr14_prior"),
        F.when((F.count("tr").over(rows(5, 1)) == 5) & contiguous(2), F.avg("tr").over(rows(5, 1))).alias("atr5_prior"),
    )


def _fold_drawdown(closes: Column, include_first_peak: bool) -> Column:
    start = F.struct(F.element_at(closes, 1).alias("peak"), F.lit(0.0).alias("dd"))

    def step(acc, x):
        top = F.greatest(acc["peak"], x)
        base = top if include_first_peak else acc["peak"]
        return F.struct(top.alias("peak"), F.least(acc["dd"], x / base - 1).alias("dd"))

    return F.aggregate(closes, start, step, lambda a: a["dd"])


def max_drawdown(df: DataFrame, n: int = 6) -> DataFrame:
    """WIN-09: deepest fall below the running peak over n closes (a bounded array frame).

    The second form compares a close with the peak before it, so a gain reads as zero or above.
    """
    path = F.when(contiguous(n), F.collect_list("close").over(rows(n)))
    df = df.withColumn("_path", path)
    return df.select(
        "*",
        _fold_drawdown(F.col("_path"), True).alias("max_dd"),
        _fold_drawdown(F.col("_path"), False).alias("max_dd_prior_peak"),
    ).drop("_path")


def prior_extremes(df: DataFrame, n: int = 5) -> DataFrame:
    """WIN-10: highest and lowest close of the n sessions before the current one."""
    ok = contiguous(n + 1)
    return df.select(
        "*",
        F.when(ok, F.max("close").over(rows(n, 1))).alias("prior_high"),
        F.when(ok, F.min("close").over(rows(n, 1))).alias("prior_low"),
    )


def volume_ratio(df: DataFrame, n: int = 20, minimum: int = 15, keep: int = 5, keep_min: int = 5) -> DataFrame:
    """WIN-11: volume over the median of the prior sessions, its persistence, and the participation score."""
    prior = sorted_middle(F.collect_list("volume").over(sessions(n, 1)))
    present = F.count("volume").over(sessions(n, 1)) >= minimum
    df = df.select("*", simple_return(1).alias("_r1"), F.when(present, prior).alias("prior_median_volume"))
    df = df.select(
        "*",
        F.when(F.col("prior_median_volume") > 0, F.col("volume") / F.col("prior_median_volume")).alias("volume_ratio"),
        F.when(F.col("prior_median_volume").isNotNull(),
               (F.col("volume") > F.col("prior_median_volume")).cast("double")).alias("_above"),
    )
    score = F.when((F.col("_r1") > 0) & (F.col("volume_ratio") > 1), 100.0).when(
        (F.col("_r1") > 0) | (F.col("volume_ratio") > 1), 50.0).otherwise(0.0)
    return df.select(
        "*",
        F.when(F.count("_above").over(sessions(keep)) >= keep_min,
               F.avg("_above").over(sessions(keep))).alias("persistence"),
        F.when(F.col("_r1").isNotNull() & F.col("volume_ratio").isNotNull(), score).alias("participation"),
    ).drop("_above", "_r1")


def open_gaps(df: DataFrame, n: int = 5) -> DataFrame:
    """WIN-12: open against the previous close, and the largest absolute gap of n sessions (all required)."""
    df = df.withColumn("gap", F.col("open") / lagged("close", 1) - 1)
    return df.select("*", needs("gap", n, F.max(F.abs("gap"))).alias("max_gap"))


def downside_tail(df: DataFrame, n: int = 5, minimum: int = 4, threshold: float = -0.04) -> DataFrame:
    """WIN-13: share of the last n sessions' returns at or below the threshold."""
    df = df.withColumn("_r1", simple_return(1))
    hit = F.when(F.col("_r1").isNotNull(), (F.col("_r1") <= threshold).cast("double"))
    return df.withColumn("_hit", hit).select(
        "*",
        F.count("_hit").over(sessions(n)).alias("tail_obs"),
        F.when(F.count("_hit").over(sessions(n)) >= minimum, F.avg("_hit").over(sessions(n))).alias("tail_share"),
    ).drop("_hit", "_r1")


def path_shape(df: DataFrame, n: int = 10) -> DataFrame:
    """WIN-14 / WIN-15: path efficiency, largest return share, positive share, information discreteness."""
    df = add_log_return(df)
    lr = F.col("lr")
    total, size = needs("lr", n, F.sum("lr")), needs("lr", n, F.sum(F.abs("lr")))
    pos = needs("lr", n, F.sum((lr > 0).cast("int")))
    neg = needs("lr", n, F.sum((lr < 0).cast("int")))
    df = df.select(
        "*", total.alias("_net"), size.alias("_size"), pos.alias("_pos"), neg.alias("_neg"),
        needs("lr", n, F.max(F.abs("lr"))).alias("_big"),
    )
    return df.select(
        "*",
        ratio("_net", "_size").alias("path_efficiency"),
        ratio("_big", "_size").alias("largest_share"),
        (F.col("_pos") / float(n)).alias("positive_share"),
        (F.signum("_net") * ratio(F.col("_neg") - F.col("_pos"), F.col("_neg") + F.col("_pos"))).alias("discreteness"),
    ).drop("_net", "_size", "_pos", "_neg", "_big")


def up_run(df: DataFrame, cap: int = 5) -> DataFrame:
    """WIN-16: consecutive rising closes ending here, capped."""
    up = F.coalesce(F.col("close") > lagged("close", 1), F.lit(False))
    df = df.withColumn("_up", up.cast("int"))
    isle = F.sum(1 - F.col("_up")).over(series().rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_isle", isle)
    run = F.sum("_up").over(Window.partitionBy("instrument_id", "_isle").orderBy("session_ix"))
    return df.withColumn("up_run", F.least(run, F.lit(cap)).cast("int")).drop("_up", "_isle")


def state_runs(df: DataFrame, state: str, key: str = "instrument_id", order: str = "session_ix") -> DataFrame:
    """WIN-17: length of the current run of one state and whether it reaches the start of history."""
    by = Window.partitionBy(key).orderBy(order)
    prev = F.lag(state).over(by)
    fresh = F.when(F.row_number().over(by) == 1, 0).otherwise((~prev.eqNullSafe(F.col(state))).cast("int"))
    df = df.withColumn("_isle", F.sum(fresh).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_new", fresh)
    run = F.row_number().over(Window.partitionBy(key, "_isle").orderBy(order))
    return df.select("*", run.alias("run_length"), (F.col("_isle") == 0).alias("reaches_start")).drop("_isle", "_new")


def illiquidity(df: DataFrame, n: int = 20) -> DataFrame:
    """WIN-21: 1e6 * mean(|log return| / dollar volume); null when any dollar volume is zero."""
    df = add_log_return(df).withColumn("_dv", F.col("close") * F.col("volume"))
    df = df.withColumn("_x", F.abs("lr") / F.when(F.col("_dv") > 0, F.col("_dv")))
    return df.withColumn("amihud", needs("_x", n, F.avg("_x")) * 1e6).drop("_dv", "_x")


def versus_benchmark(df: DataFrame, bench: DataFrame) -> DataFrame:
    """Attach the benchmark close / open of the same session (bounded by the calendar)."""
    b = bench.select("session_ix", F.col("open").alias("b_open"), F.col("close").alias("b_close"))
    return df.join(b, "session_ix", "left")


def relative_windows(df: DataFrame, long: int = 126, skip: int = 5) -> DataFrame:
    """WIN-22: benchmark-relative momentum (skipping the last sessions), reversal, intraday and overnight sums."""
    def span(c, a, b):
        return F.log(lagged(c, b) / lagged(c, a)) if b else F.log(F.col(c) / lagged(c, a))

    df = df.select(
        "*",
        (span("close", long, skip) - span("b_close", long, skip)).alias("momentum"),
        (-(span("close", 5, 0) - span("b_close", 5, 0))).alias("reversal"),
        (F.log(F.col("close") / F.col("open")) - F.log(F.col("b_close") / F.col("b_open"))).alias("_intra"),
        (F.log(F.col("open") / lagged("close", 1)) - F.log(F.col("b_open") / lagged("b_close", 1))).alias("_over"),
    )
    return df.select(
        "*",
        F.when(contiguous(5), needs("_intra", 5, F.sum("_intra"))).alias("intraday_5"),
        needs("_over", 5, F.sum("_over")).alias("overnight_5"),
    ).drop("_intra", "_over")


def down_market(df: DataFrame, n: int = 60, minimum: int = 12) -> DataFrame:
    """WIN-23 / WIN-24: relative return in falling markets, relative downside deviation, single-index residual volatility."""
    df = df.select(
        "*", F.log(F.col("close") / lagged("close", 1)).alias("_s"), F.log(F.col("b_close") / lagged("b_close", 1)).alias("_b")
    )
    df = df.withColumn("_d", F.col("_s") - F.col("_b"))
    w = rows(n)
    whole = F.count("_d").over(w) == n
    down = F.when(F.col("_b") < 0, F.col("_d"))
    sxx = F.var_samp("_b").over(w) * (n - 1)
    syy = F.var_samp("_s").over(w) * (n - 1)
    sxy = F.covar_samp("_s", "_b").over(w) * (n - 1)
    df = df.select(
        "*",
        F.when(whole & (F.count(down).over(w) >= minimum), F.avg(down).over(w)).alias("down_market_return"),
        F.when(whole, F.sqrt(ANNUAL * F.avg(F.pow(F.least(F.col("_d"), F.lit(0.0)), 2)).over(w))).alias("downside_deviation"),
        F.when(whole, sxx).alias("_sxx"), F.when(whole, syy).alias("_syy"), F.when(whole, sxy).alias("_sxy"),
    )
    sse = F.greatest(F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"), F.lit(0.0))
    return df.withColumn(
        "residual_volatility", F.when(F.col("_sxx") > 0, F.sqrt(ANNUAL * sse / (n - 2)))
    ).drop("_s", "_b", "_d", "_sxx", "_syy", "_sxy")


def relative_strength(df: DataFrame, windows=(5, 10, 20)) -> DataFrame:
    """Relative return against the benchmark per window, and the five-session acceleration (WIN-25)."""
    def rel(k):
        return (F.col("close") / lagged("close", k) - 1) - (F.col("b_close") / lagged("b_close", k) - 1)

    df = df.select("*", *[rel(k).alias(f"rel{k}") for k in windows])
    return df.withColumn("acceleration", F.col("rel5") - lagged("rel5", 5))


def discontinuities(df: DataFrame, high: float = 2.0, low: float = 0.5) -> DataFrame:
    """WIN-30: open over the previous session's close; severe when it leaves [low, high]."""
    df = df.withColumn("open_ratio", F.col("open") / lagged("close", 1))
    return df.withColumn("severe", (F.col("open_ratio") >= high) | (F.col("open_ratio") <= low))


def pair_panel(legs: DataFrame, key: str = "instrument_id") -> DataFrame:
    """JOI-17: every unordered pair of a small registry of series, joined on the session."""
    left = legs.select("session_ix", F.col(key).alias("left_id"), F.col("close").alias("left_close"))
    right = legs.select("session_ix", F.col(key).alias("right_id"), F.col("close").alias("right_close"))
    return left.join(right, "session_ix").where(F.col("left_id") < F.col("right_id")).withColumn(
        "instrument_id", F.concat_ws("/", "left_id", "right_id"))


def pair_windows(pairs: DataFrame, windows=(5, 10, 20), perturb=(18, 20, 22)) -> DataFrame:
    """WIN-18 / WIN-20: returns, spread, correlation and direction per window; correlation at nearby lengths."""
    df = pairs.select(
        "*",
        F.log(F.col("left_close") / lagged("left_close", 1)).alias("_l"),
        F.log(F.col("right_close") / lagged("right_close", 1)).alias("_r"),
    )
    out = []
    for k in windows:
        whole = F.count("_l").over(rows(k)) == k
        lret = F.when(whole, F.col("left_close") / lagged("left_close", k) - 1)
        rret = F.when(whole, F.col("right_close") / lagged("right_close", k) - 1)
        out += [lret.alias(f"left_ret{k}"), rret.alias(f"right_ret{k}"), (lret - rret).alias(f"spread{k}")]
    for k in sorted(set(windows) | set(perturb)):
        whole = F.count("_l").over(rows(k)) == k
        out.append(F.when(whole, F.corr("_l", "_r").over(rows(k))).alias(f"corr{k}"))
    df = df.select("*", *out).drop("_l", "_r")
    dirs = []
    for k in windows:
        a, b = F.col(f"left_ret{k}"), F.col(f"right_ret{k}")
        dirs.append(
            F.when(a.isNull() | b.isNull(), F.lit(None).cast("string"))
            .when((a > 0) & (b > 0), "both_positive").when((a < 0) & (b < 0), "both_negative")
            .when((a > 0) & (b < 0), "left_positive_right_negative")
            .when((a < 0) & (b > 0), "left_negative_right_positive")
            .when(a == b, "equal_returns").otherwise("flat_or_mixed").alias(f"direction{k}")
        )
    bands = [F.col(f"corr{k}") >= 0.35 for k in perturb]
    same = (bands[0] == bands[1]) & (bands[1] == bands[2])
    now, before = F.signum("spread20"), F.signum(lagged("spread20", 20))
    return df.select(
        "*", *dirs,
        F.coalesce(same, F.lit(False)).alias("perturbation_consistent"),
        F.coalesce((now == before) & (now != 0), F.lit(False)).alias("nonoverlap_consistent"),
    )


def ratio_statistics(pairs: DataFrame, n: int = 20, long: int = 60) -> DataFrame:
    """WIN-19: median/MAD z of the log ratio over n sessions and its mid percentile over ``long`` sessions."""
    df = pairs.withColumn("ratio", F.log(F.col("left_close") / F.col("right_close")))
    short = F.when(contiguous(n), F.collect_list("ratio").over(rows(n)))
    wide = F.when(contiguous(long), F.collect_list("ratio").over(rows(long)))
    df = df.select("*", short.alias("_s"), wide.alias("_w"))
    df = df.withColumn("_med", sorted_middle(F.col("_s")))
    df = df.withColumn("_mad", sorted_middle(F.transform("_s", lambda x: F.abs(x - F.col("_med")))))
    below = F.size(F.filter("_w", lambda x: x < F.col("ratio")))
    equal = F.size(F.filter("_w", lambda x: x == F.col("ratio")))
    return df.select(
        "*",
        F.when(F.col("_mad") > 0, (F.col("ratio") - F.col("_med")) / F.col("_mad")).alias("ratio_z"),
        F.when(F.col("_w").isNotNull(), (below + equal / 2.0) / float(long)).alias("ratio_percentile"),
    ).drop("_s", "_w", "_med", "_mad")
