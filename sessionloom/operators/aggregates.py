"""Grouped statistics; everything reduces map-side before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.numeric import col, ratio
from sessionloom.functions.staging import cut


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a grand-total aggregate as scalar subqueries: one value each, no join."""
    return df.select("*", *[one_row.select(c).scalar().alias(c) for c in one_row.columns])


def chronological_halves(df: DataFrame, order: str = "session_ix") -> DataFrame:
    """WIN-32: sessions split at floor(n / 2); the window runs over the calendar only."""
    days = df.select(order).distinct()
    by = Window.orderBy(order)
    ranked = days.select(order, F.row_number().over(by).alias("_rn"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))
    return ranked.select(order, F.when(F.col("_rn") <= F.floor(F.col("_n") / 2), "first").otherwise("second").alias("half"))


def sign_episodes(df: DataFrame, x: str, key: str = "instrument_id") -> DataFrame:
    """WIN-35: same-side runs per key and chronological half: how many, the longest, the dominant side's share."""
    side = df.where(F.col(x).isNotNull()).withColumn("_side", F.signum(x).cast("int"))
    side = side.join(chronological_halves(side), "session_ix")
    by = Window.partitionBy(key, "half").orderBy("session_ix")
    fresh = (~F.lag("_side").over(by).eqNullSafe(F.col("_side"))).cast("int")
    runs = side.withColumn("_fresh", fresh)
    runs = runs.withColumn("_isle", F.sum("_fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(key, "half", "_isle", "_side").agg(F.count(F.lit(1)).alias("_n"))
    up = F.sum(F.when(F.col("_side") > 0, F.col("_n")).otherwise(0))
    down = F.sum(F.when(F.col("_side") < 0, F.col("_n")).otherwise(0))
    return runs.groupBy(key, "half").agg(
        count_if(F.col("_side") != 0).alias("episodes"),
        F.max("_n").alias("longest"),
        (F.greatest(up, down) / F.sum("_n")).alias("dominant_share"),
    )


def correlation(a: str | Column, b: str | Column) -> Column:
    """Correlation over rows that have both; null where either doesn't vary.

    ``corr`` divides before a condition around it is looked at, so its parts are divided here.
    """
    a, b = col(a), col(b)
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def pearson(a: str, b: str, minimum: int) -> list[Column]:
    """AGG-16: paired correlation with an observation floor; null when either side is constant."""
    n = F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull())
    return [n.alias("n_pairs"), F.when(n >= minimum, correlation(a, b)).alias("corr")]


def holm(df: DataFrame, p: str, order: str, group: list[str] | None = None) -> DataFrame:
    """AGG-38: Holm step-down adjusted p-values over a short list of trials."""
    by = Window.partitionBy(*(group or [])).orderBy(p, order)
    m = F.count(F.lit(1)).over(Window.partitionBy(*(group or [])))
    df = df.withColumn("_step", F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(by) + 1)))
    return df.withColumn("p_holm", F.max("_step").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def multiset_fingerprint(row_text: Column) -> list[Column]:
    """SCA-20 / SET-06: order-independent digest of rows: count and sum of 60-bit SHA-256 prefixes.

    A sum merges map-side, so no task ever holds the sorted list of hashes.
    """
    h = F.conv(F.substring(F.sha2(row_text, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return [F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("string").alias("fingerprint")]


def top_share(df: DataFrame, group: list[str], value: str, order: list[Column]) -> DataFrame:
    """AGG-31: largest absolute contribution over the sum of absolute contributions."""
    return df.groupBy(*group).agg(ratio(F.max(F.abs(value)), F.sum(F.abs(value))).alias("top_share"))


def market_summary(df: DataFrame, by: list[str], buckets: int = 16) -> DataFrame:
    """AGG-02: advancers / decliners / unchanged, ratios, up / down volume, mean, median, shares of returns ``r1``."""
    from sessionloom.functions.ranking import quantiles

    r = F.col("r1")
    df = cut(df.where(r.isNotNull()).select(*by, "r1", "volume"))
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(r > 0).alias("advancers"), F.count_if(r < 0).alias("decliners"),
        F.count_if(r == 0).alias("unchanged"), F.sum(F.when(r > 0, F.col("volume")).otherwise(0.0)).alias("up_volume"),
        F.sum(F.when(r < 0, F.col("volume")).otherwise(0.0)).alias("down_volume"), F.avg(r).alias("mean_return"))
    med = quantiles(df, by, "r1", {"median_return": 0.5}, buckets).drop("n_group")
    return base.join(med, by).select(
        *by, "n", "advancers", "decliners", "unchanged",
        ratio("advancers", "decliners").alias("ad_ratio"), ratio("up_volume", "down_volume").alias("volume_ratio"),
        "mean_return", "median_return", (F.col("advancers") / F.col("n")).alias("advancer_share"))


def dedupe(df: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """AGG-03: exact duplicates collapse to one row, conflicting ones are counted and carry no row."""
    sig = F.struct(*fields)
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"), F.min(sig).alias("_lo"), F.max(sig).alias("_hi"))
    same = F.col("_lo").eqNullSafe(F.col("_hi"))
    return g.select(
        *key, "n_rows",
        F.when(~same, "conflicting").when(F.col("n_rows") > 1, "exact_duplicate").otherwise("unique").alias("status"),
        *[F.when(same, F.col(f"_lo.{f}")).alias(f) for f in fields])


def claims(df: DataFrame, owner: str, claimed: str, out: str) -> DataFrame:
    """AGG-05 / AGG-06: how many distinct ``owner`` values claim one ``claimed`` value.

    Two grouped counts instead of a window, so a value shared by millions of rows stays a small row.
    """
    return df.select(owner, claimed).distinct().groupBy(claimed).agg(F.count(F.lit(1)).alias(out))


def coverage_gate(value: Column, actual: Column, total: Column, floor: float, minimum: int) -> tuple[Column, Column]:
    """AGG-07: the value, or null with the reason it is missing."""
    cov = actual / total
    reason = (
        F.when(cov < floor, "insufficient_coverage").when(actual < minimum, "insufficient_observations")
        .when(value.isNull(), "zero_denominator"))
    return F.when(reason.isNull(), value), reason


def split_product(df: DataFrame, key: list[str]) -> DataFrame:
    """AGG-12: multiply numerators and denominators apart, divide once."""
    return df.groupBy(*key).agg((F.product("split_from") / F.product("split_to")).alias("factor"), F.count(F.lit(1)).alias("n_actions"))


def top_decile_share(df: DataFrame, by: list[str], value: str, minimum: int, buckets: int = 16) -> DataFrame:
    """AGG-15: share of the positive sum held by the ceil(n / 10) largest, ties broken by value.

    Works on (value, count, position) so the winners of a session are never sorted in one task.
    """
    from sessionloom.functions.ranking import rank_table

    ranks = rank_table(df.where(F.col(value) > 0), by, value, buckets)
    n, top = F.col("n_group"), F.ceil(F.col("n_group") / 10)
    above = n - F.col("n_lower") - F.col("n_tied")
    taken = F.greatest(F.lit(0), F.least(F.col("n_tied"), top - above))
    g = ranks.groupBy(*by).agg(
        F.max(n).alias("n_positive"), F.sum(F.col(value) * taken).alias("_top"), F.sum(F.col(value) * F.col("n_tied")).alias("_all"))
    return g.select(*by, "n_positive", F.when(F.col("n_positive") >= minimum, ratio("_top", "_all")).alias("concentration"))


def distribution_report(df: DataFrame, by: list[str], value: str, buckets: int = 16) -> DataFrame:
    """AGG-22: quantiles, extremes, distinct count, tie excess and the share outside three IQRs."""
    from sessionloom.functions.ranking import value_counts

    return distribution_of_counts(value_counts(df, by, value), by, buckets)


def distribution_of_counts(counts: DataFrame, by: list[str], buckets: int = 16) -> DataFrame:
    """The same from distinct values ``_v`` with their counts ``_n``."""
    from sessionloom.functions.ranking import _pick

    q = _pick(counts, by, {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}, buckets)
    iqr = F.col("p75") - F.col("p25")
    out = (F.col("_v") < F.col("p25") - 3 * iqr) | (F.col("_v") > F.col("p75") + 3 * iqr)
    qs = ["p01", "p05", "p25", "p50", "p75", "p95", "p99"]
    return counts.join(q, by).groupBy(*by).agg(
        *[F.max(c).alias(c) for c in qs], F.min("_v").alias("lowest"), F.max("_v").alias("highest"),
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_distinct"), (F.sum("_n") - F.count(F.lit(1))).alias("tie_excess"),
        (F.sum(F.when(out, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("outlier_rate"))


def concentration(df: DataFrame, by: list[str], part: str, top: int = 10) -> DataFrame:
    """AGG-23: largest share, top-k share and Herfindahl of the counts of ``part``.

    The k largest parts are kept by a mergeable top-k, so the parts of one group are never sorted together.
    """
    return concentration_of_counts(df.groupBy(*by, part).agg(F.count(F.lit(1)).alias("_n")), by, part, top)


def concentration_of_counts(parts: DataFrame, by: list[str], part: str, top: int = 10) -> DataFrame:
    """The same from parts with their counts ``_n``."""
    total = parts.groupBy(*by).agg(F.sum("_n").alias("_t"), F.sum(F.col("_n").cast("double") * F.col("_n")).alias("_sq"), F.max("_n").alias("_m"), F.count(F.lit(1)).alias("n_parts"))
    best = parts.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_n"), part))).where(F.col("_rn") <= top)
    best = best.groupBy(*by).agg(F.sum("_n").alias("_k"))
    return total.join(best, by).select(
        *by, "n_parts", (F.col("_m") / F.col("_t")).alias("max_share"), (F.col("_k") / F.col("_t")).alias("top_share"),
        (F.col("_sq") / F.col("_t") / F.col("_t")).alias("herfindahl"))


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "factor_id", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def rank_ic(df: DataFrame, by: list[str], factor: str, target: str, minimum: int = 2) -> DataFrame:
    """AGG-17: Spearman with mid-ranks per group, from two distributed rankings."""
    from sessionloom.functions.ranking import with_midranks

    ranked = with_midranks(df.select(*by, factor, target), by, {"_rf": factor, "_rt": target})
    return ranked.groupBy(*by).agg(*[c.alias(a) for c, a in zip(pearson("_rf", "_rt", minimum), ("n_obs", "ic"))])


def partial_rank_ic(df: DataFrame, by: list[str], factor: str, target: str, control: str) -> DataFrame:
    """AGG-18: partial Spearman in closed form from three rank correlations."""
    from sessionloom.functions.ranking import with_midranks

    d = with_midranks(df.select(*by, factor, target, control), by, {"_x": factor, "_y": target, "_z": control})
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_obs"), correlation("_x", "_y").alias("xy"), correlation("_x", "_z").alias("xz"), correlation("_y", "_z").alias("yz"))
    den = (1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz"))
    return g.select(*by, "n_obs", F.col("xy").alias("ic"), F.when(den > 1e-12, (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt(den)).alias("partial_ic"))
