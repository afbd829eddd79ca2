"""Exact ranks and quantiles of a cross-section that never needs a whole group in one task.

A cross-section (one session, one metric) may hold most of the rows, so neither a
window over the group nor an exact ``percentile`` buffer is safe.  Instead:

1. equal values collapse to ``(group, value, n)`` with a map-side combine;
2. a mergeable sketch gives bucket edges per group (edges only balance the work,
   they do not touch the result);
3. bucket sizes give each bucket its offset, a bounded table of ``buckets`` rows a group;
4. ranks inside one bucket plus the offset are the exact ranks of the group.

Where the largest group has been counted and is small (``WHOLE`` rows), one task sorts a group: the buckets would cost more
passes than they save.

Quantiles read only the buckets that hold the wanted order statistics.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.staging import cut, stored

BUCKETS, MOST_BUCKETS = 16, 512
#: Rows of a group that one task sorts; if any group has more, buckets are made.
WHOLE = 1_000_000


def small_groups(df: DataFrame, group: Sequence[str]) -> bool:
    """Whether no group is too large for one task; only the sizes are computed."""
    most = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows")).first()[0] or 0
    return most <= WHOLE


def grouped(df: DataFrame, group: Sequence[str], values: Sequence[str] = ()) -> DataFrame:
    """Rows with a group and all values."""
    return df.dropna(subset=[*group]).where(reduce(and_, [F.col(v).isNotNull() for v in values], F.lit(True)))


def window_midrank(group: Sequence[str], value: str) -> Column:
    """Mid-rank inside a small group: all columns that are ranked in a group share its partition."""
    by = Window.partitionBy(*group).orderBy(value)
    return (F.rank().over(by) + F.count(F.lit(1)).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2.0


def with_midranks(df: DataFrame, group: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Rows that have all of the values, with the mid-rank of each among them (column: value)."""
    df = grouped(df, group, [*columns.values()])
    if small_groups(df, group):
        return df.select("*", *[window_midrank(group, v).alias(c) for c, v in columns.items()])
    ranked = df
    for c, v in columns.items():
        ranked = ranked.join(rank_table(df, group, v).select(*group, v, F.col("midrank").alias(c)), [*group, v])
    return ranked


def value_counts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their counts, stored once: every later pass reads this table."""
    return stored(
        df.where(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n")),
        "counts",
    )


def _binned(counts: DataFrame, group: Sequence[str], buckets: int) -> DataFrame:
    if small_groups(counts, group):
        total = F.sum("_n").over(Window.partitionBy(*group))
        zero = F.lit(0).cast("bigint")
        return grouped(counts, group).withColumn("_total", total).select("*", F.lit(0).alias("_b"), F.col("_total").alias("_bn"), zero.alias("_off"))
    # as many buckets as the cluster has tasks, so a group that holds most rows still meets all of them
    buckets = max(buckets, 2, min(MOST_BUCKETS, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    steps = [i / buckets for i in range(1, buckets)]
    stats = counts.groupBy(*group).agg(
        F.percentile_approx("_v", steps, 1000).alias("_edges"), F.sum("_n").alias("_total")
    )
    binned = counts.join(stats, list(group)).withColumn(
        "_b", F.size(F.filter("_edges", lambda e: e < F.col("_v")))
    )
    sizes = binned.groupBy(*group, "_b").agg(F.sum("_n").alias("_bn"))
    below = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_bn").over(below), F.lit(0)))
    return binned.drop("_edges").join(sizes, [*group, "_b"])


def _positions(binned: DataFrame, group: Sequence[str]) -> DataFrame:
    inside = (
        Window.partitionBy(*group, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    )
    return binned.withColumn("_lt", F.col("_off") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))


def rank_table(df: DataFrame, group: Sequence[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """One row per (group, value): how many are lower, how many tie, the mid-rank, the group size."""
    pos = _positions(_binned(value_counts(df, group, value), group, buckets), group)
    return pos.select(
        *group,
        F.col("_v").alias(value),
        F.col("_lt").alias("n_lower"),
        F.col("_n").alias("n_tied"),
        F.col("_total").alias("n_group"),
        (F.col("_lt") + (F.col("_n") + 1) / 2.0).alias("midrank"),
    )


def with_midrank(df: DataFrame, group: Sequence[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """Attach the mid-rank (WIN-05); rows with a null value drop out of the ranking and the result."""
    known = grouped(df, group, [value])
    if not small_groups(known, group):
        return df.join(rank_table(df, group, value, buckets), [*group, value])
    by = Window.partitionBy(*group).orderBy(value)
    up_to = F.count(F.lit(1)).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    keys = [*group, value]
    ranked = known.select(
        *keys, *[c for c in df.columns if c not in keys], (F.rank().over(by) - 1).cast("bigint").alias("n_lower"), up_to.alias("_up_to"), F.count(F.lit(1)).over(Window.partitionBy(*group)).alias("n_group"))
    tied = F.col("_up_to") - F.col("n_lower")
    return ranked.select(
        *keys, *[c for c in df.columns if c not in keys], "n_lower", tied.alias("n_tied"), "n_group", (F.col("n_lower") + (tied + 1) / 2.0).alias("midrank"))


def window_scores(df: DataFrame, group: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    """The columns of ``winsorised_scores`` beside each row of groups small enough for one task, null where the value is; all values share one partition."""
    by, v, i, n = Window.partitionBy(*group), F.col(value), F.col("_i"), F.col("n_group")

    def at(x: Column, p: float) -> Column:
        h = (n - 1) * p
        a, b = (F.max(F.when(i == k(h), x)).over(by) for k in (F.floor, F.ceil))
        return a + (b - a) * (h - F.floor(h))

    position = lambda x: (F.row_number().over(by.orderBy(F.asc_nulls_last(x))) - 1).alias("_i")
    kept = df.columns
    df = df.select(*kept, position(value), F.count(value).over(by).alias("n_group"))
    df = df.select(*kept, "n_group", at(v, low).alias("_lo"), at(v, 0.5).alias("med"), at(v, high).alias("_hi"))
    df = df.select(*kept, "n_group", "med", F.when(v.isNotNull(), F.least("_hi", F.greatest("_lo", value))).alias("w"))
    df = df.select(*kept, "n_group", "med", "w", F.abs(F.col("w") - F.col("med")).alias("_d"))
    df = df.select(*kept, "n_group", "med", "w", "_d", position("_d"))
    return window_ties(df.select(*kept, "n_group", "med", "w", at(F.col("_d"), 0.5).alias("mad")), group, "w")


def window_ties(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """n_tied and midrank of each row's value among those of its small group that are not null."""
    before = F.rank().over(Window.partitionBy(*group).orderBy(F.asc_nulls_last(value))) - 1
    df = df.select("*", before.alias("_lt"), F.count(F.lit(1)).over(Window.partitionBy(*group, value)).alias("n_tied"))
    return df.withColumn("midrank", F.when(F.col(value).isNotNull(), F.col("_lt") + (F.col("n_tied") + 1) / 2.0)).drop("_lt")


def _pick(counts: DataFrame, group: Sequence[str], probs: Mapping[str, float], buckets: int) -> DataFrame:
    binned = _binned(counts, group, buckets)
    lo = {k: F.floor((F.col("_total") - 1) * p) for k, p in probs.items()}
    hi = {k: F.ceil((F.col("_total") - 1) * p) for k, p in probs.items()}
    wanted = F.lit(False)
    for x in [*lo.values(), *hi.values()]:
        wanted = wanted | ((x >= F.col("_off")) & (x < F.col("_off") + F.col("_bn")))
    pos = _positions(binned.where(wanted), group)

    def at(x):
        return F.max(F.when((x >= F.col("_lt")) & (x < F.col("_lt") + F.col("_n")), F.col("_v")))

    aggs = [F.max("_total").alias("n_group")]
    for k in probs:
        aggs += [at(lo[k]).alias(f"_lo_{k}"), at(hi[k]).alias(f"_hi_{k}")]
    picked = pos.groupBy(*group).agg(*aggs)
    cols = []
    for k, p in probs.items():
        h = (F.col("n_group") - 1) * p
        a, b = F.col(f"_lo_{k}"), F.col(f"_hi_{k}")
        cols.append((a + (b - a) * (h - F.floor(h))).alias(k))
    return picked.select(*group, "n_group", *cols)


def quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float], buckets: int = BUCKETS
) -> DataFrame:
    """Inclusive linear (type 7) quantiles per group (AGG-10)."""
    return _pick(value_counts(df, group, value), group, probs, buckets)


def bracketed_quantile(df: DataFrame, group: Sequence[str], values: Mapping[str, str], p: float, slack: float = 0.01, accuracy: int = 200) -> DataFrame:
    """Type 7 quantile (name: value) of several columns per group, null without values, from two passes over rows that should be stored.

    A sketch gives each group a bracket around the wanted positions; then rows below it are counted and only values inside are shuffled. The counts
    say whether the positions are inside, so the result is exact; should one bracket miss, all groups go through ``quantiles``.
    """
    edges = [F.percentile_approx(v, [max(0.0, p - slack), min(1.0, p + slack)], accuracy).alias(f"_e_{k}") for k, v in values.items()]
    legs = F.array(*[F.struct(F.lit(k).alias("_name"), F.col(v).alias("_v"), F.get(f"_e_{k}", F.lit(0)).alias("_a"), F.get(f"_e_{k}", F.lit(1)).alias("_z")) for k, v in values.items()])
    tall = df.select(*group, *values.values()).join(stored(df.groupBy(*group).agg(*edges), "edges"), [*group]).select(*group, F.inline(legs)).where("_v is not null")
    side = F.when(F.col("_v") < F.col("_a"), -1).when(F.col("_v") > F.col("_z"), 1).otherwise(0)
    by = [*group, "_name"]
    counts = tall.groupBy(*by, side.alias("_side"), F.when(side == 0, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = stored(counts, "counts")
    n = lambda *sides: F.coalesce(F.sum(F.when(F.col("_side").isin(*sides), F.col("_n"))), F.lit(0))
    h = (F.col("_total") - 1) * p
    sums = counts.groupBy(*by).agg(F.sum("_n").alias("_total"), n(-1).alias("_below"), n(-1, 0).alias("_upto")).select("*", F.floor(h).alias("_lo"), F.ceil(h).alias("_hi"))
    sums = stored(sums, "sums")
    if not sums.where("_lo < _below or _hi >= _upto").isEmpty():
        parts = [quantiles(df, group, v, {k: p}).drop("n_group") for k, v in values.items()]
        return reduce(lambda a, b: a.join(b, [*group], "left"), parts, df.select(*group).distinct())
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.where("_side = 0").join(sums, by).withColumn("_lt", F.col("_below") + before)
    at = lambda x: F.max(F.when((F.col(x) >= F.col("_lt")) & (F.col(x) < F.col("_lt") + F.col("_n")), F.col("_v")))
    a, b = at("_lo"), at("_hi")
    found = placed.groupBy(*by).agg((a + (b - a) * (F.max(h) - F.max("_lo"))).alias("_q"))
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("_name") == k, F.col("_q"))).alias(k) for k in values])


def nearest_rank(
    df: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float], buckets: int = BUCKETS
) -> DataFrame:
    """Nearest-rank quantiles ``x[ceil(p * n)]`` (AGG-11)."""
    binned = _binned(value_counts(df, group, value), group, buckets)
    want = {k: F.greatest(F.ceil(F.col("_total") * p), F.lit(1)) - 1 for k, p in probs.items()}
    pos = _positions(binned, group)
    aggs = [
        F.max(F.when((x >= F.col("_lt")) & (x < F.col("_lt") + F.col("_n")), F.col("_v"))).alias(k)
        for k, x in want.items()
    ]
    return pos.groupBy(*group).agg(F.max("_total").alias("n_group"), *aggs)


def deviations(counts: DataFrame, centre: DataFrame, group: Sequence[str]) -> DataFrame:
    """Counts of absolute deviations from ``med``."""
    return (
        counts.join(centre.select(*group, "med"), list(group))
        .groupBy(*group, F.abs(F.col("_v") - F.col("med")).alias("_v"))
        .agg(F.sum("_n").alias("_n"))
    )


def median_mad(df: DataFrame, group: Sequence[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """Median and median absolute deviation (unscaled) per group (AGG-09)."""
    counts = value_counts(df, group, value)
    med = cut(_pick(counts, group, {"med": 0.5}, buckets))
    mad = _pick(deviations(counts, med, group), group, {"mad": 0.5}, buckets).drop("n_group")
    return med.join(mad, list(group))


def winsorised_scores(
    df: DataFrame, group: Sequence[str], value: str, low: float, high: float, buckets: int = BUCKETS
) -> DataFrame:
    """One row per (group, value): the winsorised value, its mid-rank after winsorising, median and MAD.

    The median is inside the winsor edges, so one pass yields both edges and the centre.
    """
    group = list(group)
    counts = value_counts(df, group, value)
    edges = cut(_pick(counts, group, {"q_lo": low, "med": 0.5, "q_hi": high}, buckets))
    clipped = counts.join(edges, group).withColumn("w", F.least("q_hi", F.greatest("q_lo", "_v")))
    by_w = cut(clipped.groupBy(*group, F.col("w").alias("_v")).agg(F.sum("_n").alias("_n")))
    mad = _pick(deviations(by_w, edges, group), group, {"mad": 0.5}, buckets).drop("n_group")
    ranks = _positions(_binned(by_w, group, buckets), group).select(
        *group,
        F.col("_v").alias("w"),
        F.col("_n").alias("n_tied"),
        (F.col("_lt") + (F.col("_n") + 1) / 2.0).alias("midrank"),
    )
    return (
        clipped.select(*group, F.col("_v").alias(value), "w", "med", "n_group")
        .join(ranks, [*group, "w"])
        .join(mad, group)
    )
