"""Cross-section operators per session, built on exact distributed ranks."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.numeric import NORMAL_Q75, clip100
from sessionloom.operators.aggregates import attach_one_row
from sessionloom.functions.ranking import window_scores, window_ties, winsorised_scores, with_midrank

SESSION = ["session_ix"]


def percentile_0_100(df: DataFrame, value: str, group=SESSION, out: str = "pct") -> DataFrame:
    """WIN-06: inclusive mid-rank percentile; a constant cross-section scores 50."""
    ranked = with_midrank(df, group, value)
    constant = (F.col("n_tied") == F.col("n_group"))
    score = F.when(constant, 50.0).otherwise(100.0 * (F.col("midrank") - 1) / (F.col("n_group") - 1))
    return ranked.withColumn(out, score)


def robust_score(df: DataFrame, value: str, group=SESSION, out: str = "score",
                 scale: float = 15.0, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """WIN-07: winsorise at the 5th / 95th percentile, centre on the median, scale by the MAD, clip to 0..100.

    When the MAD is zero the score is the mid-rank percentile of the winsorised values.
    The score is a function of (session, value), so it is computed on distinct values and joined back once.
    """
    table = winsorised_scores(df, group, value, low, high)
    table = table.select(*group, value, F.col("w").alias("winsorised"), _robust(scale).alias(out))
    return df.join(table, [*group, value])


def _percentile() -> Column:
    return F.when(F.col("n_tied") == F.col("n_group"), 50.0).otherwise(100.0 * (F.col("midrank") - 1) / (F.col("n_group") - 1))


def _robust(scale: float) -> Column:
    return F.when(F.col("mad") == 0, _percentile()).otherwise(clip100(50.0 + scale * NORMAL_Q75 * (F.col("w") - F.col("med")) / F.col("mad")))


def small_cross_sections(df: DataFrame, robust: Mapping[str, str], percentiles: Mapping[str, str], group=SESSION,
                         scale: float = 15.0, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """WIN-07 and WIN-06 of several columns (score: value) beside each row, for sessions that one task can sort.

    One exchange by session serves all scores, and no score is joined back. A score is null where its value or a group column is.
    """
    whole = reduce(and_, [F.col(g).isNotNull() for g in group])
    for out, value in robust.items():
        kept = df.columns
        df = window_scores(df, group, value, low, high)
        df = df.select(*kept, F.when(whole & F.col(value).isNotNull(), _robust(scale)).alias(out))
    for out, value in percentiles.items():
        kept = df.columns
        df = window_ties(df.withColumn("n_group", F.count(value).over(Window.partitionBy(*group))), group, value)
        df = df.select(*kept, F.when(whole & F.col(value).isNotNull(), _percentile()).alias(out))
    return df


def rank_buckets(df: DataFrame, value: str, group=SESSION, n_buckets: int = 5, out: str = "bucket") -> DataFrame:
    """AGG-27: equal-count buckets from mid-ranks, so ties share a bucket."""
    ranked = with_midrank(df, list(group), value)
    b = F.floor((F.col("midrank") - 1) * n_buckets / F.col("n_group"))
    return ranked.withColumn(out, F.least(F.lit(n_buckets - 1), b).cast("int"))


def rank_scale(df: DataFrame, value: str, group=SESSION) -> DataFrame:
    """WIN-33: mid-rank to [-1, 1] within the session, then pooled z-scaling."""
    ranked = with_midrank(df, list(group), value).where(F.col("n_group") > 1).withColumn(
        "unit", 2.0 * (F.col("midrank") - 1) / (F.col("n_group") - 1) - 1.0)
    pooled = ranked.agg(F.avg("unit").alias("_m"), F.stddev_samp("unit").alias("_s"))
    return attach_one_row(ranked, pooled).withColumn("z", (F.col("unit") - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def peer_rank(df: DataFrame, value: str) -> DataFrame:
    """WIN-26: dense rank among registered peers of a session (a small, fixed registry)."""
    by = Window.partitionBy("session_ix")
    return df.select(
        "*",
        F.when(F.col(value).isNotNull(), F.dense_rank().over(by.orderBy(F.desc_nulls_last(value)))).alias("peer_rank"),
        F.count(value).over(by).alias("peer_count"),
    )
