"""Ordered reports and capped selections.

``row_number() <= k`` filters plan as a group limit before the shuffle, so a large group sends at
most k rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def movers(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """TOP-01: gainers and losers with tie-breaks (return, dollar volume, ticker, id); n within 1..50."""
    if not 1 <= n <= 50:
        raise ValueError("per side must be within 1..50")
    ties = [F.desc("dv"), F.col("ticker"), F.col("instrument_id")]
    up = top_n(df.where("r1 > 0"), by, [F.desc("r1"), *ties], n).withColumn("side", F.lit("gainer"))
    down = top_n(df.where("r1 < 0"), by, [F.asc("r1"), *ties], n).withColumn("side", F.lit("loser"))
    return up.unionByName(down)


def capped_selection(df: DataFrame, by: Sequence[str], group: str, order: Sequence[Column], cap: int, share: float) -> DataFrame:
    """TOP-04: best ``cap`` rows, no group above floor(cap * share).

    Group caps do not depend on other groups, so the walk equals two limits: best rows inside each
    group, then best rows among those.
    """
    limit = max(1, int(cap * share))
    kept = top_n(df, [*by, group], order, limit, "group_rank")
    return top_n(kept, by, order, cap, "rank")


def with_rejections(df: DataFrame, selected: DataFrame, by: Sequence[str], key: Sequence[Column], ids: Sequence[str], cap: int) -> DataFrame:
    """Reason of every row the walk skipped: the list was full before it, or its group was.

    Only the last selected key of each list is joined back, so no list is sorted as a whole.
    """
    last = selected.groupBy(*by).agg(F.count(F.lit(1)).alias("_taken"), F.max(F.struct(*key)).alias("_last"))
    picked = selected.select(*by, *ids, "rank")
    full = df.join(last, list(by), "left").join(picked, [*by, *ids], "left")
    beyond = (F.col("_taken") == cap) & (F.struct(*key) > F.col("_last"))
    return full.withColumn("outcome", F.when(F.col("rank").isNotNull(), "selected").when(beyond, "display_cap_reached").otherwise("concentration_cap_reached")).drop("_taken", "_last")
