"""Universe membership plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.operators.filters import stage_of


def funnel(decisions: DataFrame, stages: list[str], by: list[str]) -> DataFrame:
    """AGG-35: input / excluded / remaining per sequential stage; closes to the final membership."""
    stage = decisions.groupBy(*by, stage_of(F.col("disposition")).alias("stage")).agg(F.count(F.lit(1)).alias("_n"))
    grid = decisions.select(*by).distinct().select(*by, F.posexplode(F.array(*[F.lit(s) for s in stages])).alias("stage_order", "stage"))
    n = F.coalesce("_n", F.lit(0))
    rest = Window.partitionBy(*by).orderBy("stage_order").rowsBetween(0, Window.unboundedFollowing)
    last = len(stages) - 1
    full = grid.join(stage, [*by, "stage"], "left").withColumn("n_input", F.sum(n).over(rest))
    excluded = F.when(F.col("stage_order") == last, 0).otherwise(n)
    return full.select(*by, "stage_order", "stage", "n_input", excluded.cast("bigint").alias("n_excluded"), (F.col("n_input") - excluded).alias("n_remaining"))
