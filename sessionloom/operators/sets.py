"""Set operations with duplicate and closure checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_unique(parts: Sequence[DataFrame], key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """SET-01: aligned union and the keys that occur more than once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, out.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def subset_report(small: DataFrame, big: DataFrame, key: str) -> DataFrame:
    """SET-02: is ``small`` a subset, a strict subset; how many are outside."""
    a = small.select(key).distinct().withColumn("_a", F.lit(1))
    b = big.select(key).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, key, "full_outer")
    outside, extra = F.count_if(F.col("_b").isNull()), F.count_if(F.col("_a").isNull())
    return j.agg((outside == 0).alias("is_subset"), ((outside == 0) & (extra > 0)).alias("is_strict_subset"), outside.alias("n_outside"), extra.alias("n_extra"))


def partition_check(parts: dict[str, DataFrame], expected: DataFrame, key: str) -> DataFrame:
    """SET-04: every expected key in exactly one part, and nothing else."""
    tagged = None
    for name, df in parts.items():
        p = df.select(key, F.lit(name).alias("part"))
        tagged = p if tagged is None else tagged.unionByName(p)
    seen = tagged.groupBy(key).agg(F.count(F.lit(1)).alias("n_parts"), F.min("part").alias("part"))
    return seen.join(expected.select(key).distinct().withColumn("_e", F.lit(1)), key, "full_outer").select(
        key, F.coalesce("n_parts", F.lit(0)).alias("n_parts"), "part", F.col("_e").isNotNull().alias("expected"),
        (F.col("_e").isNotNull() & (F.col("n_parts") == 1)).alias("closes"))


def multiset_difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """SET-07: rows whose multiplicity differs, with both counts (grouped, so copies never meet pairwise)."""
    both = left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    g = both.groupBy(*columns).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
    return g.where(F.col("n_left") != F.col("n_right"))
