"""Bitemporal filing plans: availability, conflicts, point-in-time selection, TTM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def availability_conflicts(facts: DataFrame, period: list[str]) -> DataFrame:
    """AGG-32: per semantic period, conflicts inside an accession and between filings available at one time."""
    v, at = F.col("value"), F.col("available_at")
    acc = facts.groupBy(*period, "accession").agg(
        F.count(F.lit(1)).alias("_n"), (F.min(v).eqNullSafe(F.max(v)) & F.min(at).eqNullSafe(F.max(at)) & (F.count(at) == F.count(F.lit(1)))).alias("_ok"),
        F.max(at).alias("_at"), F.max(v).alias("_v"))
    per = acc.groupBy(*period).agg(
        F.count_if(~F.col("_ok")).alias("within_accession_conflicts"), F.count_if(F.col("_ok") & (F.col("_n") > 1)).alias("exact_duplicate_groups"))
    times = acc.where("_ok").groupBy(*period, "_at").agg((F.min("_v") != F.max("_v")).alias("_bad"))
    times = times.groupBy(*period).agg(F.count_if("_bad").alias("same_time_conflicts"))
    out = per.join(times, period, "left").withColumn("same_time_conflicts", F.coalesce("same_time_conflicts", F.lit(0)))
    return out.withColumn("clean", (F.col("within_accession_conflicts") == 0) & (F.col("same_time_conflicts") == 0))


def clean_accessions(facts: DataFrame, period: list[str]) -> DataFrame:
    """One row per (period, availability time) with its value, or a conflict flag (WIN-27)."""
    v = F.col("value")
    return facts.groupBy(*period, "available_at").agg(F.min(v).alias("value"), (F.min(v) != F.max(v)).alias("conflict"))


def point_in_time(facts: DataFrame, key: list[str], cutoff) -> DataFrame:
    """JOB-42 / STR-08: what was known at the cutoff: the latest period, its latest value, quarantined on conflict.

    Three partial aggregations in a row; no window over an issuer's filings.
    """
    known = facts.where(F.col("available_at") <= cutoff)
    per_time = clean_accessions(known, [*key, "period_end"])
    latest = per_time.groupBy(*key, "period_end").agg(
        F.max(F.struct("available_at", "value", "conflict")).alias("last"), F.count(F.lit(1)).alias("n_versions"))
    top = latest.groupBy(*key).agg(F.max(F.struct("period_end", "last", "n_versions")).alias("t"), F.count(F.lit(1)).alias("n_periods"))
    bad = F.col("t.last.conflict")
    return top.select(*key, F.col("t.period_end").alias("period_end"), F.col("t.last.available_at").alias("available_at"), F.col("t.n_versions").alias("n_versions"), "n_periods",
                      F.when(~bad, F.col("t.last.value")).alias("value"), F.when(bad, "quarantined_conflict").otherwise("selected").alias("status"))


def ttm(quarters: DataFrame, key: str = "cik") -> DataFrame:
    """WIN-28 / JOB-44: discrete quarters from year-to-date values and the trailing four-quarter sum.

    ``quarters`` holds one row per (issuer, fiscal quarter index), so an issuer's group is bounded by time.
    """
    from pyspark.sql import Window

    by = Window.partitionBy(key).orderBy("q_ix")
    prev = F.when(F.col("q_ix") - F.lag("q_ix").over(by) == 1, F.lag("ytd").over(by))
    df = quarters.withColumn("discrete", F.when(F.col("fq") == 1, F.col("ytd")).otherwise(F.col("ytd") - prev))
    five = F.col("q_ix") - F.lag("q_ix", 4).over(by) == 4
    last4 = by.rowsBetween(-3, 0)
    ok = five & (F.count("discrete").over(last4) == 4)
    return df.select("*", F.when(ok, F.sum("discrete").over(last4)).alias("ttm"), F.when(ok, "derived").otherwise("not_consecutive").alias("status"))
