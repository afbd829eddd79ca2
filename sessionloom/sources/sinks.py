"""Session-partitioned sinks that never overwrite (SRC-06, SRC-07, STR-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.staging import cut
from sessionloom.operators.aggregates import multiset_fingerprint

KEY = ["instrument_id", "session_ix"]


def session_digests(df: DataFrame, fields: list[str]) -> DataFrame:
    """Order-independent content digest of each session."""
    row = F.to_json(F.struct(*KEY, *fields))
    return df.groupBy("session_ix").agg(*multiset_fingerprint(row))


def publish_plan(new: DataFrame, stored: DataFrame, fields: list[str]) -> DataFrame:
    """Per session: write (absent), no_op (same content) or conflict (different content)."""
    a = session_digests(new, fields).select("session_ix", F.col("fingerprint").alias("_new"))
    b = session_digests(stored, fields).select("session_ix", F.col("fingerprint").alias("_old"))
    return a.join(b, "session_ix", "left").select(
        "session_ix", F.when(F.col("_old").isNull(), "write").when(F.col("_old") == F.col("_new"), "no_op").otherwise("conflict").alias("action"))


def read_sessions(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Typed read-back; session_ix is the partition column, so session filters prune files."""
    return spark.read.schema(schema).parquet(root)


def publish_sessions(new: DataFrame, root: str, schema: str, fields: list[str]) -> DataFrame:
    """SRC-06: append the absent sessions; returns the plan it followed, conflicts included."""
    spark = new.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    # the batch's own range of sessions prunes the partitions that are read back
    first, last = new.agg(F.min("session_ix"), F.max("session_ix")).first()
    known = F.lit(False) if first is None else F.col("session_ix").between(first, last)
    stored = (read_sessions(spark, root, schema) if exists else spark.createDataFrame([], schema)).where(known)
    # stored before the append: a cached plan over the same folder would be refreshed by the write
    plan = cut(publish_plan(new, stored, fields))
    fresh = new.join(plan.where("action = 'write'").select("session_ix"), "session_ix", "left_semi")
    # large sessions are split over tasks, small ones share a task
    fresh.hint("rebalance", F.col("session_ix")).write.mode("append").partitionBy("session_ix").parquet(root)
    return plan
