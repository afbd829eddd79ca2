"""Helpers shared by the text operators: stored intermediates, joins with small sides, row packing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast after it has been counted; keys and a few numbers a row, so some ten megabytes.
BROADCAST_ROWS = 100_000
#: Copies of a side that is too large to broadcast, joined by (key, salt) so that a hot key meets many tasks.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a private folder only where none is set (tests on one machine)."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="sessionloom-"))
            current = sc._jsc.sc().getCheckpointDir()
        folder = current.get()
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here and every executor sees the files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 256):
    """Arrow batches in pieces of at most ``rows`` rows, so that only few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on ``keys``."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def join_small(big: DataFrame, small: DataFrame, key: str, spread: Column, bound: int = BROADCAST_ROWS, how: str = "left") -> DataFrame:
    """Join ``small`` (one row per ``key``, nulls match) to ``big``.

    The rows of ``small`` are counted first. Within ``bound`` it is broadcast; beyond it, ``small`` is
    copied per salt and ``big`` is dealt by (key, salt of ``spread``), so a hot key is met by many tasks.
    """
    small = small.withColumnRenamed(key, "__small_key")
    if small.count() <= bound:
        return big.join(F.broadcast(small), big[key].eqNullSafe(F.col("__small_key")), how).drop("__small_key")
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("__small_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = salted[key].eqNullSafe(F.col("__small_key")) & (F.col("__salt") == F.col("__small_salt"))
    return salted.join(copies, on, how).drop("__small_key", "__small_salt", "__salt")


def numbered(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """``df`` with ``name``: 0-based row numbers in ``order``, by range partitions and the counts before each of them.

    Only one count per partition meets in one place.
    """
    from pyspark.sql import Window

    parts = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    local = parts.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return local.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__row") - 1).drop("__part", "__row", "__before")


def join_counted(big: DataFrame, counted: DataFrame, keys: list[str], spread: list[str], n: str = "n") -> DataFrame:
    """Inner join of ``big`` with ``counted``, which has one row per key and in column ``n`` the rows of ``big`` that have it.

    Keys with more rows than a quarter of an even share of a task are split: ``counted`` is copied once per part and the rows of
    ``big`` are dealt to the parts by a hash of ``spread``. Fewer than four keys per task can be that heavy, so their list is
    broadcast and the copies stay within four per task. Apart from that list nothing is broadcast: the join is dealt in the same way at
    every size. ``counted`` should be stored; it is read three times.
    """
    tasks = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counted.agg(F.sum(n)).first()[0] or 0
    share = max(1, -(-total // (4 * tasks)))
    parts = F.ceil(F.col(n) / share).cast("int")
    heavy = counted.filter(F.col(n) > share).select(*keys, parts.alias("__parts"))
    salt = F.coalesce(F.pmod(F.xxhash64(F.lit(29), *spread), F.col("__parts")), F.lit(0)).cast("int")
    salted = big.join(F.broadcast(heavy), keys, "left").withColumn("__salt", salt).drop("__parts")
    copies = counted.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0)))))
    return salted.join(copies.hint("merge"), [*keys, "__salt"]).drop("__salt")
