"""Family tables: typed, partitioned by several keys, immutable once published (SRC-07).

A publication stages its files under ``data/publication=<id>/`` and takes effect by one step, the creation of the next numbered manifest, which
lists its partitions with their fingerprints. Readers follow the manifests, so files of a publication that ended early
are never read and never count as a conflict. Two writers that saw the same last manifest can't both create the
next one; the later one plans again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sessionloom.functions.staging import cut
from sessionloom.operators.aggregates import multiset_fingerprint

#: Rows of a partition that one task sorts and writes as one file.
FILE_ROWS = 250_000
MANIFEST = "version long, publication string, partition string, n long, fingerprint string, schema_version string"


@dataclass(frozen=True)
class Family:
    """One kind of table: columns in DDL, the keys it is partitioned by, the columns that identify a row, columns that may be null."""

    name: str
    schema: str
    partitions: tuple[str, ...]
    identity: tuple[str, ...]
    nullable: tuple[str, ...] = ()
    schema_version: str = "v1"

    @cached_property
    def fields(self) -> tuple[str, ...]:
        names = tuple(StructType.fromDDL(self.schema).fieldNames())
        if missing := {*self.partitions, *self.identity, *self.nullable} - {*names}:
            raise ValueError(f"{self.name}: no such columns {sorted(missing)}")
        return names

    def typed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with this family's columns and types; a missing column is an error, an extra one is left out."""
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(self.schema)])


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def manifest(spark: SparkSession, root: str, family: Family) -> DataFrame:
    """One row per published partition."""
    path = f"{root}/{family.name}/manifest"
    fs, p = _fs(spark, path)
    return spark.read.schema(MANIFEST).json(path) if fs.exists(p) else spark.createDataFrame([], MANIFEST)


def _partition(family: Family) -> Column:
    """The values of the partition keys as text, in the keys' order."""
    return F.to_json(F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in family.partitions]))


def digests(rows: DataFrame, family: Family) -> DataFrame:
    """Per partition: rows, order-independent fingerprint, and whether identities are unique and required columns set.

    Rows of one identity are counted before they meet their partition, so a large partition is many partial sums.
    """
    required = [c for c in family.fields if c not in family.nullable]
    gap = F.lit(False)
    for c in required:
        gap = gap | F.col(c).isNull()
    row = F.to_json(F.struct(*family.fields), {"ignoreNullFields": "false"})
    parts = rows.groupBy(*family.partitions).agg(F.count(F.lit(1)).alias("n"), *multiset_fingerprint(row), F.count_if(gap).alias("gaps"))
    keys = [*family.partitions, *[c for c in family.identity if c not in family.partitions]]
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).groupBy(*family.partitions).agg(F.count_if(F.col("times") > 1).alias("repeats"))
    same = [parts[k].eqNullSafe(twice[k]) for k in family.partitions]
    both = parts.join(twice, on=same).select(*[parts[k] for k in family.partitions], "n", "fingerprint", "gaps", "repeats")
    return both.withColumn("partition", _partition(family))


def plan(rows: DataFrame, root: str, family: Family) -> DataFrame:
    """Per partition of ``rows``: write (new), no_op (published with the same content), conflict (with other content) or invalid."""
    known = manifest(rows.sparkSession, root, family).select("partition", F.col("fingerprint").alias("published"))
    new = digests(family.typed(rows), family)
    action = (F.when((F.col("gaps") > 0) | (F.col("repeats") > 0), "invalid").when(F.col("published").isNull(), "write")
              .when(F.col("published") == F.col("fingerprint").cast("string"), "no_op").otherwise("conflict"))
    return new.join(known, "partition", "left").select(*family.partitions, "partition", "n", F.col("fingerprint").cast("string").alias("fingerprint"), action.alias("action"))


def stage(rows: DataFrame, todo: DataFrame, root: str, family: Family) -> str:
    """Write the partitions that ``todo`` lists, out of readers' sight; returns the publication's id.

    Large partitions are split over tasks by their counted rows (a shuffle's bytes say little of rows that compress well), and small ones share a task.
    """
    publication = uuid.uuid4().hex
    typed = family.typed(rows)
    listed = todo.groupBy(*family.partitions).agg(F.ceil(F.max("n") / FILE_ROWS).alias("_slices"))
    fresh = typed.join(listed, on=[typed[k].eqNullSafe(listed[k]) for k in family.partitions]).select(*[typed[c] for c in family.fields], "_slices")
    keys = [F.col(k) for k in family.partitions]
    tasks = max(1, -(-(todo.agg(F.sum("n")).first()[0] or 0) // FILE_ROWS))
    dealt = fresh.withColumn("_slice", F.pmod(F.xxhash64(*family.identity), "_slices")).repartition(tasks, *keys, "_slice").drop("_slice", "_slices")
    ordered = dealt.sortWithinPartitions(*keys, *family.identity)
    ordered.write.partitionBy(*family.partitions).parquet(f"{root}/{family.name}/data/publication={publication}")
    return publication


def commit(spark: SparkSession, root: str, family: Family, publication: str, todo: list, version: int) -> bool:
    """Create manifest ``version``; False where another writer was first. The file holds one line for each partition of this publication."""
    lines = [json.dumps({"version": version, "publication": publication, "partition": r["partition"], "n": r["n"], "fingerprint": r["fingerprint"], "schema_version": family.schema_version}) for r in todo]
    fs, path = _fs(spark, f"{root}/{family.name}/manifest/{version:012d}.json")
    _, staged = _fs(spark, f"{root}/{family.name}/staged-{publication}")
    out = fs.create(staged, False)
    out.write(bytearray(("\n".join(lines) + "\n").encode()))
    out.close()
    fs.mkdirs(path.getParent())
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:  # refuses an existing target, and readers see the whole file or none
        files.rename(fs.makeQualified(staged), fs.makeQualified(path), spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        fs.delete(staged, False)
        return False
    return True


def publish(rows: DataFrame, root: str, family: Family, attempts: int = 5) -> DataFrame:
    """Publish the partitions of ``rows`` that are new, all or none; returns the plan that took effect."""
    spark = rows.sparkSession
    for _ in range(attempts):
        version = (manifest(spark, root, family).agg(F.max("version")).first()[0] or 0) + 1
        decided = cut(plan(rows, root, family))
        todo = decided.where("action = 'write'").select("partition", "n", "fingerprint").collect()  # one row per partition written
        if not todo:
            return decided.drop("partition")
        publication = stage(rows, decided.where("action = 'write'"), root, family)
        if commit(spark, root, family, publication, todo, version):
            return decided.drop("partition")
    raise RuntimeError(f"{family.name}: other writers were first {attempts} times")


def read(spark: SparkSession, root: str, family: Family) -> DataFrame:
    """Published rows with the family's types; filters on the partition keys prune files."""
    seen = [r[0] for r in manifest(spark, root, family).select("publication").distinct().collect()]  # one per publication
    if not seen:
        return spark.createDataFrame([], family.schema)
    typed = StructType.fromDDL(family.schema).add("publication", "string")
    rows = spark.read.schema(typed).parquet(f"{root}/{family.name}/data")
    return rows.where(F.col("publication").isin(seen)).select(*family.fields)


def abandoned(spark: SparkSession, root: str, family: Family) -> list[str]:
    """Publications that were staged and never committed, for the folder's owner to remove."""
    fs, p = _fs(spark, f"{root}/{family.name}/data")
    if not fs.exists(p):
        return []
    there = {x.getPath().getName().removeprefix("publication=") for x in fs.listStatus(p)}
    seen = {r[0] for r in manifest(spark, root, family).select("publication").distinct().collect()}
    return sorted(there - seen)


#: The families of the research store.
ACTIONS = Family(
    "corporate-action-observation",
    "provider string, event_year int, action_id string, action_type string, instrument_id long, effective_ix int, split_from decimal(38,10), split_to decimal(38,10), cash_amount decimal(38,10), resolution string",
    ("provider", "event_year"), ("action_id",), ("split_from", "split_to", "cash_amount"))
LIFECYCLE = Family(
    "instrument-lifecycle", "as_of_date date, instrument_id long, ticker string, primary_exchange string, first_tradable_date date, last_tradable_date date, lifecycle_status string",
    ("as_of_date",), ("instrument_id",), ("primary_exchange", "last_tradable_date"))
MEMBERSHIP = Family(
    "universe-membership", "methodology_version string, quarter int, universe_id string, instrument_id long, session_ix int, disposition string, is_member boolean",
    ("methodology_version", "quarter"), ("universe_id", "instrument_id", "session_ix"), ("is_member",))
ADJUSTMENTS = Family(
    "adjustment-ledger", "methodology_version string, basis_ix int, instrument_id long, source_ix int, split_price_multiplier decimal(38,10), status string",
    ("methodology_version", "basis_ix"), ("instrument_id", "source_ix"), ("split_price_multiplier",))
FAMILIES = (ACTIONS, LIFECYCLE, MEMBERSHIP, ADJUSTMENTS)
