"""Family tables: idempotent publication, conflicts, crashes between the steps, two writers, invalid rows, typed read-back."""

import tempfile

import pytest
from pyspark.sql import functions as F

from sessionloom.sources import families as FT

LEDGER = FT.Family("ledger", "provider string, year int, id long, value decimal(38,10), note string", ("provider", "year"), ("id",), ("note",))


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="run-")


def rows(spark, data):
    return spark.createDataFrame([(*r, 1) for r in data], "provider string, year int, id long, value double, note string, extra int")


def acts(plan):
    return {(r.provider, r.year): r.action for r in plan.collect()}


BASE = [("a b/c", 2001, i, i / 4, None if i % 3 else "x") for i in range(20)] + [("q", 2002, i, 1.5, "y") for i in range(5)]


def test_publish_republish_conflict_and_read(spark, root):
    df = rows(spark, BASE)
    assert FT.read(spark, root, LEDGER).count() == 0
    assert acts(FT.publish(df.where("year = 2001"), root, LEDGER)) == {("a b/c", 2001): "write"}
    assert acts(FT.publish(df.orderBy(F.desc("id")), root, LEDGER)) == {("a b/c", 2001): "no_op", ("q", 2002): "write"}
    odd = df.withColumn("note", F.when((F.col("id") == 3) & (F.col("year") == 2001), "z").otherwise(F.col("note")))
    late = rows(spark, [("q", 2003, 1, 2.0, None)])
    assert acts(FT.publish(odd.unionByName(late), root, LEDGER)) == {("a b/c", 2001): "conflict", ("q", 2002): "no_op", ("q", 2003): "write"}
    back = FT.read(spark, root, LEDGER)
    assert [(f.name, f.dataType.simpleString()) for f in back.schema] == [("provider", "string"), ("year", "int"), ("id", "bigint"), ("value", "decimal(38,10)"), ("note", "string")]
    assert back.exceptAll(LEDGER.typed(df.unionByName(late))).count() == 0 and back.count() == 26
    assert "PartitionFilters: [" in back.where("year = 2002")._jdf.queryExecution().toString() and back.where("year = 2002").count() == 5
    assert FT.manifest(spark, root, LEDGER).agg(F.max("version")).first()[0] == 3


def test_crash_between_staging_and_commit(spark, root):
    df = rows(spark, BASE)
    FT.publish(df.where("year = 2002"), root, LEDGER)
    plan = FT.plan(df, root, LEDGER).where("action = 'write'")
    lost = FT.stage(df.where("id < 4"), plan, root, LEDGER)  # a part of the rows, and the writer is gone
    assert FT.read(spark, root, LEDGER).count() == 5 and FT.abandoned(spark, root, LEDGER) == [lost]
    assert acts(FT.publish(df, root, LEDGER)) == {("a b/c", 2001): "write", ("q", 2002): "no_op"}
    assert FT.read(spark, root, LEDGER).count() == 25 and FT.abandoned(spark, root, LEDGER) == [lost]


def test_two_writers(spark, root):
    df = rows(spark, BASE)
    todo = FT.plan(df, root, LEDGER).where("action = 'write'")
    listed = todo.select("partition", "n", "fingerprint").collect()
    mine, other = (FT.stage(df, todo, root, LEDGER) for _ in range(2))
    assert FT.commit(spark, root, LEDGER, other, listed, 1)
    assert not FT.commit(spark, root, LEDGER, mine, listed, 1)
    assert FT.read(spark, root, LEDGER).count() == 25
    assert acts(FT.publish(df, root, LEDGER)) == {("a b/c", 2001): "no_op", ("q", 2002): "no_op"}


def test_later_writer_plans_again(spark, root, monkeypatch):
    df = rows(spark, BASE)
    commit, calls = FT.commit, []

    def beaten_once(spark_, root_, family, publication, todo, version):
        calls.append(version)
        if len(calls) == 1:
            commit(spark_, root_, family, FT.stage(df.where("year = 2001"), FT.plan(df.where("year = 2001"), root_, family), root_, family), [r for r in todo if "2001" in r["partition"]], version)
        return commit(spark_, root_, family, publication, todo, version)

    monkeypatch.setattr(FT, "commit", beaten_once)
    assert acts(FT.publish(df, root, LEDGER)) == {("a b/c", 2001): "no_op", ("q", 2002): "write"}
    assert calls == [1, 2] and FT.read(spark, root, LEDGER).count() == 25


def test_invalid_rows_are_refused(spark, root):
    bad = rows(spark, [*BASE, ("q", 2002, 3, 9.0, "again"), ("r", 2004, 1, None, "no value"), ("s", 2005, 1, 1.0, None), (None, 2006, 1, 1.0, None)])
    assert acts(FT.publish(bad, root, LEDGER)) == {("a b/c", 2001): "write", ("q", 2002): "invalid", ("r", 2004): "invalid", ("s", 2005): "write", (None, 2006): "invalid"}
    assert FT.read(spark, root, LEDGER).count() == 21
    with pytest.raises(Exception):
        FT.publish(bad.drop("value"), root, LEDGER)
    assert FT.publish(bad.limit(0), root, LEDGER).count() == 0


def test_large_partition_is_written_by_several_tasks(spark, root, monkeypatch):
    """Rows that compress to little are dealt by their count, so no task sorts a whole partition."""
    monkeypatch.setattr(FT, "FILE_ROWS", 100, raising=False)
    df = rows(spark, [("a", 2001, i, 1.0, "y") for i in range(1000)] + [(None, 2002, i, 1.0, "y") for i in range(5)])
    todo = FT.plan(df, root, LEDGER)
    publication = FT.stage(df, todo, root, LEDGER)
    back = spark.read.parquet(f"{root}/ledger/data/publication={publication}")
    assert back.count() == 1005 and back.select("id").distinct().count() == 1000
    sizes = [r["count"] for r in back.where("year = 2001").groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 3 and max(sizes) < 500
