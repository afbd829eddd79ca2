"""The composite's stream equals its batch form: late rows, restarts, a writer that fails in the middle of a batch."""

import tempfile

import pytest
from pyspark.sql import functions as F

from sessionloom.catalog import load
from sessionloom.catalog.core import Tables
from sessionloom.plans import market as M
from sessionloom.sources import families as FT
from sessionloom.streaming import composite as C
from sessionloom.streaming.state import rocksdb

COLUMNS = ["session_ix", "weight_available", "trend_score", "breadth_score", "volatility_score", "regime_score"]


@pytest.fixture(scope="module")
def panel(spark):
    load()
    from sessionloom.catalog.streams import composite_panel

    rows, settings = composite_panel(Tables(spark, "/root/testdata/sf0.001"))
    return rows.where("session_ix <= 40"), settings


def whole(panel, settings):
    rows = panel.withColumn("fresh", F.lit(True))
    of = lambda k: rows.where(F.col("kind") == k)
    own = M.member_metrics(of("member"), settings.n_members, settings.min_obs, settings.min_positive)
    scored = M.composite(own.join(M.benchmark_metrics(of("broad"), of("market"), settings.broad_required, settings.broad_minimum), "session_ix", "left"))
    return scored.where(F.col("session_ix") >= C.FIRST).select([F.round(c, 4).alias(c) if c.endswith("score") else F.col(c).cast("int").alias(c) for c in COLUMNS])


def stored(spark, root):
    return FT.read(spark, root, C.SCORES).select([F.round(c, 4).alias(c) if c.endswith("score") else F.col(c) for c in COLUMNS])


def test_stream_equals_batch_after_a_failed_write(spark, panel, monkeypatch):
    rows, settings = panel
    folder = tempfile.mkdtemp(prefix="run-")
    publish, calls = FT.publish, []

    def breaks_once(df, root, family, **more):
        calls.append(family.name)
        if family is C.SCORES and calls.count(family.name) == 2:
            raise RuntimeError("writer lost")
        return publish(df, root, family, **more)

    monkeypatch.setattr(FT, "publish", breaks_once)
    with rocksdb(spark):
        for lo, hi in ((1, 24), (25, 33), (34, 40)):
            part = rows.where(F.col("session_ix").between(lo, hi))
            if lo == 34:
                part = part.unionByName(rows.where("session_ix = 20").withColumn("close", F.lit(1.0)))
            part.coalesce(1).write.mode("append").parquet(f"{folder}/source")
            C.accept_sessions(spark, f"{folder}/source", f"{folder}/accepted", f"{folder}/late", f"{folder}/a").awaitTermination()
            run = lambda: C.run_composite(spark, f"{folder}/accepted", f"{folder}/store", settings, f"{folder}/b").awaitTermination()
            if lo == 25:
                with pytest.raises(Exception, match="writer lost"):
                    run()
                assert FT.read(spark, f"{folder}/store", C.SUMS).agg(F.max("session_ix")).first()[0] == 33  # one of two tables was written
            run()
    got, want = stored(spark, f"{folder}/store"), whole(rows, settings)
    assert got.count() == 20 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    late = spark.read.schema(C.BARS).parquet(f"{folder}/late")
    assert late.select("session_ix").distinct().collect() == [(20,)] and late.count() == rows.where("session_ix = 20").count()
