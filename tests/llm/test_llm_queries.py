"""Registered text queries against their SQL, and the pipeline stage by stage."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sessionloom.llm import queries
from tools.check import norm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_matches_sql(spark, key):
    duck = duckdb.connect()
    duck.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES[key](spark, SF)
    cur = duck.execute(queries.ORACLES[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == sorted((tuple(norm(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)


def test_registered():
    names = set(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        rows = corpus_pipeline.stored(out, "t")
    direct = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.n_tokens) for r in direct.collect()) == sorted((r.doc_id, r.n_tokens) for r in rows.collect())
    assert direct.filter("not round_trip").count() == 0
