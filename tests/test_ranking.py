"""Distributed ranks against brute force, with hot values and a hot group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.functions.ranking import median_mad, nearest_rank, quantiles, rank_table, with_midrank
from sessionloom.operators.crosssection import percentile_0_100, robust_score

rng = np.random.default_rng(7)
GROUPS = {
    0: np.concatenate([np.full(700, 3.25), rng.normal(size=1400)]),  # one value holds a third of the hot group
    1: rng.integers(0, 5, 50).astype(float),
    2: np.array([4.0]),
    3: np.full(9, 2.0),
    4: np.exp(rng.normal(size=301) * 8),
}


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(g, i, float(x)) for g, xs in GROUPS.items() for i, x in enumerate(xs)] + [(0, 99999, None)]
    return spark.createDataFrame(rows, "g int, i int, x double")


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_ranks(panel, buckets):
    got = {(r.g, r.x): r for r in rank_table(panel, ["g"], "x", buckets).collect()}
    for g, xs in GROUPS.items():
        for v in np.unique(xs):
            r = got[(g, v)]
            lower, tied = int((xs < v).sum()), int((xs == v).sum())
            assert (r.n_lower, r.n_tied, r.n_group, r.midrank) == (lower, tied, len(xs), lower + (tied + 1) / 2)


def test_quantiles(panel):
    got = {r.g: r for r in quantiles(panel, ["g"], "x", {"a": 0.05, "b": 0.5, "c": 0.95}, 8).collect()}
    near = {r.g: r.d for r in nearest_rank(panel, ["g"], "x", {"d": 0.3}, 8).collect()}
    for g, xs in GROUPS.items():
        assert np.allclose([got[g].a, got[g].b, got[g].c], np.quantile(xs, [0.05, 0.5, 0.95]))
        assert near[g] == np.sort(xs)[max(int(np.ceil(0.3 * len(xs))), 1) - 1]


def test_median_mad(panel):
    got = {r.g: r for r in median_mad(panel, ["g"], "x").collect()}
    for g, xs in GROUPS.items():
        m = np.median(xs)
        assert np.isclose(got[g].med, m) and np.isclose(got[g].mad, np.median(np.abs(xs - m)))


def test_scores_keep_every_row(panel):
    n = panel.where("x is not null").count()
    scored = robust_score(panel, "x", ["g"])
    assert scored.count() == n
    assert scored.where("score < 0 or score > 100 or score is null").count() == 0
    pct = percentile_0_100(panel, "x", ["g"])
    assert {r.pct for r in pct.where("g = 3").select("pct").distinct().collect()} == {50.0}


def test_partitioning_does_not_change_ranks(panel):
    a = with_midrank(panel, ["g"], "x").select("g", "i", "midrank")
    b = with_midrank(panel.repartition(7, F.rand(3)), ["g"], "x").select("g", "i", "midrank")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_small_groups_and_buckets_agree(panel, monkeypatch):
    """A small group is ranked by one sort, a larger one in buckets; both keep every row and drop a group without a key."""
    from sessionloom.functions import ranking as R
    from sessionloom.operators.aggregates import partial_rank_ic, rank_ic

    df = panel.unionByName(panel.where("g = 1").withColumn("g", F.lit(None).cast("int"))).withColumns({"y": F.abs(F.col("x") - 1), "z": F.col("i") % 7.0})

    def results():
        ranks = R.with_midrank(df, ["g"], "x")
        assert ranks.columns == ["g", "x", "i", "y", "z", "n_lower", "n_tied", "n_group", "midrank"]
        return [sorted(map(tuple, d.collect())) for d in (ranks, quantiles(df, ["g"], "x", {"q": 0.3}), rank_ic(df.where("g in (0, 1)"), ["g"], "x", "y"), partial_rank_ic(df.where("g in (0, 1)"), ["g"], "x", "y", "z"))]

    shuffles = R.with_midrank(df, ["g"], "x")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles == 1  # no table of ranks is joined back
    small = results()
    monkeypatch.setattr(R, "WHOLE", 3)
    for a, b in zip(small, results()):
        assert len(a) == len(b) and all(np.allclose(p, q) for p, q in zip(a, b))
