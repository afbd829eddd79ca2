"""Factor-space diagnostic against numpy: random, singular, constant and unsupported columns."""

import numpy as np
import pytest

from sessionloom.plans import factor_space as FS

NAMES = ["a", "b", "c", "d", "e"]


def frame(spark, values):
    rows = [(i, *[None if np.isnan(x) else float(x) for x in r]) for i, r in enumerate(values)]
    return spark.createDataFrame(rows, "session_ix int, " + ", ".join(f"{c} double" for c in NAMES))


def report(df):
    return {(r.kind, r["item"]): r.value for r in df.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_matrix_equals_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5))
    got = report(FS.matrix_report(FS.components(FS.correlation_row(frame(spark, x), NAMES), NAMES), NAMES))
    c = np.corrcoef(x, rowvar=False)
    values, vectors = np.linalg.eigh(c)
    order = np.argsort(-values)
    for j, k in enumerate(order):
        v = vectors[:, k] * np.sign(vectors[np.argmax(np.abs(vectors[:, k])), k])
        assert np.isclose(got["eigenvalue", str(j + 1)], values[k])
        assert np.allclose([got["loading", f"{j + 1}:{n}"] for n in NAMES], v)
    assert np.allclose([got["vif", n] for n in NAMES], np.diag(np.linalg.inv(c)))
    assert np.isclose(got["condition", ""], np.linalg.cond(c)) and got["rank", ""] == 5
    assert np.isclose(got["participation", ""], 25 / (values**2).sum()) and got["kaiser", ""] == (values > 1).sum()


def test_singular_and_unusable(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5))
    x[:, 4] = 2 * x[:, 0]
    got = report(FS.matrix_report(FS.components(FS.correlation_row(frame(spark, x), NAMES), NAMES), NAMES))
    assert got["rank", ""] == 4 and got["condition", ""] is None and got["vif", "b"] is None
    x[:, 4] = 7.0  # no variation
    got = report(FS.matrix_report(FS.components(FS.correlation_row(frame(spark, x), NAMES), NAMES), NAMES))
    assert got["complete_rows", ""] == 40 and got["eigenvalue", "1"] is None
    got = report(FS.matrix_report(FS.components(FS.correlation_row(frame(spark, x[:5]), NAMES), NAMES), NAMES))
    assert got["complete_rows", ""] == 5 and got["rank", ""] is None


def test_scales_and_pair_support(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    x[5:20, 1] = np.nan
    x[10:15, 2] = np.nan
    x[:, 3] = np.where(np.arange(60) < 40, 1.0, np.arange(60))  # most values are equal: no MAD
    got = report(FS.diagnostic(frame(spark, x), ["session_ix"], NAMES))
    assert got["std_fallback", "d"] == 1 and got["std_fallback", "a"] == 0
    assert np.isclose(got["scale", "d"], x[:, 3].std(ddof=1)) and np.isclose(got["scale", "a"], 1.4826 * np.median(np.abs(x[:, 0] - np.median(x[:, 0]))))
    assert (got["both", "b/c"], got["neither", "b/c"], got["both", "a/c"], got["complete_rows", ""]) == (45, 5, 55, 45)
    both = ~np.isnan(x[:, 1])
    assert np.isclose(got["pearson", "a/b"], np.corrcoef(x[both, 0], x[both, 1])[0, 1])
