"""JOB-48: blocks added to published accumulators give what one fold of everything gives."""

import random

import pytest

from sessionloom.plans import qualification as Q

REGISTRY = {"a": ("candidate_alpha", "g", 1), "b": ("candidate_alpha", "g", 2), "c": ("candidate_alpha", "h", 1), "d": ("risk_guard", "i", 1), "e": ("risk_guard", "i", 2)}
FLOORS = dict(availability=0.9, sessions=8, half=4, distinct=20, ties=0.95, alphas=2)
RULE = dict(sessions=8, correlation=0.9, share=0.8, sign=0.9)


@pytest.fixture(scope="module")
def panel(spark):
    rnd, rows = random.Random(3), []
    for s in range(1, 11):
        for i in range(12):
            x, d = rnd.gauss(0, 1), rnd.gauss(0, 1)
            rows.append((i, s, x, 2 * x + 1, x**3, d, None if i < 6 else float("nan") if i == 6 else 1.0))
    return spark.createDataFrame(rows, "instrument_id long, session_ix long, a double, b double, c double, d double, e double").repartition(4)


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def reports(state):
    return [rows(Q.diagnostics(state, 5)), rows(Q.pair_report(state, list(REGISTRY), RULE)), rows(Q.decisions(state, REGISTRY, 5, FLOORS, RULE))]


def test_added_blocks_equal_one_fold(spark, panel, tmp_path):
    root = str(tmp_path / "accumulators")
    Q.publish_block(Q.fold(panel.where("session_ix <= 6"), list(REGISTRY), 5, "b1"), root)
    Q.publish_block(Q.fold(panel.where("session_ix between 7 and 9"), list(REGISTRY), 5, "b2"), root)
    last = Q.fold(panel.where("session_ix = 10"), list(REGISTRY), 5, "b3")
    Q.publish_block(last, root)
    Q.publish_block(last, root)  # once more changes nothing
    assert reports(Q.published(spark, root)) == reports(Q.fold(panel, list(REGISTRY), 5))
    other = Q.fold(panel.where("session_ix = 9"), list(REGISTRY), 5, "b3")
    with pytest.raises(ValueError, match="differ"):
        Q.publish_block(other, root)


def test_decisions_name_what_fails(panel):
    got = {r.factor_id: r for r in Q.decisions(Q.fold(panel, list(REGISTRY), 5), REGISTRY, 5, FLOORS, RULE).collect()}
    assert [got[f].decision for f in "abcde"] == ["eligible", "rejected", "eligible", "eligible", "rejected"]
    assert got["b"].failed == "lower_priority_within_group_near_duplicate" and got["b"].repeats == "a"
    assert got["e"].failed == "availability_below_floor|distinct_values_below_floor"  # NaN is unavailable
    assert {f: got[f].component for f in "abcde"} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    assert {r.across_groups for r in got.values()} == {"a/c|b/c"} and {r.status for r in got.values()} == {"cross_group_review"}


def test_empty_panel_rejects_everything(panel):
    got = Q.decisions(Q.fold(panel.where("session_ix > 99"), list(REGISTRY), 5), REGISTRY, 5, FLOORS, RULE).collect()
    assert len(got) == 5 and {r.decision for r in got} == {"rejected"} and {r.status for r in got} == {"too_few_candidate_alphas"}
    assert all("availability_below_floor" in r.failed and r.across_groups == "" for r in got)
