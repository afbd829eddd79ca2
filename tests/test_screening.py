"""JOB-53: what the registered protocol decides, gate by gate, on made-up horizon results."""

import pytest

from sessionloom.plans import screening as P

REGISTRY = {"a": ("candidate_alpha", "g", 1), "b": ("candidate_alpha", "g", 1), "c": ("candidate_alpha", "h", 1), "d": ("candidate_alpha", "k", 1), "x": ("risk_guard", "h", -1), "y": ("risk_guard", "m", -1)}
GATES = dict(mean_ic=0.015, partial_ic=0.005, positive_share=0.55, largest_share=0.15, monotonic=0.8, decay=-0.01, alpha=0.05, sessions=50, half=24)
GOOD = dict(n_sessions=80, first_half=40, second_half=40, partial_sessions=80, mean_ic=0.05, lower=0.02, p_value=0.001, partial_mean_ic=0.04, partial_lower=0.01, partial_p_value=0.002, positive_share=0.7, largest_share=0.05,
            first_mean=0.05, second_mean=0.05, spread=0.01, monotonic=1.0)
COLUMNS = "trial string, " + ", ".join(f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in GOOD.items())


def decide(spark, caps=None, **changes):
    """Decisions when every factor is good but for ``changes`` (factor or factor_horizon: columns)."""
    rows = []
    for f in REGISTRY:
        for h in (1, 3, 5):
            change = changes.get(f"{f}_{h}", changes.get(f, {}) if h == 3 else {})
            if change is not None:  # None: no result
                rows.append((f"{f}|{h}", *{**GOOD, **change}.values()))
    df = spark.createDataFrame(rows, COLUMNS)
    return {r.factor_id: r for r in P.screening_decisions(df, REGISTRY, 3, (1, 5), GATES, caps or dict(candidate_alpha=2, risk_guard=1)).collect()}


def test_selection_under_caps_and_groups(spark):
    got = decide(spark, a=dict(mean_ic=0.03), c=dict(mean_ic=0.06, partial_mean_ic=0.06))
    assert {f: r.status for f, r in got.items()} == {"a": "qualified_not_selected_cap", "b": "selected_model_candidate", "c": "selected_model_candidate", "d": "qualified_not_selected_cap", "x": "qualified_not_selected_cap", "y": "selected_model_candidate"}
    assert got["a"].effect == 0.03 and got["a"].raw == 0.002 and got["a"].p_holm == pytest.approx(0.008)


def test_a_guard_needs_an_alpha(spark):
    got = decide(spark, **{f: dict(monotonic=0.5) for f in "abcd"})
    assert {got[f].failed for f in "abcd"} == {"bucket_monotonicity"} and {got[f].status for f in "xy"} == {"qualified_not_selected_cap"}


def test_every_gate_and_the_family(spark):
    got = decide(spark, a=dict(mean_ic=0.01, lower=0.0, partial_mean_ic=0.004, partial_lower=-0.01, positive_share=0.5, largest_share=0.2, first_mean=0.0, second_mean=-0.1, monotonic=None, spread=0.0, p_value=0.9), b_5=dict(mean_ic=-0.02), c=dict(n_sessions=49), d=dict(p_value=0.03))
    assert len(got["a"].failed.split("|")) == 11 and "decay_direction" not in got["a"].failed
    assert got["b"].failed == "decay_direction" and got["c"].status == "inconclusive_data"
    assert got["d"].failed == "holm_familywise_significance" and got["d"].p_holm == pytest.approx(0.06)  # 0.03 beside one larger p value


def test_a_factor_without_results_stays_in_its_family(spark):
    got = decide(spark, **{f"a_{h}": None for h in (1, 3, 5)})
    assert got["a"].status == "inconclusive_data" and got["a"].raw is None and got["a"].p_holm == 1.0 and "decay_direction" in got["a"].failed
    assert got["b"].p_holm == pytest.approx(0.008)
