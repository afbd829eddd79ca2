"""Interaction screening: every failure code, selection and its caps, slopes against numpy, shared draws of two block lengths."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.params import interaction as PI
from sessionloom.plans import interaction as IN
from sessionloom.plans import research as RS

GOOD = dict(n=100, n_first=50, n_second=50, n_favourable=30, favourable_ic=0.05, beta=0.4, first_beta=0.3, second_beta=0.2, lower_10=0.1, p_10=0.001, lower_20=0.08, p_20=0.002)


def decide(spark, change):
    rows = []
    for h, (r, *_) in PI.HYPOTHESES.items():
        for e in PI.ENDPOINTS[r]:
            x = {**GOOD, **change(h, r, e)}
            codes = x.pop("codes", [])
            if r == "risk_guard":
                x["n_favourable"] = x["favourable_ic"] = None
            rows.append((h, r, 3, e, codes, *x.values()))
    types = ", ".join(f"{k} {'long' if k.startswith('n') else 'double'}" for k in GOOD)
    df = spark.createDataFrame(rows, f"hypothesis string, role string, horizon int, endpoint string, codes array<string>, {types}")
    return {r.hypothesis: r for r in IN.decisions(df).collect()}


def test_selection_and_caps(spark):
    d = decide(spark, lambda h, r, e: {"beta": 0.9 if h in ("strength_in_breadth", "range_in_volatility") else 0.4})
    assert {h for h, x in d.items() if x.status == "selected_model_candidate"} == {"strength_in_breadth", "range_in_volatility"}
    assert {x.status for x in d.values()} == {"selected_model_candidate", "qualified_not_selected_cap"}
    assert abs(d["strength_in_breadth"].raw_p - 0.002) < 1e-12 and abs(d["strength_in_breadth"].p_holm - 0.008) < 1e-12 and abs(d["range_in_volatility"].p_holm - 0.004) < 1e-12
    d = decide(spark, lambda h, r, e: {"beta": -0.1} if r == "candidate_alpha" else {})
    assert {x.status for x in d.values()} == {"rejected_screen", "qualified_not_selected_cap"}  # a guard alone is not selected


CODES = {
    "interaction_beta_not_positive": {"beta": 0.0}, "primary_block_lower_bound_not_positive": {"lower_10": -0.01}, "sensitivity_block_lower_bound_not_positive": {"lower_20": 0.0}, "first_half_beta_not_positive": {"first_beta": -0.1},
    "second_half_beta_not_positive": {"second_beta": 0.0}, "alpha_favorable_state_session_floor_not_met": {"n_favourable": 19}, "alpha_favorable_state_mean_rank_ic_not_positive": {"favourable_ic": -0.01},
    "holm_familywise_gate_failed": {"p_20": 0.06}, **{c: {"codes": [c]} for c in PI.INCONCLUSIVE},
}


def test_every_failure_code_is_reached_on_one_endpoint(spark):
    for code, change in CODES.items():
        d = decide(spark, lambda h, r, e: change if (h, e) == ("strength_in_breadth", "upper") else {})["strength_in_breadth"]  # noqa: B023
        assert d.failed == [code] and d.status == ("inconclusive_data" if code in PI.INCONCLUSIVE else "rejected_screen")
    none = {k: None for k in ("beta", "first_beta", "second_beta", "lower_10", "p_10", "lower_20", "p_20", "favourable_ic")}
    d = decide(spark, lambda h, r, e: {**none, "codes": ["regression_unavailable"]} if h == "volume_in_trend" else {})["volume_in_trend"]
    assert d.raw_p == 1.0 and d.worst_beta is None and d.status == "inconclusive_data" and "holm_familywise_gate_failed" in d.failed


def test_block_lengths_share_their_draws(spark):
    rng = np.random.default_rng(1)
    n, x, y = 33, rng.normal(size=33), rng.normal(size=33)
    df = spark.createDataFrame([("a", i * 3, float(x[i]), float(y[i])) for i in range(n)], "trial string, session_ix int, x double, y double")
    got = {(r.asked, r.rep): r.boot for r in RS.slope_bootstraps(df, "trial", "x", "y", 5, (10, 20, 50), "s").collect()}
    for asked in (10, 20, 50):
        block = min(asked, n)
        for rep in range(5):
            at = []
            for k in range(-(-n // block)):
                start = int(hashlib.md5(f"s|a|{rep}|{k}".encode()).hexdigest()[:8], 16) % n
                at += [(start + o) % n for o in range(block)]
            at = at[:n]
            assert np.isclose(got[asked, rep], np.polyfit(x[at], y[at], 1)[0])


def test_a_state_without_variation_has_no_regression(spark):
    rows = [("strength_in_breadth", "candidate_alpha", 3, "lower", s, 20, 1.0 if flat else float(s), 0.01 * s, "first" if s < 50 else "second") for s in range(100) for flat in [True]]
    ev = spark.createDataFrame(rows, "hypothesis string, role string, horizon int, endpoint string, session_ix int, n_obs long, state double, ic double, half string")
    out = {(r.hypothesis, r.horizon, r.endpoint): r for r in IN.summaries(ev, replicates=20).collect()}
    assert len(out) == 30 and out["strength_in_breadth", 3, "lower"].codes == ["regression_unavailable"] and out["strength_in_breadth", 3, "lower"].beta is None
    assert set(out["strength_in_breadth", 3, "upper"].codes) == set(PI.INCONCLUSIVE)
    good = ev.withColumn("state", F.col("session_ix").cast("double"))
    one = {(r.hypothesis, r.horizon, r.endpoint): r for r in IN.summaries(good, replicates=20).collect()}["strength_in_breadth", 3, "lower"]
    assert one.codes == [] and abs(one.beta - 0.01) < 1e-9 and abs(one.first_beta - 0.01) < 1e-9 and one.n_favourable == 99
