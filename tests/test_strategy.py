"""Outcome intervals, stage locks, the single reading of the holdout, selection under endpoint scenarios."""

import tempfile

import pytest
from pyspark.sql import functions as F

from sessionloom.params import strategy as PS
from sessionloom.plans import strategy_stages as SG
from sessionloom.plans import strategy_statistics as ST

ROWS = "combo int, signal boolean, instrument_id long, session_ix int, regime string, horizon int, state string, lower double, upper double, rel_lower double, rel_upper double, favourable double, adverse double"


def test_outcome_states_and_bounds(spark):
    sessions = {1: [1, 2, 3, 4, 5, 6, 9], 2: [1, 2, 3], 3: [1, 3, 4], 4: [1, 2, 8], 5: [1, 2, 9]}
    price = lambda k, s: 1000.0 if (k, s) == (5, 9) else 10.0 * k + s
    bars = spark.createDataFrame([(k, s, price(k, s), price(k, s) + 1, price(k, s) - 1, price(k, s)) for k, ss in sessions.items() for s in ss], "instrument_id long, session_ix int, open double, high double, low double, close double")
    market = spark.createDataFrame([("M", s, 100.0, 100.0 + s) for s in range(1, 13)], "instrument_id string, session_ix int, open double, close double")
    out = ST.outcomes(bars, market, 10.0).where("session_ix = 1").select("instrument_id", F.inline("labels"))
    got = {(r.instrument_id, r.horizon): r for r in out.collect()}
    states = {k: r.state for k, r in got.items()}
    assert [states[1, h] for h in (1, 3, 5)] == ["observed_eod_exact"] * 3
    assert [states[2, h] for h in (1, 3, 5)] == ["observed_eod_exact", "terminal_reference_exact", "terminal_reference_exact"]
    assert {states[3, h] for h in (1, 3, 5)} == {"unexecutable_no_next_open"} and got[3, 3].lower is None
    assert [states[4, h] for h in (1, 3, 5)] == ["observed_eod_exact", "terminal_reference_interval", "terminal_reference_interval"]
    assert [states[5, h] for h in (1, 3, 5)] == ["observed_eod_exact", "unavailable_evidence", "unavailable_evidence"]
    r = got[4, 3]  # entry at 42, closes 42 and 48 around the missing session, the market from 100 to 104
    assert (round(r.lower, 9), round(r.upper, 9)) == (0.0, round(48 / 42 - 1, 9)) and round(r.rel_lower, 9) == -0.04 and round(r.favourable, 9) == round(43 / 42 - 1, 9)
    assert round(got[2, 5].lower, 9) == round(23 / 22 - 1, 9) and got[2, 5].lower == got[2, 5].upper
    late = ST.outcomes(bars, market, 10.0).where("session_ix = 9").select(F.inline("labels")).collect()
    assert {x.state for x in late} == {"unexecutable_no_next_open"}


def rows(spark, edge):
    """24 combinations whose signals beat their controls by ``edge`` in most sessions; combination 7 most."""
    data = [(c, sig, i, s, "balanced", h, "observed_eod_exact", x, x, x, x, abs(x), -abs(x))
            for c in range(24) for h in (1, 3, 5) for s in range(25) for i in range(6) for sig in [i < 3] for x in [((edge * (3 if c == 7 else 1) + 0.004 * ((s * 7 + i) % 5 - 1)) if sig else 0.001 * (s % 3)) + 1e-5 * c]]
    return spark.createDataFrame(data, ROWS)


def refuse():
    raise AssertionError("rows were read")


def test_stages_open_one_another_once(spark):
    root, floors, few = tempfile.mkdtemp(prefix="run-"), (60, 20, 60), dict(replicates=300)
    good = rows(spark, 0.02)
    with pytest.raises(SG.StageLocked):
        SG.run_validation(refuse, spark, root, "p", floors)
    with pytest.raises(SG.StageLocked):
        SG.run_holdout(refuse, spark, root, "p", floors)
    table = SG.run_development(good, root, "p", floors, **few)
    assert table.count() == 72 and SG.opened(spark, root, "p", "development") == 7
    with pytest.raises(SG.StageLocked):  # nobody has validated yet
        SG.run_holdout(refuse, spark, root, "p", floors)
    with pytest.raises(SG.StageLocked):  # the lock can't be moved
        SG.decide(spark, root, "p", "development", 3, 0.1, True)
    validated, gates = SG.run_validation(lambda: good, spark, root, "p", floors, **few)
    assert {r.outcome for r in gates.collect()} == {"pass"} and validated.where("horizon = 3 and adjusted_p <= 0.1").count() == 24
    held, gates = SG.run_holdout(lambda: good, spark, root, "p", floors, **few)
    assert {r.combo for r in held.collect()} == {7} and held.count() == 3 and {r.outcome for r in gates.collect()} == {"pass"}
    with pytest.raises(SG.StageLocked, match="read before"):
        SG.run_holdout(refuse, spark, root, "p", floors)
    SG.decide(spark, root, "q", "development", 7, 0.1, True)
    SG.decide(spark, root, "q", "validation", 7, None, False)
    with pytest.raises(SG.StageLocked, match="not passed"):
        SG.run_holdout(refuse, spark, root, "q", floors)
    SG.decide(spark, root, "r", "development", 7, 0.1, True)
    SG.decide(spark, root, "r", "validation", 8, None, True)
    with pytest.raises(SG.StageLocked, match="another"):
        SG.run_holdout(refuse, spark, root, "r", floors)


def summary(spark, change=lambda combo, scenario: {}):
    base = dict(horizon=3, inference_available=True, regime_floor_met=True, s_n=80, c_n=90, paired_sessions=30, s_unavailable_evidence=0, c_unavailable_evidence=0, lower=0.01, contrast=0.02, median_relative_net_25=0.01, first_half_contrast=0.01,
                second_half_contrast=0.01, positive_ratio=0.7, concentration=0.1)
    data = [{"combo": c, "scenario": s, **base, "lower": 0.02 if c == 5 else 0.01, **change(c, s)} for c in range(24) for s in PS.SCENARIOS]
    return spark.createDataFrame([tuple(d.values()) for d in data], ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double'}" for k, v in data[0].items()))


@pytest.mark.parametrize("change,development,replacement", [
    (lambda c, s: {}, ("locked", 5), ("locked", 5)),
    (lambda c, s: {"lower": 0.05} if (c, s) == (9, "all_upper") else {}, ("rejected_endpoint_instability", None), ("rejected_endpoint_instability", None)),
    (lambda c, s: {"c_unavailable_evidence": 1} if c == 2 else {}, ("blocked_unavailable_evidence", None), ("blocked_source_evidence", None)),
    (lambda c, s: {"regime_floor_met": False} if c == 2 else {}, ("inconclusive_evidence_floor", None), ("locked", 5)),
    (lambda c, s: {"s_n": 10} if s == "all_lower" else {}, ("locked", 5), ("rejected_no_common_eligible", None)),
    (lambda c, s: {"concentration": 0.3}, ("locked", 5), ("rejected_robustness_gates", None)),
    (lambda c, s: {"lower": 0.02 if c in (4, 5) else 0.01, "contrast": 0.03 if c == 4 else 0.02}, ("locked", 4), ("locked", 4)),
])
def test_selection_over_endpoint_scenarios(spark, change, development, replacement):
    table = summary(spark, change)
    d = ST.development_selection(table).first()
    assert (d.status, d.selected) == development
    g = ST.replacement_selection(table, (60, 20)).collect()
    assert len(g) == 6 and {(r.status, r.selected) for r in g} == {replacement}
