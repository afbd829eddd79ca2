"""Lane decisions against the rules applied one after the other; intervals, gaps and coverage against day-by-day walks."""

import random

import pytest
from pyspark.sql import functions as F

from sessionloom.plans import reconstruction as P

FINAL = 30


@pytest.fixture(scope="module")
def days():
    rnd = random.Random(8)
    out = []
    for k in range(12):
        trading, warning, factor = "trading", "none", 1
        for ix in range(1 + k % 3, FINAL + 1 - (k % 4) * 3):
            if rnd.random() < 0.25:
                trading = rnd.choice(["trading", "suspended", "unknown", "not_listed", "resumed"])
            if rnd.random() < 0.15:
                warning = rnd.choice(["none", "special", "unknown"])
            factor += rnd.random() < 0.08
            if rnd.random() > 0.2:
                out.append((k, ix, trading, warning, "unknown" if k == 5 else "main", factor))
    return out


def frame(spark, days):
    return P.with_changes(spark.createDataFrame(days, "instrument_id long, session_ix int, trading_status string, warning_status string, board string, factor int"))


def test_lane(spark, days):
    want, previous = {}, {}
    last = {k: max(d[1] for d in days if d[0] == k) for k in {d[0] for d in days}}
    for k, ix, trading, warning, board, factor in days:
        found = "candidate_included"
        if ix >= FINAL:
            found = "quarantined"
        if trading == "not_listed":
            found = "candidate_excluded"
        elif trading == "unknown":
            found = "quarantined"
        if warning == "unknown":
            found = "quarantined"
        elif warning != "none":
            found = "candidate_excluded"
        if board == "unknown" or (k in previous and previous[k] != factor) or (ix == last[k] and ix < FINAL):
            found = "quarantined"
        previous[k] = factor
        want[k, ix] = (found, ix + 1 if ix < FINAL else None)
    rows = P.lane(frame(spark, days), FINAL).collect()
    assert {(r.instrument_id, r.session_ix): (r.disposition, r.knowledge_ix) for r in rows} == want
    assert {x for r in rows for x in r.reasons} == {
        "factor_change_candidate_window", "next_session_knowledge_clock_unavailable", "next_session_reconstructed_knowledge_clock", "not_as_operated", "not_listed_state_exclusion_candidate", "price_limit_regime_unknown", "risk_warning_exclusion_candidate",
        "risk_warning_status_unknown", "source_available_at_unobserved", "suspension_observed_reconstructed", "terminal_boundary_not_adjudicated", "trading_status_unknown"}


def test_intervals_gaps_and_coverage(spark, days):
    decided = P.lane(frame(spark, days), FINAL).cache()
    state = {(r.instrument_id, r.session_ix): (r.trading_status, r.warning_status, r.disposition) for r in decided.collect()}
    runs = P.islands(decided).cache()
    walked = {}
    for r in runs.collect():
        for ix in range(r.first_ix, r.last_ix + 1):
            assert (r.instrument_id, ix) not in walked
            walked[r.instrument_id, ix] = (r.trading_status, r.warning_status, r.disposition)
        before, after = state.get((r.instrument_id, r.first_ix - 1)), state.get((r.instrument_id, r.last_ix + 1))
        first, last = min(i for k, i in state if k == r.instrument_id), max(i for k, i in state if k == r.instrument_id)
        assert r.starts == ("begins" if r.first_ix == first else "after_gap" if before is None else "state_change") and before != (r.trading_status, r.warning_status, r.disposition)
        assert r.stops == ("ends" if r.last_ix == last else "before_gap" if after is None else "state_change") and after != (r.trading_status, r.warning_status, r.disposition)
    assert walked == state
    missing = {(r.instrument_id, ix) for r in P.gaps(runs).collect() for ix in range(r.first_missing, r.last_missing + 1)}
    for r in P.coverage(runs).collect():
        seen = sorted(i for k, i in state if k == r.instrument_id)
        inside = set(range(seen[0], seen[-1] + 1)) - set(seen)
        assert {i for k, i in missing if k == r.instrument_id} == inside and r.observed == len(seen) and abs(r.coverage - len(seen) / (seen[-1] - seen[0] + 1)) < 1e-12
        assert r.quarantined == sum(state[r.instrument_id, i][2] == "quarantined" for i in seen)
    assert P.islands(decided.limit(0)).count() == 0


def test_evidence_budget(spark, days):
    targets = spark.createDataFrame([(k, k == 99, 1 if k % 2 else 5) for k in [*range(12), 50, 99]], "instrument_id long, isolated boolean, listed_ix int")
    got = {r.instrument_id: r for r in P.evidence_budget(targets, frame(spark, days), 3, FINAL).collect()}
    assert got[50].families == ["lifecycle", "listing_stage"] and got[50].n_states == 0 and got[50].maximum_requests == 5
    assert got[99].families == ["lifecycle", "listing_stage"]
    for k in range(12):
        mine = [d for d in days if d[0] == k]
        families = set()
        if any(d[3] != "none" for d in mine):
            families.add("risk_warning")
        if max(d[1] for d in mine) < FINAL or any(d[2] == "unknown" for d in mine):
            families.add("lifecycle")
        if k % 2 == 0:
            families.add("listing_stage")
        if any(a[5] != b[5] for a, b in zip(mine, mine[1:])):
            families.add("corporate_action")
        assert set(got[k].families if k in got else []) == families
        assert k not in got or got[k].maximum_requests == sum(P.REQUESTS[f] for f in families)
