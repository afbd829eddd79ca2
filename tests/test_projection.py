"""Filings on securities: segments against a walk over sessions, issuers with several securities, late and missing clocks."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sessionloom.plans import projection as P

LAST, DAY = 40, dt.date(2020, 1, 6)
LINK = "cik long, instrument_id long, first_ix int, last_ix int, common boolean, tier int, observed_ix int"


def fixture():
    rnd = random.Random(11)
    links, points = [], []
    for cik in range(30):
        for k in range(rnd.randint(0, 3)):
            a = rnd.randint(1, 35)
            links.append((cik, 10 * cik + k, a, min(LAST, a + rnd.randint(0, 15)), rnd.random() < 0.8, rnd.choice([None, 0, 0, 1]), a + rnd.choice([-1, 3])))
        for ix in sorted(rnd.sample(range(1, LAST + 1), 3)):
            points.append((cik, "x", ix, rnd.choice(["selected", "selected", "quarantined_conflict"]), DAY + dt.timedelta(days=7 * ix - rnd.randint(10, 900))))
    return links, points


def active(links, cik, s):
    return [x for x in links if x[0] == cik and x[2] <= s <= x[3]]


def test_projection_equals_a_walk(spark):
    links, points = fixture()
    want, who = {}, {}
    for cik in range(30):
        for s in range(1, LAST):
            common = [x for x in active(links, cik, s) if x[4]]
            if len(common) != 1 or common[0][5] is None:
                continue
            known = [p for p in points if p[0] == cik and p[2] <= s + 1]
            status, age = "unavailable", "none"
            if known:
                status = known[-1][3]
                if status == "selected":
                    days = (DAY + dt.timedelta(days=7 * s) - known[-1][4]).days
                    age = next((n for t, n in zip(P.AGES, P.bucket_names()) if days <= t), P.bucket_names()[-1])
            key = ("x", P.TIERS[common[0][5]], status, age)
            want[key] = want.get(key, 0) + 1
            who.setdefault(key, set()).add(common[0][1])
    sweep = P.link_sweep(spark.createDataFrame(links, LINK))
    rows = spark.createDataFrame(points, "cik long, concept string, session_ix int, status string, period_end date")
    segments = P.projected(rows, sweep, rows.select("cik", "concept").distinct(), LAST, F.lit(DAY))
    got = {(r.concept, r.tier, r.status, r.age): (r.n_sessions, r.n_instruments) for r in P.by_age(segments).collect()}
    assert got == {k: (n, len(who[k])) for k, n in want.items()} and len({k[2] for k in got}) == 3


def test_every_blocker(spark):
    links = [(1, 7, 1, 9, True, 0, 0), (2, 8, 1, 9, False, 0, 0), (3, 9, 1, 9, True, 0, 0), (3, 10, 4, 6, True, 0, 0), (4, 11, 1, 9, True, 1, 0), (5, 12, 1, 9, True, None, 0), (6, 13, 1, 9, True, 0, 5), (3, 14, 1, 9, False, 0, 0)]
    ends = [(1, 1, 5), (1, 2, None), (1, 3, 41), (1, 4, 10), (2, 1, 5), (3, 1, 5), (3, 2, 7), (4, 1, 5), (5, 1, 5), (6, 1, 5), (6, 2, 6), (99, 1, 5)]
    rows = P.applicability(spark.createDataFrame(ends, "cik long, endpoint int, session_ix int"), P.link_sweep(spark.createDataFrame(links, LINK)), LAST).collect()
    got = {(r.cik, r.endpoint): (r.blocker, r.instrument_id, r.n_linked) for r in rows}
    ok, held = "security_form_not_effective_dated", "identity_evidence_outcome_reconciliation_only"
    assert got == {
        (1, 1): (ok, 7, 1), (1, 2): ("financial_lineage_signal_session_missing", None, 0), (1, 3): ("identity_link_session_unavailable", None, 0), (1, 4): ("stable_security_cik_link_missing_or_quarantined", None, 0),
        (2, 1): ("no_common_security_at_signal_session", None, 1), (3, 1): ("multiple_common_securities_for_cik", None, 3), (3, 2): (ok, 9, 2), (4, 1): (held, 11, 1), (5, 1): (held, 12, 1),
        (6, 1): ("identity_evidence_not_known_by_signal_open", 13, 1), (6, 2): (ok, 13, 1), (99, 1): ("stable_security_cik_link_missing_or_quarantined", None, 0)}
