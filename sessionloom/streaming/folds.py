"""Sequential state per key: one pure step, shared by the batch fold and the streaming operator."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.params.regime import BANDS, BOOTSTRAP_SESSIONS, RULES, STRESS_NOW

RANK = {name: i for i, (name, _) in enumerate(BANDS)}
EMPTY = (None, False, None, 0)
STATE_SCHEMA = "confirmed string, provisional boolean, pending string, count int"
OUTPUT_SCHEMA = "universe_id long, session_ix int, score double, candidate string, confirmed string, provisional boolean, pending string, pending_count int, status string"


def band(score: float) -> str:
    """Band a score falls into on its own."""
    return next(name for name, floor in BANDS if floor is None or score >= floor)


def matching_rule(confirmed: str, score: float):
    """(target, sessions) of the transition the score asks for, or None."""
    if confirmed != "stress" and score <= STRESS_NOW:
        return "stress", 1
    for source, target, op, threshold, sessions in RULES:
        if source == confirmed and (score < threshold if op == "<" else score >= threshold):
            return target, sessions
    return None


def advance(state: tuple, score: float | None) -> tuple[tuple, str, str | None]:
    """One session: new (confirmed, provisional, pending, count), status, candidate band."""
    confirmed, provisional, pending, count = state
    if score is None:
        return state, "unavailable_stale" if confirmed else "unavailable_uninitialized", None
    candidate = band(score)
    if confirmed is None:
        if pending is None:
            return (None, False, candidate, 1), "initialization_pending", candidate
        if pending == candidate and count + 1 >= BOOTSTRAP_SESSIONS:
            return (candidate, False, None, 0), "initialized_confirmed", candidate
        worse = max(pending, candidate, key=RANK.__getitem__)
        return (worse, True, None, 0), "initialized_provisional", candidate
    if provisional and candidate == confirmed:
        return (confirmed, False, None, 0), "provisional_cleared", candidate
    rule = matching_rule(confirmed, score)
    if rule is None:
        status = "pending_reversed" if pending else "hysteresis_held" if candidate != confirmed else "held"
        return (confirmed, provisional, None, 0), status, candidate
    target, sessions = rule
    if target == "stress" and sessions == 1:
        return ("stress", False, None, 0), "immediate_stress_override", candidate
    count = count + 1 if pending == target else 1
    if count >= sessions:
        return (target, False, None, 0), "switched", candidate
    return (confirmed, provisional, target, count), "pending", candidate


def fold(rows, state: tuple = EMPTY) -> tuple[list[tuple], tuple]:
    """Run ``advance`` over (session_ix, score) in session order."""
    out = []
    for ix, score in rows:
        score = None if score is None or pd.isna(score) else float(score)
        state, status, candidate = advance(state, score)
        out.append((int(ix), score, candidate, *state, status))
    return out, state


COLUMNS = ["session_ix", "score", "candidate", "confirmed", "provisional", "pending", "pending_count", "status"]


def with_every_session(scores: DataFrame, first: int, last: int) -> DataFrame:
    """A missing session is an explicit null, which pauses the confirmation counter."""
    keys = scores.select("universe_id").distinct().withColumn("session_ix", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return keys.join(scores, ["universe_id", "session_ix"], "left")


def state_history(scores: DataFrame, first: int, last: int) -> DataFrame:
    """STR-02 / JOB-08 in batch.  A key holds one row per session, so its group is bounded by the calendar."""
    def per_key(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session_ix")
        rows, _ = fold(zip(pdf.session_ix, pdf.score))
        out = pd.DataFrame(rows, columns=COLUMNS)
        out.insert(0, "universe_id", pdf.universe_id.iloc[0])
        return out

    return with_every_session(scores, first, last).groupBy("universe_id").applyInPandas(per_key, OUTPUT_SCHEMA)
