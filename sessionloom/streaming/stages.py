"""Candidate stages per instrument: gates are column expressions, only the counter is a fold (STR-03 / STR-04)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: rule -> (target stage, confirming sessions), score thresholds
RULES = {
    "not_listed_to_watch": ("watch", 1),
    "watch_to_prepare": ("prepare", 2),
    "prepare_to_enter": ("enter", 2),
    "prepare_to_enter_breakout": ("enter", 1),
    "enter_to_prepare": ("prepare", 2),
    "prepare_to_watch": ("watch", 2),
    "active_to_invalidated": ("invalidated", 1),
    "invalidated_to_watch": ("watch", 3),
}
LIMITS = dict(watch=50, watch_confidence=0.40, prepare=65, prepare_rs=55, prepare_trend=55, enter=75, breakout=70, enter_back=68, enter_back_trend=50, prepare_back=58,
              prepare_back_alignment=40, invalidation=45, reentry=55)
HOLD_SESSIONS = 1
SUPPORT_CAP = 3
STATE_WEIGHT = 0.15
STAGES = ("none", "watch", "prepare", "enter", "invalidated")
START = (None, None, 0, 0, 0)  # stage, pending rule, pending count, missing sessions, sessions in stage
FIELDS = ["session_ix", "stage", "pending_rule", "pending_count", "status", "stage_count", "confidence"]
SCHEMA = "instrument_id long, session_ix int, stage string, pending_rule string, pending_count int, status string, stage_count int, confidence double"
TYPES = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64()]


def known() -> Column:
    """All facts are there that a stage needs."""
    return F.col("score").isNotNull() & F.col("median_dv").isNotNull()


def wanted_rules(price_floor: float, liquidity_floor: float) -> list[Column]:
    """For each stage the instrument might be in, the rule its facts ask for (null when none)."""
    c, t = F.col, LIMITS
    floors = (c("price") >= price_floor) & (c("median_dv") >= liquidity_floor)
    clear, calm = ~c("anomaly"), c("regime").isNotNull() & (c("regime") != "stress")
    broken = (c("score") < t["invalidation"]) | ~floors | c("anomaly")

    def active(*pairs):
        out = F.when(broken, "active_to_invalidated")
        for cond, rule in pairs:
            out = out.when(cond, rule)
        return out

    return [
        F.when((c("score") >= t["watch"]) & (c("confidence") >= t["watch_confidence"]) & floors & clear, "not_listed_to_watch").alias("from_none"),
        active(((c("score") >= t["prepare"]) & calm & (c("rs") >= t["prepare_rs"]) & (c("trend") >= t["prepare_trend"]) & clear, "watch_to_prepare")).alias("from_watch"),
        active((c("breakout") & (c("score") >= t["breakout"]) & calm & clear, "prepare_to_enter_breakout"), ((c("score") >= t["enter"]) & floors & clear, "prepare_to_enter"),
               ((c("score") < t["prepare_back"]) | (c("alignment") < t["prepare_back_alignment"]), "prepare_to_watch")).alias("from_prepare"),
        active(((c("score") < t["enter_back"]) | (c("trend") < t["enter_back_trend"]), "enter_to_prepare")).alias("from_enter"),
        F.when((c("score") >= t["reentry"]) & floors & clear, "invalidated_to_watch").alias("from_invalidated"),
    ]


def step(state: tuple, rules: dict | None) -> tuple[tuple, str]:
    """One session.  ``rules`` maps a stage to the rule asked for, None when a required fact is missing."""
    stage, pending, count, missing, held = state
    if rules is None:
        if missing + 1 <= HOLD_SESSIONS:
            return (stage, pending, count, missing + 1, held), "unavailable_stale"
        return (None, None, 0, missing + 1, 0), "unavailable_null"
    rule = rules[stage or "none"]
    if rule is None:
        status = "pending_reversed" if pending else "not_listed" if stage is None else "held"
        return (stage, None, 0, 0, min(held + 1, SUPPORT_CAP) if stage else 0), status
    target, sessions = RULES[rule]
    count = count + 1 if pending == rule else 1
    if count < sessions:
        return (stage, rule, count, 0, min(held + 1, SUPPORT_CAP) if stage else 0), "pending"
    status = "listed" if rule == "not_listed_to_watch" else "invalidated" if target == "invalidated" else "switched"
    return (target, None, 0, 0, 1), status


def session(state: tuple, rules: dict | None, confidence: float | None) -> tuple[tuple, tuple]:
    """One session of one instrument: new state, and stage, pending rule and count, status, sessions in stage, confidence with the support of t - 1."""
    support = STATE_WEIGHT * min(state[4] / SUPPORT_CAP, 1.0)
    state, status = step(state, rules)
    return state, (state[0], state[1], state[2], status, state[4], None if rules is None else confidence + support)


def stage_history(facts: DataFrame, first: int, last: int, price_floor: float, liquidity_floor: float) -> DataFrame:
    """Every session of every instrument, a missing one held once and then dropped.

    Confidence adds the support of the stage held at t - 1, so it is finished inside the fold.
    """
    asked = facts.where(known()).select("instrument_id", "session_ix", "confidence", *wanted_rules(price_floor, liquidity_floor))
    keys = facts.select("instrument_id").distinct().withColumn("session_ix", F.explode(F.sequence(F.lit(first), F.lit(last))))
    grid = keys.join(asked.withColumn("known", F.lit(True)), ["instrument_id", "session_ix"], "left")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # instruments follow each other, each in the order of its sessions; the state goes on into the next batch
        state, current = START, ()
        for batch in batches:
            ids, ixs, confidences, seen, *asked_for = (batch.column(c).to_pylist() for c in ("instrument_id", "session_ix", "confidence", "known", *[f"from_{s}" for s in STAGES]))
            out = []
            for instrument, ix, confidence, there, *wanted in zip(ids, ixs, confidences, seen, *asked_for):
                if (instrument,) != current:
                    state, current = START, (instrument,)
                state, record = session(state, dict(zip(STAGES, wanted)) if there else None, math.nan if confidence is None else confidence)
                out.append((ix, *record))
            columns = [ids, *(zip(*out) if out else [()] * len(FIELDS))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t, from_pandas=True) for c, t in zip(columns, TYPES)], ["instrument_id", *FIELDS])

    return grid.repartition("instrument_id").sortWithinPartitions("instrument_id", "session_ix").mapInArrow(walk, SCHEMA)
