"""The candidate stages as a stream (STR-03 / STR-04 / STR-05): facts of instruments and states of the market meet in state.

Instruments are dealt to buckets; a bucket's state holds the stage of its instruments, facts whose session isn't closed yet
and market states that were not used yet. A session is closed by its market state, or by that of a later session when it never got one; it is
then advanced once for each known instrument, with or without facts. Facts of a closed session are given back as late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.staging import shared_folder
from sessionloom.streaming.stages import START, STAGES, known, session, wanted_rules
from sessionloom.streaming.state import rocksdb

RULES = [f"{mood}_{s}" for mood in ("calm", "tense") for s in STAGES]
INPUT = "bucket int, instrument_id long, session_ix int, regime string, known boolean, confidence double, " + ", ".join(f"{r} string" for r in RULES)
OUTPUT = "instrument_id long, session_ix int, stage string, pending_rule string, pending_count int, status string, stage_count int, confidence double, late boolean"
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]


def asked(facts: DataFrame, buckets: int, price_floor: float, liquidity_floor: float) -> DataFrame:
    """Facts as the stream reads them: the rule that each stage would ask for in a calm and in a tense market."""
    rows = facts.withColumn("known", known())
    for mood, regime in (("calm", "balanced"), ("tense", "stress")):
        rules = [r.alias(f"{mood}_{s}") for r, s in zip(wanted_rules(price_floor, liquidity_floor), STAGES)]
        rows = rows.withColumn("regime", F.lit(regime)).select("*", *rules).drop("regime")
    bucket = F.pmod(F.xxhash64("instrument_id"), F.lit(buckets)).cast("int").alias("bucket")
    return rows.select(bucket, "instrument_id", "session_ix", F.lit(None).cast("string").alias("regime"), "known", F.col("confidence").cast("double").alias("confidence"), *RULES)


def announced(states: DataFrame, buckets: int) -> DataFrame:
    """Market states as the stream reads them: one copy for each bucket."""
    none = [F.lit(None).cast("string").alias(r) for r in RULES]
    return states.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(None).cast("bigint").alias("instrument_id"), "session_ix", "regime", F.lit(None).cast("boolean").alias("known"),
                         F.lit(None).cast("double").alias("confidence"), *none)


def advance(stages: dict, waiting: dict, regimes: dict, last: int | None):
    """Close all sessions up to the latest market state; returns the rows and the last closed session.

    ``stages`` has (state, first session) by instrument, ``waiting`` facts by session and instrument, ``regimes`` the states by session.
    """
    out = []
    if not regimes:
        return out, last
    end = max(regimes)
    for ix in range(min([*waiting, *regimes]) if last is None else last + 1, end + 1):
        regime = regimes.pop(ix, None)
        mood = "calm" if regime is not None and regime != "stress" else "tense"
        facts = waiting.pop(ix, {})
        for instrument in sorted({*stages, *facts}):
            row = facts.get(instrument)
            rules = {s: row[f"{mood}_{s}"] for s in STAGES} if row and row["known"] else None
            stages[instrument], record = session(stages.get(instrument, START), rules, row and row["confidence"])
            out.append((instrument, ix, *record, False))
    return out, end


def _processor():
    """Keyed processor around ``advance``."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Stages(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            rules = ", ".join(f"{r} string" for r in RULES)
            self.stages = handle.getMapState("stages", "instrument_id long", "stage string, pending string, count int, missing int, held int")
            self.waiting = handle.getMapState("waiting", "session_ix int, instrument_id long", f"known boolean, confidence double, {rules}")
            self.closed = handle.getValueState("closed", "session_ix int")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            last = self.closed.get()[0] if self.closed.exists() else None
            fields = ["known", "confidence", *RULES]
            waiting: dict = {}
            stored = set()
            for (ix, instrument), values in self.waiting.iterator():
                stored.add((ix, instrument))
                waiting.setdefault(ix, {})[instrument] = dict(zip(fields, values))
            out, regimes = [], {}
            for frame in rows:
                frame = frame.astype(object).where(frame.notna(), None)
                for row in frame.to_dict("records"):
                    ix = int(row["session_ix"])
                    if row["instrument_id"] is None:
                        if last is None or ix > last:
                            regimes[ix] = row["regime"]
                    elif last is not None and ix <= last:
                        out.append((int(row["instrument_id"]), ix, None, None, None, "late", None, None, True))
                    else:
                        waiting.setdefault(ix, {})[int(row["instrument_id"])] = {f: row[f] for f in fields}
            before = {k[0]: tuple(v) for k, v in self.stages.iterator()}
            stages = dict(before)
            closed, now = advance(stages, waiting, regimes, last)
            for instrument, state in stages.items():
                if before.get(instrument) != state:
                    self.stages.updateValue((instrument,), state)
            left = {(ix, i): values for ix, group in waiting.items() for i, values in group.items()}
            for k in stored - set(left):
                self.waiting.removeKey(k)
            for k in set(left) - stored:
                self.waiting.updateValue(k, tuple(left[k][f] for f in fields))
            if now is not None:
                self.closed.update((now,))
            if out or closed:
                yield pd.DataFrame([*out, *closed], columns=NAMES).astype({"instrument_id": "int64", "session_ix": "int32", "pending_count": "Int32", "stage_count": "Int32"})

        def close(self) -> None:
            pass

    return Stages()


def stage_stream(rows: DataFrame) -> DataFrame:
    """Stage rows of a stream of ``asked`` facts and ``announced`` states; late facts come back with ``late`` set."""
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=_processor(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def appended(facts: DataFrame, states: DataFrame, first: int, last: int, price_floor: float, liquidity_floor: float, parts: int = 3, buckets: int = 8) -> DataFrame:
    """Feed facts and states in ``parts`` appends, each run ending before the next begins: the first facts come before their
    states, one part's states come late with the next, and the last part repeats facts of the third session."""
    spark, folder = facts.sparkSession, shared_folder(facts.sparkSession, "stages")
    a, b = asked(facts, buckets, price_floor, liquidity_floor), announced(states, buckets)
    step = -(-(last - first + 1) // parts)
    with rocksdb(spark):
        for k in range(parts):
            lo, hi = first + k * step, first + (k + 1) * step - 1
            old = a.where(F.col("session_ix") == first + 2) if k == parts - 1 else a.limit(0)
            # states of the last two sessions of a part are known only with the next part
            known_states = b.where(F.col("session_ix").between(lo - 2, hi - 2 if k < parts - 1 else last))
            batch = a.where(F.col("session_ix").between(lo, hi)).unionByName(known_states).unionByName(old)
            batch.coalesce(1).write.mode("append").parquet(f"{folder}/source")
            stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/source")
            query = stage_stream(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{folder}/out")
