"""Structured Streaming jobs: session appends, state per key, freshness, maturity (STR-*)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.sources.sinks import publish_sessions
from sessionloom.streaming.folds import COLUMNS, EMPTY, OUTPUT_SCHEMA, STATE_SCHEMA, fold

BAR_SCHEMA = "instrument_id long, close double, volume double, session_ix int"
SCORE_SCHEMA = "universe_id long, session_ix int, score double"


def append_sessions(spark: SparkSession, source: str, root: str, checkpoint: str):
    """STR-01: micro-batches of bars into the session store; a replayed batch changes nothing."""
    stream = spark.readStream.schema(BAR_SCHEMA).parquet(source)

    def write(batch: DataFrame, _epoch: int) -> None:
        publish_sessions(batch, root, BAR_SCHEMA, ["close", "volume"])

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _processor():
    """Keyed processor around the shared fold; built lazily so workers import only what they run."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class RegimeState(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("regime", f"{STATE_SCHEMA}, last int")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows)).sort_values("session_ix").reset_index(drop=True)
            *current, last = tuple(self.state.get()) if self.state.exists() else (*EMPTY, None)
            fresh = batch if last is None else batch[batch.session_ix > last]
            late = batch[~batch.index.isin(fresh.index)]
            scores = dict(zip(fresh.session_ix.astype(int), fresh.score))
            # a session without a row is a missing score, which pauses the counter as in the batch form
            start = min(scores, default=0) if last is None else last + 1
            out, current = fold(((ix, scores.get(ix)) for ix in range(start, max(scores, default=start - 1) + 1)), tuple(current))
            if scores:
                self.state.update((*current, max(scores)))
            # a session that was passed isn't opened again; its score is given back
            out += [(int(ix), float(score), None, None, None, None, None, "late") for ix, score in zip(late.session_ix, late.score)]
            frame = pd.DataFrame(out, columns=COLUMNS).astype({"pending_count": "Int32", "provisional": "boolean"})
            frame.insert(0, "universe_id", key[0])
            yield frame

        def close(self) -> None:
            pass

    return RegimeState()


def regime_stream(scores: DataFrame) -> DataFrame:
    """STR-02 as a stream: one value state per universe, advanced by the sessions of each batch.

    Sessions of a key must arrive in order, one or more per batch; a session that is skipped counts as a null score as soon as a
    later one arrives. A score of a session that was passed comes back with status ``late`` and changes nothing.
    """
    return scores.groupBy("universe_id").transformWithStateInPandas(
        statefulProcessor=_processor(), outputStructType=OUTPUT_SCHEMA, outputMode="Append", timeMode="None")


def knowledge_cutoff(df: DataFrame, cutoff) -> DataFrame:
    """STR-08: nothing that became available after the cutoff may be used."""
    return df.where(F.col("available_at") <= cutoff)


def outcomes(signals: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """STR-09: an outcome is pending until the bar ``horizon`` sessions ahead exists."""
    ahead = bars.select("instrument_id", (F.col("session_ix") - horizon).alias("session_ix"), F.col("close").alias("exit"))
    j = signals.join(ahead, ["instrument_id", "session_ix"], "left")
    return j.select("*", (F.col("exit") / F.col("close") - 1).alias("outcome"), F.when(F.col("exit").isNull(), "pending").otherwise("mature").alias("maturity"))


def late_rows(rows: DataFrame, committed: DataFrame, key: list[str], economic: list[str]) -> DataFrame:
    """STR-07: a reacquired row is accepted when its values equal the committed ones, else quarantined."""
    a = rows.select(*key, F.struct(*economic).alias("_new"))
    b = committed.select(*key, F.struct(*economic).alias("_old"))
    return a.join(b, key, "left").select(
        *key, F.when(F.col("_old").isNull(), "new").when(F.col("_old").eqNullSafe(F.col("_new")), "accepted_equal").otherwise("quarantined_changed").alias("verdict"))


def freshness(bars: DataFrame, expected_ix: int, stale_after: int = 2) -> DataFrame:
    """STR-10: lag of the latest stored session behind the latest completed one."""
    last = bars.agg(F.max("session_ix").alias("last_ix"))
    lag = F.lit(expected_ix) - F.col("last_ix")
    return last.select("last_ix", lag.alias("lag_sessions"), F.when(lag == 0, "fresh").when(lag <= stale_after, "stale").otherwise("unavailable").alias("status"))


def event_windows(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Tumbling event-time counts, the same plan on a stream (with a watermark) and on a table."""
    if events.isStreaming:
        events = events.withWatermark("ts", "1 hour")
    g = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n")
