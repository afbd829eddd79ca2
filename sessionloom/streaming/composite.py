"""The composite as a stream (STR-06): each instrument keeps its last 26 sessions in state, each batch computes its own sessions.

Two queries. ``accept_sessions`` lets sessions in that follow the last one and puts rows of earlier sessions into a quarantine
folder. ``run_composite`` is keyed by instrument: a batch meets the bars that state holds, so the batch form's own
window expressions give the features of its new sessions. Their cross-sections are distributed aggregates; what a session
leaves behind for later ones is one row, published in a family table, as are the scores. A batch that is repeated after a failure publishes the
same rows, which changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.staging import cut
from sessionloom.params.regime import DIMENSIONS
from sessionloom.plans import market as M
from sessionloom.sources import families as FT

#: Sessions that a frame may reach back to, and the first session of a panel that has a composite.
LOOKBACK, FIRST = 26, 21
BARS = "kind string, instrument_id string, session_ix int, open double, high double, low double, close double, volume double"
HELD = "session_ix int, open double, high double, low double, close double, volume double"
NAMES = [c.split()[0] for c in BARS.split(", ")]
SUMS = FT.Family(
    "session-sums",
    "panel string, session_ix int, n_bars long, n1 long, n5 long, n20 long, nv long, adv double, pos5 double, above double, balance double, n_tail long, dv_all double, dv1 double, dv_up double, n_own long, own double, mad1 double, "
    "mad5 double, med_rv double, concentration double",
    ("panel", "session_ix"), ("session_ix",), ("adv", "pos5", "above", "balance", "dv_all", "dv1", "dv_up", "own", "mad1", "mad5", "med_rv", "concentration"))
SCORES = FT.Family(
    "composite-scores", "panel string, session_ix int, weight_available int, " + ", ".join(f"{d}_score double" for d in DIMENSIONS) + ", regime_score double",
    ("panel", "session_ix"), ("session_ix",), (*[f"{d}_score" for d in DIMENSIONS], "regime_score"))


@dataclass(frozen=True)
class Panel:
    """What the composite of one universe is computed with."""

    name: str
    n_members: int
    min_obs: int
    min_positive: int
    broad_required: int
    broad_minimum: int


def accept_sessions(spark: SparkSession, source: str, accepted: str, late: str, checkpoint: str, files: int = 1):
    """Bars of sessions after the last accepted one go to ``accepted``, all others to ``late``; both are partitioned by batch.

    A session arrives whole in one batch. A repeated batch overwrites its own folders only.
    """
    stream = spark.readStream.schema(BARS).option("maxFilesPerTrigger", files).parquet(source)

    def write(batch: DataFrame, epoch: int) -> None:
        fs, path = FT._fs(spark, accepted)
        known = spark.read.schema(f"{BARS}, epoch long").parquet(accepted).where(F.col("epoch") < epoch).agg(F.max("session_ix")).first()[0] if fs.exists(path) else None
        fresh = F.lit(True) if known is None else F.col("session_ix") > known
        batch.where(fresh).write.mode("overwrite").parquet(f"{accepted}/epoch={epoch}")
        batch.where(~fresh).write.mode("overwrite").parquet(f"{late}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _lookback():
    """Keyed processor: gives back the bars it holds and the new ones, and keeps the last ``LOOKBACK`` sessions."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Lookback(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.bars = handle.getListState("bars", HELD)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            columns = [c.split()[0] for c in HELD.split(", ")]
            held = pd.DataFrame([tuple(x) for x in self.bars.get()], columns=columns)
            new = pd.concat(list(rows))[columns].sort_values("session_ix").drop_duplicates("session_ix")
            if len(held):  # a bar that was read twice is held already
                new = new[new.session_ix > held.session_ix.max()]
            both = pd.concat([held, new], ignore_index=True) if len(held) else new.reset_index(drop=True)
            if not len(new):
                return
            self.bars.put([(int(r[0]), *map(float, r[1:])) for r in both[both.session_ix > both.session_ix.max() - LOOKBACK].itertuples(index=False)])
            out = both.assign(kind=key[0], instrument_id=key[1], fresh=[False] * len(held) + [True] * len(new))
            out["session_ix"] = out.session_ix.astype("int32")
            yield out[[*NAMES, "fresh"]]

        def close(self) -> None:
            pass

    return Lookback()


def score_sessions(bars: DataFrame, root: str, panel: Panel) -> None:
    """Publish sums and scores of the fresh sessions in ``bars``, which also hold what the frames reach back to."""
    spark = bars.sparkSession
    fresh = bars.where("fresh").select("session_ix").distinct()
    first, last = fresh.agg(F.min("session_ix"), F.max("session_ix")).first()
    if first is None:
        return
    of = lambda kind: bars.where(F.col("kind") == kind).drop("kind")
    mine = M.member_features(of("member")).where("fresh")
    sums = cut(M.cross_sections(mine, panel.min_positive).withColumn("panel", F.lit(panel.name)))
    FT.publish(sums, root, SUMS)
    history = FT.read(spark, root, SUMS).where((F.col("panel") == panel.name) & F.col("session_ix").between(first - LOOKBACK, last)).drop("panel")
    own = M.metrics_of_sessions(history, panel.n_members, panel.min_obs)
    broad = M.benchmark_metrics(of("broad"), of("market"), panel.broad_required, panel.broad_minimum)
    scored = M.composite(own.join(broad, "session_ix", "left")).join(fresh, "session_ix", "left_semi")
    start = FT.read(spark, root, SUMS).where(F.col("panel") == panel.name).agg(F.min("session_ix")).first()[0]
    ready = scored.where(F.col("session_ix") >= start + FIRST - 1).withColumn("panel", F.lit(panel.name))
    FT.publish(cut(SCORES.typed(ready)), root, SCORES)


def run_composite(spark: SparkSession, accepted: str, root: str, panel: Panel, checkpoint: str, files: int = 1000):
    """Scores of all accepted sessions that have not been scored; state and progress live in ``checkpoint``."""
    stream = spark.readStream.schema(f"{BARS}, epoch long").option("maxFilesPerTrigger", files).parquet(accepted)
    held = stream.drop("epoch").groupBy("kind", "instrument_id").transformWithStateInPandas(
        statefulProcessor=_lookback(), outputStructType=f"{BARS}, fresh boolean", outputMode="Append", timeMode="None")

    def write(batch: DataFrame, _epoch: int) -> None:
        score_sessions(cut(batch), root, panel)  # state is read once a batch

    return held.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
