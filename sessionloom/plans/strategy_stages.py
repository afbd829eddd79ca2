"""Development, validation and holdout with locks that are rows of a store (JOB-58).

A stage reads only what the decision of the stage before it names. Decisions are published once: another decision for the same stage is a
conflict. Before the holdout is read its reading is published, so a second reader is refused, whoever it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.staging import cut
from sessionloom.plans import strategy_statistics as ST
from sessionloom.sources import families as FT

DECISIONS = FT.Family("strategy-decisions", "protocol string, stage string, combo int, objective double, passed boolean", ("protocol", "stage"), ("combo",), ("objective",))
READS = FT.Family("strategy-holdout-reads", "protocol string, run string, combo int", ("protocol",), ("run",))


class StageLocked(ValueError):
    """A stage that the published decisions don't open."""


def decide(spark: SparkSession, root: str, protocol: str, stage: str, combo: int, objective: float | None, passed: bool) -> None:
    row = spark.createDataFrame([(protocol, stage, combo, objective, passed)], DECISIONS.schema)
    if FT.publish(row, root, DECISIONS).where("action in ('write', 'no_op')").isEmpty():
        raise StageLocked(f"{protocol}: {stage} was decided differently before")


def opened(spark: SparkSession, root: str, protocol: str, earlier: str) -> int:
    """The combination that the decision of the ``earlier`` stage names."""
    row = FT.read(spark, root, DECISIONS).where((F.col("protocol") == protocol) & (F.col("stage") == earlier)).first()
    if row is None or not row.passed:
        raise StageLocked(f"{protocol}: {earlier} has not passed")
    return row.combo


def run_development(rows: DataFrame, root: str, protocol: str, floors, **more) -> DataFrame:
    """Summaries of all combinations; publishes the one that is locked, if any has inference."""
    table = cut(ST.summaries(rows, floors, "development", only_exact=True, **more))
    lock = ST.development_lock(table).first()  # one row at most
    if lock is not None:
        decide(rows.sparkSession, root, protocol, "development", lock.combo, lock.objective, True)
    return table


def run_validation(rows: Callable[[], DataFrame], spark: SparkSession, root: str, protocol: str, floors, **more) -> tuple[DataFrame, DataFrame]:
    """Summaries with adjusted p values and the gates of the locked combination; publishes whether all passed."""
    combo = opened(spark, root, protocol, "development")
    table = cut(ST.with_holm(ST.summaries(rows(), floors, "validation", only_exact=True, **more)))
    gates = cut(ST.validation_gates(table, combo, floors[2]))
    decide(spark, root, protocol, "validation", combo, None, gates.where("outcome <> 'pass'").isEmpty())
    return table, gates


def run_holdout(rows: Callable[[], DataFrame], spark: SparkSession, root: str, protocol: str, floors, **more) -> tuple[DataFrame, DataFrame]:
    """Summaries and gates of the locked combination alone; its reading is published before a row is read."""
    combo = opened(spark, root, protocol, "validation")
    if combo != opened(spark, root, protocol, "development"):
        raise StageLocked(f"{protocol}: validation names another combination")
    read = FT.publish(spark.createDataFrame([(protocol, uuid.uuid4().hex, combo)], READS.schema), root, READS)
    if read.where("action = 'write'").isEmpty():
        raise StageLocked(f"{protocol}: the holdout was read before")
    table = cut(ST.summaries(rows().where(F.col("combo") == combo), floors, "holdout", only_exact=True, **more))
    return table, cut(ST.holdout_gates(table, floors[2]))
