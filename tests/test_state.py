"""State machine boundaries, prefix stability, stream equals batch, idempotent sinks, greedy selection."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from sessionloom.operators.topk import capped_selection, with_rejections
from sessionloom.sources import sinks
from sessionloom.streaming import folds, streams


@pytest.mark.parametrize("score,name", [(70.0, "risk_on"), (69.9999, "balanced"), (50.0, "balanced"), (49.9999, "defensive"), (30.0, "defensive"), (29.9999, "stress")])
def test_bands(score, name):
    assert folds.band(score) == name


def run(scores, state=folds.EMPTY):
    return folds.fold(enumerate(scores, 1), state)


def test_bootstrap_and_stress():
    rows, _ = run([72, 71])
    assert [r[-1] for r in rows] == ["initialization_pending", "initialized_confirmed"]
    rows, _ = run([72, 40])
    assert rows[-1][3] == "defensive" and rows[-1][-1] == "initialized_provisional"
    rows, _ = run([55, 55, 20.0])
    assert rows[-1][3] == "stress" and rows[-1][-1] == "immediate_stress_override"
    rows, _ = run([55, 55, 20.0001])
    assert rows[-1][3] == "balanced" and rows[-1][-1] == "pending"


def test_missing_pauses_the_counter():
    rows, _ = run([72, 72, 60, None, 60])
    assert [r[-1] for r in rows][2:] == ["pending", "unavailable_stale", "switched"]
    assert rows[-1][3] == "balanced"


def test_append_equals_replay():
    random.seed(3)
    scores = [random.choice([None, random.uniform(0, 100)]) for _ in range(200)]
    whole, _ = run(scores)
    first, state = run(scores[:77])
    second, _ = folds.fold(enumerate(scores[77:], 78), state)
    assert whole == first + second


def test_stream_equals_batch(spark):
    random.seed(5)
    rows = [(u, i, None if random.random() < 0.1 else random.uniform(0, 100)) for u in range(4) for i in range(1, 31)]
    df = spark.createDataFrame(rows, streams.SCORE_SCHEMA)
    source, out, check = (tempfile.mkdtemp(prefix="run-") for _ in range(3))
    for lo, hi in ((1, 10), (11, 20), (21, 30)):
        df.where(F.col("session_ix").between(lo, hi)).coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(streams.SCORE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = streams.regime_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = spark.read.parquet(out)
    want = folds.state_history(df, 1, 30)
    cols = ["universe_id", "session_ix", "confirmed", "status", "pending_count"]
    assert got.count() == 120
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0


def test_stream_notices_skipped_sessions(spark):
    random.seed(6)
    rows = [(u, i, random.uniform(0, 100)) for u in range(3) for i in range(1, 25) if i in (1, 24) or random.random() < 0.7]
    df = spark.createDataFrame(rows, streams.SCORE_SCHEMA)
    source, out, check = (tempfile.mkdtemp(prefix="run-") for _ in range(3))
    for lo, hi in ((1, 8), (9, 16), (17, 24)):
        df.where(F.col("session_ix").between(lo, hi)).coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(streams.SCORE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = streams.regime_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    cols = ["universe_id", "session_ix", "confirmed", "status", "pending_count"]
    got, want = spark.read.parquet(out).select(cols), folds.state_history(df, 1, 24).select(cols)
    assert got.count() == 72 and got.exceptAll(want).count() == 0


def test_stream_gives_late_scores_back(spark):
    df = spark.createDataFrame([(u, i, 10.0 * u + i) for u in (4, 6) for i in range(1, 9)], streams.SCORE_SCHEMA)
    late = spark.createDataFrame([(4, 3, 99.0), (6, 6, None)], streams.SCORE_SCHEMA)
    source, out, check = (tempfile.mkdtemp(prefix="run-") for _ in range(3))
    for part in (df.where("session_ix <= 6"), late, df.where("session_ix > 6")):
        part.coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(streams.SCORE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = streams.regime_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    cols = ["universe_id", "session_ix", "confirmed", "status", "pending_count"]
    got = spark.read.parquet(out)
    assert sorted((r.universe_id, r.session_ix) for r in got.where("status = 'late'").collect()) == [(4, 3), (6, 6)]
    want = folds.state_history(df, 1, 8)
    assert got.where("status <> 'late'").count() == 16 and got.where("status <> 'late'").select(cols).exceptAll(want.select(cols)).count() == 0


def test_publish_is_idempotent(spark):
    root = tempfile.mkdtemp(prefix="run-") + "/store"
    rows = [(i, float(i * s), 10.0, s) for i in range(5) for s in (1, 2, 3)]
    df = spark.createDataFrame(rows, streams.BAR_SCHEMA)
    acts = lambda d: {r.session_ix: r.action for r in sinks.publish_sessions(d, root, streams.BAR_SCHEMA, ["close", "volume"]).collect()}
    assert acts(df.where("session_ix < 3")) == {1: "write", 2: "write"}
    changed = df.withColumn("close", F.when((F.col("session_ix") == 2) & (F.col("instrument_id") == 1), -1.0).otherwise(F.col("close")))
    assert acts(changed) == {1: "no_op", 2: "conflict", 3: "write"}
    assert sinks.read_sessions(spark, root, streams.BAR_SCHEMA).count() == 15
    assert sinks.read_sessions(spark, root, streams.BAR_SCHEMA).where("close < 0").count() == 0


def greedy(rows, cap, limit):
    taken, per, out = 0, {}, {}
    for i, g, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        if taken >= cap:
            out[i] = "display_cap_reached"
        elif per.get(g, 0) >= limit:
            out[i] = "concentration_cap_reached"
        else:
            out[i], taken, per[g] = "selected", taken + 1, per.get(g, 0) + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_capped_selection_equals_greedy_walk(spark, seed):
    random.seed(seed)
    rows = [(i, random.choice("aaaab" if seed else "abcde"), float(random.randint(0, 12))) for i in range(60)]
    df = spark.createDataFrame([(1, *r) for r in rows], "session_ix int, instrument_id int, grp string, score double")
    sel = capped_selection(df, ["session_ix"], "grp", [F.desc("score"), F.col("instrument_id")], 10, 0.3)
    out = with_rejections(df, sel, ["session_ix"], [(-F.col("score")).alias("k1"), F.col("instrument_id").alias("k2")], ["instrument_id"], 10)
    got = {r.instrument_id: r.outcome for r in out.collect()}
    want = greedy(rows, 10, 3)
    assert got == want


def stage_run(asks):
    from sessionloom.streaming import stages

    state, out = stages.START, []
    for a in asks:
        rules = None if a is None else {s: a.get(s) for s in ("none", "watch", "prepare", "enter", "invalidated")}
        state, status = stages.step(state, rules)
        out.append((state[0], status))
    return out


def test_stage_confirmation_and_missing_hold():
    listed, up = {"none": "not_listed_to_watch"}, {"watch": "watch_to_prepare"}
    assert stage_run([listed, up, up]) == [("watch", "listed"), ("watch", "pending"), ("prepare", "switched")]
    assert stage_run([listed, up, {}, up]) == [("watch", "listed"), ("watch", "pending"), ("watch", "pending_reversed"), ("watch", "pending")]
    assert stage_run([listed, up, None, up])[-1] == ("prepare", "switched")
    assert stage_run([listed, None, None]) == [("watch", "listed"), ("watch", "unavailable_stale"), (None, "unavailable_null")]


def test_stage_rule_change_restarts_the_counter():
    asks = [{"none": "not_listed_to_watch"}, {"watch": "watch_to_prepare"}, {"watch": "watch_to_prepare"}, {"prepare": "prepare_to_enter"}, {"prepare": "prepare_to_watch"}, {"prepare": "prepare_to_watch"}]
    assert [x[0] for x in stage_run(asks)] == ["watch", "watch", "prepare", "prepare", "prepare", "watch"]
    assert stage_run([asks[0], {"watch": "active_to_invalidated"}])[-1] == ("invalidated", "invalidated")


def test_stage_sessions_close_in_order_whatever_arrives_first():
    from sessionloom.streaming import stage_stream as SS

    rnd = random.Random(4)
    asks = {"none": "not_listed_to_watch", "watch": "watch_to_prepare", "prepare": "prepare_to_enter", "enter": "enter_to_prepare", "invalidated": "invalidated_to_watch"}
    facts = {ix: {k: {"known": rnd.random() < 0.9, "confidence": 0.5, **{f"{m}_{s}": r if rnd.random() < 0.8 else None for m in ("calm", "tense") for s, r in asks.items()}} for k in range(5) if rnd.random() < 0.7} for ix in range(1, 30)}
    regimes = {ix: rnd.choice(["balanced", "stress", None]) for ix in range(1, 30) if ix % 7}  # every seventh session never gets a state
    regimes[29] = "balanced"
    copy = lambda d: {k: dict(v) if isinstance(v, dict) else v for k, v in d.items()}
    whole, last = SS.advance({}, copy(facts), copy(regimes), None)
    assert last == 29 and {ix for _, ix, *_ in whole} == set(range(1, 30))
    for cuts in ([(1, 10, 12), (11, 29, 29)], [(1, 29, 3), (30, 30, 29)], [(1, 6, 6), (7, 20, 15), (21, 29, 29)]):
        stages, waiting, out, last, told = {}, {}, [], None, 0
        for lo, hi, known in cuts:  # facts of lo..hi and the market states up to ``known`` arrive together
            waiting.update({ix: dict(facts[ix]) for ix in range(lo, hi + 1) if ix in facts and (last is None or ix > last)})
            rows, last = SS.advance(stages, waiting, {ix: r for ix, r in regimes.items() if told < ix <= min(known, hi)}, last)
            out, told = out + rows, min(known, hi)
        if told == 29:
            assert out == whole
    assert SS.advance({}, {3: {}}, {}, 2) == ([], 2)
