"""Inputs that the test tables do not hold: calendar edges, decimal ties, fractional scores, short series, many benchmarks."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import scalars as S
from sessionloom.operators import joins as J
from sessionloom.plans import research as RS
from sessionloom.sources import fixtures
from sessionloom.streaming import folds


def test_price_limits_are_decimal(spark):
    closes = [i / 100 for i in range(100, 3000)]
    df = spark.createDataFrame([(c, r) for c in closes for r in (0.05, 0.1, 0.2)], "pc double, ratio double")
    cents = Decimal("0.01")
    for r in df.select("pc", "ratio", *S.price_limits(F.col("pc"), F.col("ratio"))).collect():
        pc, ratio = Decimal(f"{r.pc:.2f}"), Decimal(f"{r.ratio:.4f}")
        assert r.limit_up == float((pc * (1 + ratio)).quantize(cents, ROUND_HALF_UP))
        assert r.limit_down == float((pc * (1 - ratio)).quantize(cents, ROUND_HALF_UP))


def test_local_cost_ties(spark):
    fees = dict(commission=0.0003, minimum=5.0, transfer=0.00002, handling=0.00005, stamp=0.001)
    df = spark.createDataFrame([(100050.0, "sell"), (250.0, "sell"), (65.0, "sell"), (65.0, "buy")], "amount double, side string")
    got = [tuple(r) for r in df.select(*S.local_cost(F.col("amount"), F.col("side"), fees)).collect()]
    assert got == [(30.02, 2.0, 5.0, 100.05, 137.07), (5.0, 0.01, 0.01, 0.25, 5.27), (5.0, 0.0, 0.0, 0.07, 5.07), (5.0, 0.0, 0.0, 0.0, 5.0)]


@pytest.mark.parametrize("n", [1, 3, 5, 12])
def test_bootstrap_of_short_series(spark, n):
    df = spark.createDataFrame([("t", i, 1.0, float(i)) for i in range(n)], "trial string, session_ix int, v double, x double")
    boot = RS.block_bootstrap(df, "trial", "v", 20, 5, "s").collect()
    assert len(boot) == 20 and all(abs(r.boot - 1.0) < 1e-12 for r in boot)
    line = RS.slope_bootstrap(df.withColumn("y", F.col("x") * 2 + 1), "trial", "x", "y", 20, 5, "s").collect()
    assert len(line) == 20 and all(r.boot is None or abs(r.boot - 2.0) < 1e-9 for r in line)


def test_forward_asof_at_the_edges(spark):
    s = spark.createDataFrame([(i, dt.date(1995, 1, 2) + dt.timedelta(7 * i)) for i in range(3)], "session_ix int, day date")
    s = s.withColumn("open_utc", F.col("day").cast("timestamp") + F.expr("INTERVAL 14 HOURS 30 MINUTES"))
    stamps = ["1980-06-01 10:00:00", "1994-12-20 10:00:00", "1995-01-02 10:00:00", "1995-01-02 14:30:00", "1995-01-16 14:00:00", "1995-01-16 14:30:00", "2020-01-01 00:00:00"]
    df = spark.createDataFrame([(x,) for x in stamps], "s string").select("s", F.col("s").cast("timestamp").alias("ts"))
    got = {r.s: r.eligible_ix for r in J.first_open_after(df, F.col("ts"), J.next_session_lookup(s, "day", "open_utc")).collect()}
    assert [got[x] for x in stamps] == [0, 0, 0, 1, 2, None, None]


class Tables:
    """A few line items, suppliers and events in place of the stored tables."""

    def __init__(self, spark, lines, events=()):
        self.spark = spark
        self.lineitem = spark.createDataFrame([(o, 1, k, 1, 2.0, 10.0 + o, 0.0, 0.0, "N", "O", d) for o, (k, d) in enumerate(lines)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
        self.events = spark.createDataFrame([(i, d, u, "x", v, "{}") for i, (u, d, v) in enumerate(events)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")


def test_calendar_follows_the_data(spark):
    days = [dt.datetime(1995, 3, 1), dt.datetime(2006, 5, 9, 23, 59)]
    t = Tables(spark, [(1, d) for d in days])
    first, last = fixtures.session_range(t)
    assert (first, last) == (9, 593) and sorted(r.session_ix for r in fixtures.bars(t).collect()) == [9, 593]
    assert fixtures.bars_between(t, 593, 593).count() == 1 and fixtures.bars_between(t, 10, 592).count() == 0
    assert fixtures.session_range(Tables(spark, [])) == (1, 1)


def test_state_history_covers_years(spark):
    from sessionloom.catalog.market import daily_composite

    t = Tables(spark, [], [(1, dt.datetime(2023, 1, 1), 40.0), (1, dt.datetime(2023, 1, 2), 40.0), (1, dt.datetime(2024, 1, 1), 5.0)])
    scores, first, last = daily_composite(t)
    rows = folds.state_history(scores, first, last).orderBy("session_ix").collect()
    assert len(rows) == last == 366 and rows[-1].score == 10.0 and rows[-1].status == "immediate_stress_override"


def test_bars_between_filters_the_scan(spark):
    from sessionloom.catalog.core import Tables as Stored

    df = fixtures.bars_between(Stored(spark, "/root/testdata/sf0.001"), 200, 200)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan


def test_first_open_after_without_a_stamp_and_at_the_edges(spark):
    from sessionloom.operators import joins as J

    days = spark.createDataFrame([(1, "2020-01-06"), (2, "2020-01-08"), (3, "2020-01-09")], "session_ix int, d string").select("session_ix", F.to_date("d").alias("day"))
    sessions = days.withColumn("open", F.col("day").cast("timestamp") + F.expr("INTERVAL 14 HOURS"))
    stamps = [(0, None, None), (1, "2019-12-01 10:00:00", 1), (2, "2020-01-06 13:59:59", 1), (3, "2020-01-06 14:00:00", 2), (4, "2020-01-08 00:00:00", 3), (5, "2020-01-09 14:00:00", None), (6, "2020-02-01 09:00:00", None)]
    df = spark.createDataFrame([(i, s) for i, s, _ in stamps], "id int, s string").withColumn("at", F.col("s").cast("timestamp"))
    got = {r.id: r.eligible_ix for r in J.first_open_after(df, F.col("at"), J.next_session_lookup(sessions, "day", "open")).collect()}
    assert got == {i: want for i, _, want in stamps}


def test_correlation_of_a_constant_is_null(spark):
    from sessionloom.operators.aggregates import pearson, rank_ic

    df = spark.createDataFrame([(1, 2.0, float(i)) for i in range(5)] + [(2, float(i), float(i * i)) for i in range(5)] + [(3, None, 1.0), (3, 1.0, 2.0)], "g int, a double, b double")
    got = {r.g: (r.n_pairs, r.corr) for r in df.groupBy("g").agg(*pearson("a", "b", 3)).collect()}
    assert got[1] == (5, None) and got[3] == (1, None) and abs(got[2][1] - 0.9589266) < 1e-6
    ics = {r.g: r.ic for r in rank_ic(df, ["g"], "a", "b").collect()}
    assert ics[1] is None and abs(ics[2] - 1) < 1e-9


def test_asof_by_span_equals_the_grid(spark):
    """States written out as spans equal the search over the whole grid: repeated and null keys, states before, after and without a session."""
    from sessionloom.operators import joins as J

    states = spark.createDataFrame([(1, 3, 30, "a"), (1, 3, 31, "b"), (1, 5, 50, "c"), (1, 99, 990, "d"), (2, -4, 1, "e"), (2, None, 0, "f"), (3, 4, 40, "g"), (None, 2, 20, "h"), (4, None, 7, "i"), (6, 4, None, "j")],
                                   "k int, session_ix int, at int, v string")
    keys = spark.createDataFrame([(1,), (2,), (2,), (None,), (4,), (5,), (6,)], "k int")
    grid = keys.select("k", F.explode(F.sequence(F.lit(2), F.lit(7))).alias("session_ix"))
    rows = lambda df: sorted(map(str, df.collect()))
    want = J.asof_by_session(states, grid, "k", "at", ["v"])
    got = J.asof_by_span(states, keys, "k", "at", ["v"], 2, 7)
    assert got.columns == want.columns and rows(got) == rows(want) and got.count() == 42


def test_sorted_middle_with_nulls(spark):
    from sessionloom.functions.numeric import sorted_middle

    df = spark.createDataFrame([([3.0, 1.0, 2.0],), ([4.0, 1.0, 2.0, 3.0],), ([1.0, None, 2.0],), ([None, 1.0],), ([None],), ([],), (None,)], "a array<double>")
    assert [r.m for r in df.select(sorted_middle(F.col("a")).alias("m")).collect()] == [2.0, 2.5, 2.0, None, None, None, None]
    assert "array_sort" not in df.select(sorted_middle(F.col("a")).alias("m"))._jdf.queryExecution().toString().replace("sort_array", "")


def test_stage_fold_over_batches(spark):
    """The fold's state crosses Arrow batches and starts anew with each instrument; a null instrument is a group."""
    from sessionloom.streaming.stages import START, session, stage_history

    facts = [(k, ix, 60.0 if (k or 0) % 2 else 40.0, 0.5 if ix % 5 else None, 900.0, 1e6, 60.0, 60.0, 60.0, False, False, "balanced") for k in (1, 2, 3, None) for ix in range(1, 30) if (ix + (k or 0)) % 4]
    df = spark.createDataFrame(facts, "instrument_id long, session_ix int, score double, confidence double, price double, median_dv double, rs double, trend double, alignment double, anomaly boolean, breakout boolean, regime string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, stage_history(df, 1, 30, 500.0, 1e5).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 120 and {r[0] for r in got} == {1, 2, 3, None}
    state, want = START, []
    for ix in range(1, 31):
        there = ix < 30 and (ix + 1) % 4
        clear = bool(ix % 5)
        rules = {"none": "not_listed_to_watch" if clear else None, "watch": None, "prepare": None, "enter": None, "invalidated": "invalidated_to_watch"} if there else None
        state, record = session(state, rules, 0.5 if clear else float("nan"))
        want.append((1, ix, *record))
    same = lambda a, b: a == b or (a is None and b != b)
    assert all(same(x, y) for a, b in zip(got[:30], want) for x, y in zip(a, b))
