"""What a query shuffles for panels and cross-sections, and that the narrow forms give the same rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sessionloom.functions import ranking as RK
from sessionloom.functions.staging import stored
from sessionloom.operators import crosssection as X
from sessionloom.operators.joins import best_partner
from sessionloom.sources.fixtures import bars


class _Tables:
    def __init__(self, lineitem):
        self.lineitem = lineitem


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def _lines(spark):
    rows = [(o, 1, s, n, float(1 + (o + n) % 5), 100.0 + 7 * o + n, f"1995-0{1 + o % 3}-0{1 + n}") for o in range(12) for s in (1, 2) for n in (1, 2)]
    rows += [(1, 1, None, 1, 2.0, 50.0, "1995-02-01"), (50, 1, 3, 1, 2.0, 60.0, None)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, d string")
    return df.withColumn("l_shipdate", F.to_timestamp("d")).drop("d")


def test_market_bars_need_one_exchange(spark):
    t = _Tables(_lines(spark))
    market = bars(t, "market", "month")
    assert _plan(market).count("Exchange hashpartitioning") == 1
    stocks = bars(t, grain="month").groupBy("session_ix").agg(F.sum("volume").alias("volume"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("trades").alias("trades"))
    key = lambda r: (r.session_ix is None, r.session_ix)
    got = market.select("session_ix", "volume", "high", "low", "trades").collect()
    assert sorted(got, key=key) == sorted(stocks.collect(), key=key)
    first = next(r for r in market.collect() if r.session_ix == 1)
    prices = [(100.0 + 7 * o + n) / (1 + (o + n) % 5) for o, n in ((0, 1), (9, 2))]  # first and last trade of January
    assert (first.open, first.close) == tuple(prices)


def test_small_cross_sections_equal_the_distributed_scores(spark):
    rnd = random.Random(4)
    rows = [(i, ix, rnd.choice([None, round(rnd.gauss(0, 1), 1)]), rnd.choice([None, float(rnd.randrange(4))])) for ix in (1, 2, 3) for i in range(40)]
    rows += [(1, 4, 2.0, 1.0), (2, 4, 2.0, None), (3, 5, None, None), (9, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "instrument_id long, session_ix int, x double, y double")
    got = {(r.instrument_id, r.session_ix): r for r in X.small_cross_sections(df, {"sx": "x", "sy": "y"}, {"px": "x"}).collect()}
    assert len(got) == len(rows)
    ids = ["instrument_id", "session_ix"]
    for out, value, want in (("sx", "x", X.robust_score(df.where("x is not null"), "x")), ("sy", "y", X.robust_score(df.where("y is not null"), "y")), ("px", "x", X.percentile_0_100(df.where("x is not null"), "x", out="score"))):
        known = {(r.instrument_id, r.session_ix): r.score for r in want.select(*ids, "score").collect()}
        for k, r in got.items():
            assert (r[out] is None) == (k not in known) and (r[out] is None or abs(r[out] - known[k]) < 1e-9), (out, k)


def test_bracketed_quantile_is_exact(spark):
    rnd = random.Random(5)
    rows = [(g, rnd.choice([None, rnd.gauss(0, 1), 0.5]), float(rnd.randrange(3))) for g, n in (("a", 3001), ("b", 500), ("c", 2), ("d", 1)) for _ in range(n)]
    rows += [("e", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    want = {v: {r.g: r.q for r in RK.quantiles(df, ["g"], v, {"q": 0.5}).collect()} for v in ("x", "y")}
    for slack, accuracy in ((0.01, 200), (0.0, 1)):  # the second brackets miss
        got = {r.g: r for r in RK.bracketed_quantile(df, ["g"], {"mx": "x", "my": "y"}, 0.5, slack, accuracy).collect()}
        for g in "abcd":
            assert got[g].mx == want["x"].get(g) and got[g].my == want["y"][g], (g, slack)
        assert "e" not in got or got["e"].mx is None


def test_partners_are_not_dealt_by_fund(spark):
    stock = spark.createDataFrame([(i, ix, 0.01 * ((i + ix) % 3 - 1)) for i in range(3) for ix in range(1, 6)], "instrument_id long, session_ix int, lr double")
    legs = stored(spark.createDataFrame([(f, ix, 0.01 * ((len(f) + ix) % 3 - 1), 0.1) for f in ("A", "BB") for ix in range(1, 6)], "instrument_id string, session_ix int, lr double, r5 double"), "legs")
    plan = _plan(best_partner(stock, legs, 4, 3, 0.35))
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(instrument_id" in plan and "fund#" not in plan.split("Exchange hashpartitioning")[-1].split("\n")[0]
