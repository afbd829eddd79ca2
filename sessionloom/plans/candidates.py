"""Candidate plans: raw facts, seven-component score and confidence, risk-mode lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.numeric import declining_score, linear_score, log_linear_score, sorted_middle
from sessionloom.functions.ranking import small_groups
from sessionloom.functions.staging import cut, stored
from sessionloom.operators import windows as W
from sessionloom.operators.crosssection import SESSION, percentile_0_100, robust_score, small_cross_sections
from sessionloom.operators.filters import risk_rejections
from sessionloom.operators.joins import best_partner
from sessionloom.operators.topk import capped_selection
from sessionloom.params.candidates import COMPONENTS, CONFIDENCE, LOW_RELATIONSHIP, MINIMUM_WEIGHT, NORMALISERS, REQUIRED_HISTORY, SECTOR_CAP

ID = ["instrument_id", "session_ix"]
CROSS = {"s_driver_rel5": "driver_rel5", "s_stock_driver5": "stock_driver5", "s_rel5": "rel5", "s_rel20": "rel20", "s_volume": "log_volume"}


def facts(stock: DataFrame, legs: DataFrame, market: DataFrame, regime: DataFrame) -> DataFrame:
    """JOB-14: raw metrics of every bar in one window pass, plus the best registered fund as driver.

    What has a row per session is stored, so its size decides whether it is broadcast. An instrument's drivers travel as a map by session,
    no longer than the calendar: both sides stay dealt by instrument.
    """
    legs, market, regime = stored(legs, "legs"), stored(market, "market"), stored(regime, "regime")
    b = W.versus_benchmark(stock, market)
    b = W.relative_strength(W.add_returns(b), windows=(5, 20))
    b = W.max_drawdown(W.trailing_means(b), 6)
    b = W.downside_tail(W.open_gaps(W.realised_volatility(W.volume_ratio(b), windows=(10,))))
    b = b.withColumn("_dv", F.col("close") * F.col("volume"))
    h = W.sessions(20)
    b = b.select(
        *ID, "close", "r5", "r20", "rel5", "rel20", "sma_spread", "rv10", "max_gap", "tail_share", "participation",
        F.log("volume_ratio").alias("log_volume"), F.abs("max_dd").alias("dd_abs"), (F.col("persistence") * 100).alias("n_persistence"),
        F.when(F.col("above10").isNotNull(), F.when(F.col("above10"), 100.0).otherwise(0.0)).alias("n_above10"),
        F.when(F.count("_dv").over(h) >= 15, sorted_middle(F.collect_list("_dv").over(h))).alias("median_dv"),
        F.count(F.lit(1)).over(W.sessions(REQUIRED_HISTORY)).alias("n_history"), (F.col("b_close") / W.lagged("b_close", 5) - 1).alias("m5"))
    funds = W.add_returns(W.add_log_return(legs), lags=(5,))
    drv = best_partner(W.add_log_return(stock), funds, 20, 18, 0.35)
    f5 = funds.select(F.col("instrument_id").alias("driver"), "session_ix", F.col("r5").alias("f5"))
    one = F.struct("driver", "driver_corr", "driver_obs")
    drv = drv.dropna(subset=ID).where("driver is not null").groupBy("instrument_id").agg(F.map_from_entries(F.collect_list(F.struct("session_ix", one))).alias("_drivers"))
    b = b.join(drv, "instrument_id", "left").withColumn("_d", F.try_element_at("_drivers", F.col("session_ix"))).select("*", "_d.*").drop("_drivers", "_d")
    b = b.join(f5, ["driver", "session_ix"], "left").join(regime, "session_ix", "left")
    return b.select("*", (F.col("f5") - F.col("m5")).alias("driver_rel5"), (F.col("r5") - F.col("f5")).alias("stock_driver5"), F.col("regime_score").alias("n_regime"))


def cross_scores(f: DataFrame, counted: DataFrame) -> DataFrame:
    """Facts with their scores among those of the session; the rows of ``counted`` per session say whether one task may sort them."""
    if small_groups(counted, SESSION):
        kept, given = f.columns, F.col("instrument_id").isNotNull()  # an instrument without id counts but has no score
        made = small_cross_sections(f, CROSS, {"p_r20": "r20"})
        return made.select(*kept, *[F.when(given, F.col(k)).alias(k) for k in (*CROSS, "p_r20")])
    f = cut(f)
    tall = f.select(*ID, F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(c).alias("x")) for k, c in CROSS.items()])).alias("_e")).select(*ID, "_e.*")
    tall = robust_score(tall.where("x is not null"), "x", ["session_ix", "metric"])
    wide = tall.groupBy(*ID).pivot("metric", list(CROSS)).agg(F.max("score"))
    pct = percentile_0_100(f.where("r20 is not null").select(*ID, "r20"), "r20", out="p_r20").select(*ID, "p_r20")
    return f.join(wide, ID, "left").join(pct, ID, "left")


def scores(f: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """JOB-15: seven components; each needs all its metrics, the total needs 80 of 100 weight. ``counted`` has as many rows per session as the facts."""
    df = cross_scores(f, f if counted is None else counted)
    kinds = {"linear": linear_score, "declining": declining_score, "log": log_linear_score}
    df = df.select("*", *[kinds[k](c, lo, hi).alias(n) for n, (c, k, lo, hi) in NORMALISERS.items()])
    comps = []
    for name, (_, items) in COMPONENTS.items():
        raw = sum((F.col(m) * (w / 100.0) for m, w in items), F.lit(0.0))
        capped = F.when(raw.isNotNull(), F.least(F.lit(SECTOR_CAP), raw))  # least() alone would skip the null
        comps.append((capped if name == "etf_sector_alignment" else raw).alias(name))
    df = df.select("*", *comps)
    have = sum((F.when(F.col(n).isNotNull(), w).otherwise(0) for n, (w, _) in COMPONENTS.items()), F.lit(0))
    total = sum((F.coalesce(F.col(n) * w, F.lit(0.0)) for n, (w, _) in COMPONENTS.items()), F.lit(0.0))
    conf = (CONFIDENCE["source"] * have / 100.0 + CONFIDENCE["history"] * F.least(F.col("n_history") / REQUIRED_HISTORY, F.lit(1.0))
            + CONFIDENCE["relationship"] * F.when(F.col("driver").isNotNull(), LOW_RELATIONSHIP).otherwise(0.0))
    return df.select("*", have.alias("weight"), F.when(have >= MINIMUM_WEIGHT, total / have).alias("base_score"), conf.alias("confidence"))


def risk_lists(scored: DataFrame, modes: dict, watch: float, price: float, liquidity: float, confidence: float, caps: dict) -> DataFrame:
    """JOB-16: per risk mode, the capped list of candidates without a rejection reason."""
    c = F.col
    df = scored.select(*ID, "form", "exchange", c("base_score").alias("score"), c("close").alias("price"), "median_dv", c("rv10").alias("volatility"), c("max_gap").alias("gap"), "confidence",
                       F.lit(False).alias("quarantined"))
    out = None
    for mode, p in modes.items():
        ok = df.where(F.size(risk_rejections(p, watch, price, liquidity, confidence)) == 0)
        part = capped_selection(ok, ["session_ix"], "exchange", [F.desc(F.round("score", 6)), c("instrument_id")], *caps[mode]).select(*ID, F.lit(mode).alias("mode"), "rank", "score")
        out = part if out is None else out.unionByName(part)
    return out
