"""Statistics of a rule's signals against its controls (JOB-58, JOB-59).

Outcomes are intervals: a traded exit gives a point, a missing one the bounds that the prices around it leave. Every observation
meets all parameter combinations in one pass and is reduced to sums per (combination, horizon, session, role); endpoint
scenarios choose a bound for each side from these sums, so they cost nothing per observation. Only medians of signals
go back to the rows, through exact distributed quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.numeric import ratio
from sessionloom.functions.ranking import bracketed_quantile
from sessionloom.functions.staging import cut
from sessionloom.operators.aggregates import attach_one_row, chronological_halves
from sessionloom.operators.windows import series
from sessionloom.params.strategy import (BLOCK, COMBINATIONS, COSTS_BPS, HOLM_ALPHA, HORIZONS, MINIMUM_SESSIONS, MINIMUM_SIGNALS, NUMERIC, PRIMARY_HORIZON, REGIMES, REPLICATES, ROBUSTNESS_GATES, SCENARIOS,
                                         STATES)
from sessionloom.plans.research import block_bootstrap, bootstrap_report, cohorts

KEY = ["combo", "horizon"]
CASE = [*KEY, "scenario"]


def outcomes(bars: DataFrame, benchmark: DataFrame, evidence_ratio: float, keep: Sequence[str] = ()) -> DataFrame:
    """Per bar and horizon: state, bounds of the return and of the return over the benchmark's, excursions.

    Entry is the next session's open. A session that didn't trade at the horizon leaves the interval between the closes around it; with no later bar at all the last close is the
    reference. Closes that differ by ``evidence_ratio`` or more ask for evidence that isn't there.
    Columns in ``keep`` stay beside the labels, so that they need not be joined to them.
    """
    c, far = F.col, max(HORIZONS)
    bar = F.struct("session_ix", "open", "high", "low", "close")
    # a bar of each of the next sessions, and the one after them, are among the next ``far + 1`` bars
    b = bars.select("instrument_id", "session_ix", *keep, F.array_compact(F.array(*[F.lead(bar, k).over(series()) for k in range(1, far + 2)])).alias("next"))
    b = b.select("instrument_id", "session_ix", *keep, F.filter("next", lambda x: x["session_ix"] <= c("session_ix") + far).alias("near"), F.get(F.filter("next", lambda x: x["session_ix"] > c("session_ix") + far), F.lit(0)).alias("after"))
    market = benchmark.select("session_ix", *[F.lead(x, k).over(Window.orderBy("session_ix")).alias(f"{x}{k}") for x, k in [("open", 1), *[("close", h) for h in HORIZONS]]], F.lead("session_ix", far).over(Window.orderBy("session_ix")).alias("_far"))
    b = b.join(market.where(c("_far") - c("session_ix") == far).drop("_far"), "session_ix", "left")

    def label(h: int) -> Column:
        entry, last, then = c("_entry"), c(f"_last{h}"), c(f"_then{h}")
        low, high = F.least(last["close"], then), F.greatest(last["close"], then)
        traded = last["session_ix"] == c("session_ix") + h
        state = (F.when(entry.isNull(), STATES[4]).when(c(f"close{h}").isNull() | c("open1").isNull(), STATES[3]).when(traded, STATES[0]).when(then.isNull(), STATES[1]).when(high >= evidence_ratio * low, STATES[3]).otherwise(STATES[2]))
        return state, F.when(traded | then.isNull(), last["close"]).otherwise(low), F.when(traded | then.isNull(), last["close"]).otherwise(high)

    def fields(h: int) -> Column:
        entry, state, known = c("_entry"), c(f"_state{h}"), c(f"_state{h}").isin(*NUMERIC)
        base = c(f"close{h}") / c("open1") - 1
        lower, upper = c(f"_lower{h}") / entry - 1, c(f"_upper{h}") / entry - 1
        return F.struct(F.lit(h).alias("horizon"), state.alias("state"), F.when(known, lower).alias("lower"), F.when(known, upper).alias("upper"), F.when(known, lower - base).alias("rel_lower"), F.when(known, upper - base).alias("rel_upper"),
                        F.when(known, c(f"_high{h}") / entry - 1).alias("favourable"), F.when(known, c(f"_low{h}") / entry - 1).alias("adverse"))

    b = b.withColumn("near", F.when(F.size("near") > 0, c("near")))  # an empty list has no last bar
    # each list is gone through once: what several fields need is a column of an earlier step
    ahead = lambda keep: F.get(F.filter("near", lambda x: keep(x["session_ix"])), F.lit(0))
    b = b.withColumns({"_entry": ahead(lambda ix: ix == c("session_ix") + 1)["open"], **{f"_inside{h}": F.filter("near", lambda x: x["session_ix"] <= c("session_ix") + h) for h in HORIZONS},
                       **{f"_then{h}": F.coalesce(ahead(lambda ix: ix > c("session_ix") + h), c("after"))["close"] for h in HORIZONS}})
    b = b.withColumns({f"{name}{h}": x for h in HORIZONS for name, x in (
        ("_last", F.get(f"_inside{h}", F.size(f"_inside{h}") - 1)), ("_high", F.array_max(F.transform(f"_inside{h}", lambda x: x["high"]))), ("_low", F.array_min(F.transform(f"_inside{h}", lambda x: x["low"]))))})
    b = b.withColumns({f"{name}{h}": x for h in HORIZONS for name, x in zip(("_state", "_lower", "_upper"), label(h))})
    return b.select("instrument_id", "session_ix", *keep, F.array(*[fields(h) for h in HORIZONS]).alias("labels"))


def assigned(features: DataFrame, labels: DataFrame) -> DataFrame:
    """combo, role, session_ix, regime and the label's fields: signals and controls of every combination and horizon."""
    rows = cohorts(features.join(labels, ["instrument_id", "session_ix"])).where(F.col("role").isin("signal", "eligible_leader_control"))
    return rows.select("combo", (F.col("role") == "signal").alias("signal"), "instrument_id", "session_ix", "regime", F.inline("labels"))


def _cells(rows: DataFrame) -> DataFrame:
    """One row per (combination, horizon, session): both roles' counts by state and sums of both bounds."""
    known = F.col("state").isin(*NUMERIC)
    aggs, by = [], [*KEY, "session_ix"]
    for role, mine in (("s", F.col("signal")), ("c", ~F.col("signal"))):
        aggs += [F.count_if(mine).alias(f"{role}_assigned"), F.count_if(mine & known).alias(f"{role}_n"), *[F.sum(F.when(mine, F.col(x))).alias(f"{role}_{x}") for x in ("lower", "upper")], *[F.count_if(mine & (F.col("state") == s)).alias(f"{role}_{s}") for s in STATES]]
    # a regime is a key first: the largest string has no fixed width, so taking it beside the sums would sort all rows
    cells = rows.groupBy(*by, "regime").agg(*aggs)
    return cut(cells.groupBy(*by).agg(F.max("regime").alias("regime"), *[F.sum(x).alias(x) for x in cells.columns[len(by) + 1:]]))


def _bounds() -> Column:
    """Which bound a scenario takes for signals and for controls."""
    return F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit("upper" if s == "all_upper" else "lower").alias("mine"), F.lit("lower" if s == "all_lower" else "upper").alias("theirs")) for s in SCENARIOS])


def _signals(rows: DataFrame) -> DataFrame:
    """Per (combination, horizon, bound): moments, wins and losses before and after costs, medians of the signals' returns."""
    both = F.array(F.struct(F.lit("lower").alias("bound"), F.col("lower").alias("x"), F.col("rel_lower").alias("rel")), F.struct(F.lit("upper").alias("bound"), F.col("upper").alias("x"), F.col("rel_upper").alias("rel")))
    signals = rows.where(F.col("signal") & F.col("state").isin(*NUMERIC))
    tall = signals.select(*KEY, "favourable", "adverse", F.inline(both))
    by = [*KEY, "bound"]
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.avg("favourable").alias("mean_favourable"), F.avg("adverse").alias("mean_adverse"), F.count("favourable").alias("n_excursions")]
    for bps in COSTS_BPS:
        net = F.col("x") - 2 * bps / 10000.0
        aggs += [F.count_if(net > 0).alias(f"wins_{bps}"), F.sum(F.when(net > 0, net)).alias(f"won_{bps}"), F.count_if(net < 0).alias(f"losses_{bps}"), F.sum(F.when(net < 0, net)).alias(f"lost_{bps}")]
    out = tall.groupBy(*by).agg(*aggs)
    ends = ("lower", "upper")
    middle = bracketed_quantile(signals, KEY, {f"{x}{b}": f"{x}{b}" for x in ("", "rel_") for b in ends}, 0.5)
    middle = middle.select(*KEY, F.inline(F.array(*[F.struct(F.lit(b).alias("bound"), F.col(b).alias("median"), F.col(f"rel_{b}").alias("median_relative")) for b in ends])))
    return out.join(middle.where("median is not null and median_relative is not null"), by)


def summaries(rows: DataFrame, floors: tuple[int, int, int], seed: str, replicates: int = REPLICATES, only_exact: bool = False) -> DataFrame:
    """One row per combination, horizon and scenario; ``floors`` are signals, paired sessions, signals per reported regime.

    ``only_exact`` counts points only and has the one scenario ``all_lower``. ``rows`` are gone through a few times and not stored here:
    what they are made of should be.
    """
    c = F.col
    if only_exact:
        rows = rows.withColumn("state", F.when(c("state") == "terminal_reference_interval", "unavailable_evidence").otherwise(c("state")))
        rows = rows.withColumn("lower", F.when(c("state").isin(*NUMERIC), c("lower")))
    cells = _cells(rows)
    halves = chronological_halves(cells)
    cases = cells.join(halves, "session_ix").withColumn("_b", F.explode(_bounds())).select("*", "_b.*").drop("_b")
    if only_exact:
        cases = cases.where("scenario = 'all_lower'")
    mine, theirs = F.when(c("mine") == "upper", c("s_upper")).otherwise(c("s_lower")), F.when(c("theirs") == "upper", c("c_upper")).otherwise(c("c_lower"))
    cases = cut(cases.withColumn("contrast", F.when((c("s_n") > 0) & (c("c_n") > 0), mine / c("s_n") - theirs / c("c_n"))))
    size = F.abs("contrast")
    aggs = [*[F.sum(f"{r}_{x}").alias(f"{r}_{x}") for r in "sc" for x in ("assigned", "n", *STATES)], F.count("contrast").alias("paired_sessions"), F.avg("contrast").alias("contrast"), F.count_if(c("contrast") > 0).alias("n_positive"),
            ratio(F.max(size), F.sum(size)).alias("concentration")]
    aggs += [F.avg(F.when(c("half") == h, c("contrast"))).alias(f"{h}_half_contrast") for h in ("first", "second")]
    aggs += [a for r in REGIMES for a in (F.sum(F.when(c("regime") == r, c("s_n")).otherwise(0)).alias(f"n_{r}"), F.avg(F.when(c("regime") == r, c("contrast"))).alias(f"{r}_contrast"))]
    wide = cases.groupBy(*CASE, c("mine").alias("bound")).agg(*aggs)
    seen = F.array(*[F.when(c(f"n_{r}") > 0, c(f"n_{r}")) for r in REGIMES])
    enough = (c("s_n") >= floors[0]) & (c("c_n") >= floors[0]) & (c("paired_sessions") >= floors[1])
    wide = wide.withColumn("inference_available", enough).withColumn("least_regime", F.array_min(seen)).withColumn("regime_floor_met", F.coalesce(c("least_regime") >= floors[2], F.lit(False)))
    wide = wide.withColumn("positive_ratio", ratio("n_positive", "paired_sessions"))
    trial = F.concat_ws("|", *CASE).alias("trial")
    tested = cases.join(wide.where("inference_available").select(*CASE), CASE, "left_semi").where("contrast is not null").select(trial, "session_ix", "contrast")
    boot = cut(block_bootstrap(tested, "trial", "contrast", replicates, BLOCK, seed))
    report = bootstrap_report(boot, "trial").select("trial", "lower", "upper", "p_value")
    wide = wide.withColumn("trial", trial).join(report, "trial", "left").join(_signals(rows), [*KEY, "bound"], "left").drop("trial", "bound", "n")
    return wide.select("*", *[x for bps in COSTS_BPS for x in _net(bps)])


def _net(bps: int) -> list[Column]:
    cost = 2 * bps / 10000.0
    won, lost = F.col(f"won_{bps}") / F.nullif(F.col(f"wins_{bps}"), F.lit(0)), F.col(f"lost_{bps}") / F.nullif(F.col(f"losses_{bps}"), F.lit(0))
    return [(F.col("mean") - cost).alias(f"mean_net_{bps}"), (F.col("median") - cost).alias(f"median_net_{bps}"), (F.col("median_relative") - cost).alias(f"median_relative_net_{bps}"), ratio(f"wins_{bps}", "s_n").alias(f"win_rate_{bps}"),
            ratio(won, -lost).alias(f"payoff_{bps}"), ratio(F.col(f"won_{bps}"), -F.col(f"lost_{bps}")).alias(f"profit_factor_{bps}")]


def _best(df: DataFrame, by: list[str]) -> DataFrame:
    """Highest lower bound, then contrast, then signals, then the first combination."""
    order = (Window.partitionBy(*by) if by else Window).orderBy(F.desc("lower"), F.desc("contrast"), F.desc("s_n"), "combo")
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def _primary(table: DataFrame) -> DataFrame:
    return table.where(F.col("horizon") == PRIMARY_HORIZON)


def development_selection(table: DataFrame) -> DataFrame:
    """One row: the winner of each endpoint scenario, the status, and what the lock holds if the winners agree."""
    p, c = _primary(table), F.col
    fit = p.where(c("inference_available") & c("regime_floor_met") & c("lower").isNotNull())
    full = fit.groupBy("scenario").agg(F.count(F.lit(1)).alias("_n")).where(c("_n") == COMBINATIONS).select("scenario")
    won = _best(fit.join(full, "scenario", "left_semi"), ["scenario"])
    one = won.agg(*[F.max(F.when(c("scenario") == s, c("combo"))).alias(f"winner_{s}") for s in SCENARIOS], F.count(F.lit(1)).alias("n_winners"), F.countDistinct("combo").alias("n_different"),
                  F.max(F.when(c("scenario") == "contrast_adverse", c("lower"))).alias("objective"), F.max(F.when(c("scenario") == "contrast_adverse", c("contrast"))).alias("tiebreak"))
    blocked = p.agg(F.coalesce(F.sum(c("s_unavailable_evidence") + c("c_unavailable_evidence")), F.lit(0)).alias("n_unavailable"))
    status = (F.when(c("n_unavailable") > 0, "blocked_unavailable_evidence").when(c("n_winners") < len(SCENARIOS), "inconclusive_evidence_floor").when(c("n_different") > 1, "rejected_endpoint_instability").otherwise("locked"))
    locked = c("status") == "locked"
    return attach_one_row(one, blocked).withColumn("status", status).select("status", *[f"winner_{s}" for s in SCENARIOS], F.when(locked, c("winner_contrast_adverse")).alias("selected"), F.when(locked, c("objective")).alias("objective"),
                                                                 F.when(locked, c("tiebreak")).alias("tiebreak"))


def replacement_selection(table: DataFrame, floors: tuple[int, int]) -> DataFrame:
    """Gate rows of the combination that wins every scenario among those that are eligible in all of them, with the status of the selection."""
    p, c = _primary(table), F.col
    clean = c("s_unavailable_evidence") + c("c_unavailable_evidence") == 0
    fit = c("inference_available") & (c("s_n") >= floors[0]) & (c("c_n") >= floors[0]) & (c("paired_sessions") >= floors[1]) & clean
    common = p.groupBy("combo").agg(F.count_if(fit).alias("_n")).where(c("_n") == len(SCENARIOS)).select("combo")
    won = _best(p.join(common, "combo", "left_semi"), ["scenario"])
    state = won.agg(F.count(F.lit(1)).alias("n_winners"), F.countDistinct("combo").alias("n_different"))
    state = attach_one_row(state, p.agg(F.count_if(~clean).alias("n_blocked")))
    adverse = won.where("scenario = 'contrast_adverse'")
    values = F.array(*[F.struct(F.lit(i).alias("gate_order"), F.lit(g).alias("gate"), c(m).cast("double").alias("value"), F.coalesce(c(m) > t if op == ">" else c(m) <= t, F.lit(False)).alias("passed")) for i, (g, m, op, t) in enumerate(ROBUSTNESS_GATES)])
    gates = adverse.select("combo", F.inline(values))
    every = Window.partitionBy()
    gates = gates.withColumn("_all", F.min(c("passed").cast("int")).over(every) == 1)
    names = state.sparkSession.createDataFrame([(i, g) for i, (g, *_) in enumerate(ROBUSTNESS_GATES)], "gate_order int, gate string")
    rows = attach_one_row(names, state).join(gates, ["gate_order", "gate"], "left")
    status = (F.when(c("n_blocked") > 0, "blocked_source_evidence").when(c("n_winners") == 0, "rejected_no_common_eligible").when(c("n_different") > 1, "rejected_endpoint_instability")
              .when(c("_all"), "locked").otherwise("rejected_robustness_gates"))
    reached = status.isin("locked", "rejected_robustness_gates")
    return rows.select("gate", status.alias("status"), F.when(reached, c("combo")).alias("winner"), F.when(reached, c("value")).alias("value"), F.when(reached, c("passed")).alias("passed"), F.when(status == "locked", c("combo")).alias("selected"))


# stages with locks (JOB-58)


def with_holm(table: DataFrame) -> DataFrame:
    """Adjusted p values over the combinations of the primary horizon; combinations without inference count as trials."""
    p = _primary(table).where("p_value is not null")
    n = _primary(table).agg(F.count(F.lit(1)).alias("_m"))
    by = Window.orderBy("p_value", "combo")
    steps = attach_one_row(p, n).withColumn("_s", F.least(F.lit(1.0), F.col("p_value") * (F.col("_m") - F.row_number().over(by) + 1)))
    adjusted = steps.select(*KEY, F.max("_s").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("adjusted_p"))
    return table.join(adjusted, KEY, "left")


def coverage(role: str) -> Column:
    return F.coalesce(ratio(f"{role}_n", f"{role}_assigned"), F.lit(0.0))


def development_lock(table: DataFrame) -> DataFrame:
    """At most one row: the combination that later stages may read."""
    return _best(_primary(table).where(F.col("inference_available") & F.col("lower").isNotNull()), []).select("combo", F.col("lower").alias("objective"), F.col("contrast").alias("tiebreak"))


def _gate(name: str, value: Column, passed: Column) -> Column:
    return F.struct(F.lit(name).alias("gate"), value.cast("double").alias("value"), F.when(value.isNull(), "inconclusive").when(passed, "pass").otherwise("fail").alias("outcome"))


def validation_gates(table: DataFrame, combo: int, regime_floor: int) -> DataFrame:
    """Gates of the locked combination; the first one asks for complete evidence of the whole family."""
    family = _primary(table).agg((F.count_if(F.col("inference_available") & (coverage("s") == 1) & (coverage("c") == 1)) / COMBINATIONS).alias("complete"))
    one = attach_one_row(_primary(table).where(F.col("combo") == combo), family)
    net, least = F.col("median_relative_net_25"), F.col("least_regime")
    return one.select(F.inline(F.array(
        _gate("complete_validation_family_evidence", F.col("complete"), F.col("complete") == 1), _gate("familywise_adjusted_parameter_evidence", F.col("adjusted_p"), F.col("adjusted_p") <= HOLM_ALPHA),
        _gate("net_primary_median_positive", net, net > 0), _gate("regime_observation_floor", least, least >= regime_floor))))


def holdout_gates(table: DataFrame, regime_floor: int) -> DataFrame:
    whole, net, least = F.least(coverage("s"), coverage("c")), F.col("median_relative_net_25"), F.col("least_regime")
    return _primary(table).select(F.inline(F.array(
        _gate("complete_cohort_outcome_coverage", whole, whole == 1), _gate("holdout_primary_contrast_positive", F.col("lower"), F.col("lower") > 0), _gate("net_primary_median_positive", net, net > 0),
        _gate("regime_observation_floor", least, least >= regime_floor))))
