"""Conservative reconstruction of a market's listings (JOB-67): lane decisions, state intervals, gaps, evidence budgets.

Days are reduced to intervals as soon as they are decided: a run of sessions in the same state is one row with its boundaries
flagged, a gap is the space between two runs, and coverage is a sum of lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.numeric import first_failing, reasons
from sessionloom.operators.windows import series

#: Official requests that one security may need for a family of evidence.
REQUESTS = {"corporate_action": 0, "lifecycle": 4, "listing_stage": 1, "risk_warning": 1}
#: Fixed value: requests per security of a search that knows nothing.
BLIND = 5
STATE = ("trading_status", "warning_status", "disposition")


def with_changes(states: DataFrame) -> DataFrame:
    """Sessions on which the adjustment factor differs from the one before, and the instrument's last session."""
    by = series()
    changed = F.lag("session_ix").over(by).isNotNull() & ~F.lag("factor").over(by).eqNullSafe(F.col("factor"))
    return states.withColumn("factor_changed", changed).withColumn("last_ix", F.max("session_ix").over(Window.partitionBy("instrument_id")))


def lane(states: DataFrame, final: int) -> DataFrame:
    """Disposition and reasons of each observed state; a later rule overrides an earlier one, and knowledge comes with the next session.

    Needs ``with_changes``. ``final`` is the last target session, after which nothing is known.
    """
    c = F.col
    unlisted, warned = c("trading_status") == "not_listed", ~c("warning_status").isin("none", "unknown")
    blind = {"trading_status_unknown": c("trading_status") == "unknown", "risk_warning_status_unknown": c("warning_status") == "unknown", "price_limit_regime_unknown": c("board") == "unknown", "factor_change_candidate_window": c("factor_changed"),
             "terminal_boundary_not_adjudicated": (c("session_ix") == c("last_ix")) & (c("session_ix") < final)}
    late = c("session_ix") >= final
    kept = blind["price_limit_regime_unknown"] | blind["factor_change_candidate_window"] | blind["terminal_boundary_not_adjudicated"]
    disposition = first_failing((kept, "quarantined"), (warned, "candidate_excluded"), (blind["risk_warning_status_unknown"], "quarantined"), (unlisted, "candidate_excluded"),
                                (blind["trading_status_unknown"] | late, "quarantined"), ok="candidate_included")
    codes = reasons(*[(x, k) for k, x in blind.items()], (late, "next_session_knowledge_clock_unavailable"), (~late, "next_session_reconstructed_knowledge_clock"), (unlisted, "not_listed_state_exclusion_candidate"),
                    (c("trading_status") == "suspended", "suspension_observed_reconstructed"), (warned, "risk_warning_exclusion_candidate"), (F.lit(True), "not_as_operated"), (F.lit(True), "source_available_at_unobserved"))
    return states.withColumn("disposition", disposition).withColumn("reasons", codes).withColumn("knowledge_ix", F.when(~late, c("session_ix") + 1))


def islands(rows: DataFrame, by: tuple[str, ...] = STATE) -> DataFrame:
    """Runs of adjacent sessions of one instrument with equal ``by``: first_ix, last_ix, whether a gap or another state comes before and after."""
    c, w = F.col, series()
    same = [F.lag(x).over(w).eqNullSafe(c(x)) for x in by]
    adjacent = F.coalesce(c("session_ix") - F.lag("session_ix").over(w) == 1, F.lit(False))
    joined = adjacent
    for x in same:
        joined = joined & x
    marked = rows.withColumn("_new", (~joined).cast("int")).withColumn("_gap", ~adjacent)
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy("instrument_id", "_island", *by).agg(F.min("session_ix").alias("first_ix"), F.max("session_ix").alias("last_ix"), F.max_by("_gap", -c("session_ix")).alias("after_gap"))
    order = Window.partitionBy("instrument_id").orderBy("first_ix")
    follows = F.lead("first_ix").over(order)
    start = F.when(F.lag("last_ix").over(order).isNull(), "begins").when(c("after_gap"), "after_gap").otherwise("state_change")
    end = F.when(follows.isNull(), "ends").when(follows > c("last_ix") + 1, "before_gap").otherwise("state_change")
    return runs.select("instrument_id", *by, "first_ix", "last_ix", (c("last_ix") - c("first_ix") + 1).alias("length"), start.alias("starts"), end.alias("stops"))


def gaps(runs: DataFrame) -> DataFrame:
    """Sessions between two runs in which a listed instrument has no state, as intervals."""
    order = Window.partitionBy("instrument_id").orderBy("first_ix")
    rows = runs.select("instrument_id", (F.col("last_ix") + 1).alias("first_missing"), (F.lead("first_ix").over(order) - 1).alias("last_missing"))
    rows = rows.where("last_missing >= first_missing")
    return rows.withColumn("length", F.col("last_missing") - F.col("first_missing") + 1)


def coverage(runs: DataFrame) -> DataFrame:
    """Per instrument: sessions with a state, sessions from the first to the last, and by what disposition, from lengths alone."""
    c = F.col
    span = F.max("last_ix") - F.min("first_ix") + 1
    of = lambda d: F.sum(F.when(c("disposition") == d, c("length")).otherwise(0)).alias(d)
    return runs.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("length").alias("observed"), span.alias("span"), (F.sum("length") / span).alias("coverage"), *[of(d) for d in ("candidate_included", "candidate_excluded", "quarantined")])


def evidence_budget(targets: DataFrame, states: DataFrame, start: int, final: int) -> DataFrame:
    """Per security that needs official evidence: families, counts, and the most requests they may take.

    ``targets`` are the securities asked for (isolated: without a resolved identity, listed_ix); one without any state is listed too.
    """
    c = F.col
    per = states.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n_states"), F.count_if(~c("warning_status").isin("none", "unknown")).alias("n_warned"), F.count_if(c("warning_status") == "unknown").alias("n_warning_unknown"),
        F.count_if(c("trading_status") == "unknown").alias("n_trading_unknown"), F.count_if("factor_changed").alias("n_factor_changes"), F.max("session_ix").alias("last_ix"))
    t = targets.join(per, "instrument_id", "left").fillna(0, ["n_states", "n_warned", "n_warning_unknown", "n_trading_unknown", "n_factor_changes"])
    terminal = F.coalesce(c("last_ix") < final, F.lit(False))
    listing = c("isolated") | (c("listed_ix") >= start)
    t = t.withColumn("terminal_boundary", terminal).withColumn("listing_uncertain", listing)
    families = reasons((c("n_factor_changes") > 0, "corporate_action"), (c("isolated") | c("terminal_boundary") | (c("n_trading_unknown") > 0) | (c("n_states") == 0), "lifecycle"), (c("listing_uncertain"), "listing_stage"),
                       ((c("n_warned") > 0) | (c("n_warning_unknown") > 0), "risk_warning"))
    cost: Column = sum((F.array_contains("families", k).cast("int") * n for k, n in REQUESTS.items()), F.lit(0))
    return t.withColumn("families", families).where(F.size("families") > 0).withColumn("maximum_requests", cost).drop("last_ix")
