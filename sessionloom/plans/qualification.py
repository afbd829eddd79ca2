"""JOB-48: factor diagnostics from mergeable accumulators, and the qualification decisions that follow from them.

A block of sessions folds into four small-grained tables. Blocks are only ever added: session rows and session correlations
of different blocks stand beside each other, value and instrument counts add up. So a further session needs its own rows
alone, and what was published for the sessions before is read, not computed again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.numeric import joined, ratio, reasons
from sessionloom.functions.staging import cut
from sessionloom.operators import aggregates as A
from sessionloom.plans.research import session_spearman
from sessionloom.sources.families import Family, publish, read

ID = ["instrument_id", "session_ix"]
#: Tables of a block. ``block`` names the sessions that were folded together.
FAMILIES = {
    "sessions": Family("factor_sessions", "block string, factor_id string, session_ix long, expected long, available long, tie_excess long", ("block",), ("factor_id", "session_ix"), ()),
    "values": Family("factor_values", "block string, factor_id string, value double, n long", ("block",), ("factor_id", "value"), ()),
    "instruments": Family("factor_instruments", "block string, factor_id string, instrument_id long, n long", ("block",), ("factor_id", "instrument_id"), ()),
    "pairs": Family("factor_pairs", "block string, left_id string, right_id string, session_ix long, n long, rho double", ("block",), ("left_id", "right_id", "session_ix"), ()),
}


def fold(panel: DataFrame, factors: list[str], minimum: int, block: str = "all") -> dict[str, DataFrame]:
    """Accumulators of a block: every row of ``panel`` is an expected path, a null factor is unavailable there.

    ``minimum`` is the number of instruments that a session needs for a pair's correlation. NaN counts as unavailable.
    """
    panel = cut(panel.select(*ID, *[F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f) for f in factors]))
    tall = A.unpivot(panel, ID, factors)
    counts = cut(tall.groupBy("factor_id", "session_ix", "value").agg(F.count(F.lit(1)).alias("n")))
    known = F.col("value").isNotNull()
    available = F.sum(F.when(known, F.col("n")).otherwise(0))
    name = F.lit(block).alias("block")
    return {
        "sessions": counts.groupBy("factor_id", "session_ix").agg(F.sum("n").alias("expected"), available.alias("available"), (available - F.count("value")).alias("tie_excess")).select(name, "*"),
        "values": counts.where(known).groupBy("factor_id", "value").agg(F.sum("n").alias("n")).select(name, "*"),
        "instruments": tall.where(known).groupBy("factor_id", "instrument_id").agg(F.count(F.lit(1)).alias("n")).select(name, "*"),
        "pairs": session_spearman(panel, factors, minimum).where("rho is not null").select(name, F.split("pair_id", "/")[0].alias("left_id"), F.split("pair_id", "/")[1].alias("right_id"), "session_ix", F.col("n_pairs").alias("n"), "rho"),
    }


def publish_block(state: dict[str, DataFrame], root: str) -> None:
    """Add a block to the published accumulators; a block that is there already with the same content changes nothing."""
    for key, family in FAMILIES.items():
        refused = publish(state[key], root, family).where("action in ('conflict', 'invalid')").count()
        if refused:
            raise ValueError(f"{family.name}: {refused} block(s) differ from what is published")


def published(spark, root: str) -> dict[str, DataFrame]:
    """Accumulators of all published blocks."""
    return {key: read(spark, root, family) for key, family in FAMILIES.items()}


def merged(states: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Accumulators of several blocks that share no session."""
    return {key: reduce(DataFrame.unionByName, [s[key] for s in states]) for key in FAMILIES}


def coverage(state: dict[str, DataFrame], minimum: int) -> DataFrame:
    """Per factor: expected and available paths, sessions of at least ``minimum`` instruments, all and by half of the calendar."""
    by = Window.partitionBy("factor_id")  # a row a session
    s = state["sessions"].withColumn("_i", F.row_number().over(by.orderBy("session_ix")) - 1).withColumn("_first", F.col("_i") < F.floor(F.count(F.lit(1)).over(by) / 2))
    enough = F.col("available") >= minimum
    total = s.groupBy("factor_id").agg(
        F.sum("expected").alias("expected"), F.sum("available").alias("available"), F.count_if(enough).alias("eligible_sessions"), F.count_if(enough & F.col("_first")).alias("first_half"),
        F.count_if(enough & ~F.col("_first")).alias("second_half"), F.sum("tie_excess").alias("tie_excess"))
    return total.withColumns({"availability": ratio("available", "expected"), "tie_rate": ratio("tie_excess", "available")})


def diagnostics(state: dict[str, DataFrame], minimum: int) -> DataFrame:
    """Coverage, distribution and concentration of each factor, from the accumulators alone."""
    counts = cut(state["values"].groupBy("factor_id", F.col("value").alias("_v")).agg(F.sum("n").alias("_n")))
    spread = A.distribution_of_counts(counts, ["factor_id"]).drop("tie_excess", "n")
    out = coverage(state, minimum).join(spread, "factor_id", "left")
    axes = {"session": state["sessions"].where("available > 0").select("factor_id", "session_ix", F.col("available").alias("_n")),
            "instrument": state["instruments"].groupBy("factor_id", "instrument_id").agg(F.sum("n").alias("_n"))}
    for axis, parts in axes.items():
        c = A.concentration_of_counts(parts, ["factor_id"], "session_ix" if axis == "session" else "instrument_id")
        out = out.join(c.select("factor_id", *[F.col(x).alias(f"{axis}_{x}") for x in ("n_parts", "max_share", "top_share", "herfindahl")]), "factor_id", "left")
    return out


def pair_report(state: dict[str, DataFrame], factors: list[str], rule: dict[str, float]) -> DataFrame:
    """Each pair of factors over its sessions: mean and quantiles of the rank correlation, shares, and whether one repeats the other."""
    spark = state["pairs"].sparkSession
    named = spark.createDataFrame([(a, b) for i, a in enumerate(factors) for b in factors[i + 1:]], "left_id string, right_id string")
    rho, n = F.col("rho"), F.count("rho")
    q = F.percentile("rho", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))  # one value a session
    seen = state["pairs"].groupBy("left_id", "right_id").agg(
        n.alias("n_sessions"), F.sum("n").alias("n_shared"), (F.sum(rho * F.col("n")) / F.sum("n")).alias("weighted_mean"), q.alias("_q"),
        F.count_if(F.abs(rho) >= rule["correlation"]).alias("n_high"), F.count_if(rho > 0).alias("n_positive"), F.count_if(rho < 0).alias("n_negative"))
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_sessions", "n_shared", "n_high", "n_positive", "n_negative")}
    df = named.join(seen, ["left_id", "right_id"], "left").withColumns(counts)
    df = df.withColumns({"p05": F.col("_q")[0], "median": F.col("_q")[1], "p95": F.col("_q")[2], "n_zero": F.col("n_sessions") - F.col("n_positive") - F.col("n_negative"),
                         "high_share": ratio("n_high", "n_sessions"), "sign_share": ratio(F.greatest("n_positive", "n_negative"), F.col("n_positive") + F.col("n_negative"))})
    same = (F.col("n_sessions") >= rule["sessions"]) & (F.col("high_share") >= rule["share"]) & (F.col("sign_share") >= rule["sign"])
    return df.withColumn("near_duplicate", F.coalesce(same, F.lit(False))).drop("_q")


def _components(edges: Column, k: int) -> Column:
    """For factors 0..k-1 the smallest factor that near-duplicate edges (arrays of structs a, b) connect them with."""
    def spread(labels, _):
        def lowest(label, i):
            touching = F.filter(edges, lambda e: (e.a == i) | (e.b == i))
            return F.array_min(F.concat(F.array(label), F.transform(touching, lambda e: F.least(F.get(labels, e.a), F.get(labels, e.b)))))

        return F.transform(labels, lowest)

    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.sequence(F.lit(0), F.lit(k - 1)), spread)


def decisions(state: dict[str, DataFrame], registry: dict[str, tuple[str, str, int]], minimum: int, floors: dict[str, float], rule: dict[str, float]) -> DataFrame:
    """One row per registered factor (role, related group, priority): decision, reasons, what it repeats, and the status of the whole.

    Within a related group the factor of the higher number in priority gives way (of several that it repeats, the last in the
    registry is named). A near duplicate across groups rejects nobody and holds the whole back for review.
    """
    spark, names = state["values"].sparkSession, list(registry)
    c = F.col
    reg = spark.createDataFrame([(f, i, *registry[f]) for i, f in enumerate(names)], "factor_id string, ix int, role string, related string, priority int")
    pairs = pair_report(state, names, rule).where("near_duplicate").select("left_id", "right_id")
    side = lambda p: reg.select(F.col("factor_id").alias(f"{p}_id"), *[F.col(x).alias(f"{p}_{x}") for x in ("ix", "related", "priority")])
    near = cut(pairs.join(side("left"), "left_id").join(side("right"), "right_id"))
    left_wins = F.struct("left_priority", "left_id") < F.struct("right_priority", "right_id")
    within = near.where("left_related = right_related").select(
        F.when(left_wins, c("right_id")).otherwise(c("left_id")).alias("factor_id"), F.when(left_wins, c("left_id")).otherwise(c("right_id")).alias("kept"), "left_ix", "right_ix")
    repeats = within.groupBy("factor_id").agg(F.max_by("kept", F.struct("left_ix", "right_ix")).alias("repeats"))
    across = near.where("left_related <> right_related").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", "left_id", "right_id"))), "|").alias("across_groups"))
    edges = near.agg(F.collect_list(F.struct(c("left_ix").alias("a"), c("right_ix").alias("b"))).alias("edges")).select(_components(c("edges"), len(names)).alias("component"))
    distinct = state["values"].groupBy("factor_id", "value").agg(F.sum("n").alias("n")).groupBy("factor_id").agg(F.count(F.lit(1)).alias("n_distinct"))
    df = reg.join(coverage(state, minimum), "factor_id", "left").join(distinct, "factor_id", "left").join(repeats, "factor_id", "left")
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    failed = F.array_sort(reasons(
        (zero("availability") < floors["availability"], "availability_below_floor"), (zero("eligible_sessions") < floors["sessions"], "eligible_sessions_below_floor"),
        (zero("first_half") < floors["half"], "first_half_sessions_below_floor"), (zero("second_half") < floors["half"], "second_half_sessions_below_floor"),
        (zero("n_distinct") < floors["distinct"], "distinct_values_below_floor"), (zero("tie_rate") > floors["ties"], "same_session_ties_above_ceiling"),
        (c("repeats").isNotNull(), "lower_priority_within_group_near_duplicate")))
    df = A.attach_one_row(A.attach_one_row(df.withColumn("_failed", failed), across), edges)
    df = df.withColumns({"failed": joined(c("_failed")), "decision": F.when(F.size("_failed") == 0, "eligible").otherwise("rejected"), "component": F.element_at(F.array(*map(F.lit, names)), F.get("component", c("ix")) + 1)})
    alphas = df.agg(F.count_if((c("decision") == "eligible") & (c("role") == "candidate_alpha")).alias("_alphas"))
    df = A.attach_one_row(df, alphas)
    status = F.when(c("_alphas") < floors["alphas"], "too_few_candidate_alphas").when(c("across_groups") != "", "cross_group_review").otherwise("ready")
    return df.withColumn("status", status).select("factor_id", "role", "related", "decision", "failed", "repeats", "component", "across_groups", "status")
