"""JOB-53: screening of factors as one chain, from session rank correlations to a decision for each trial.

``screened`` is the short form with one Holm family. ``paths``, ``horizon_results`` and ``screening_decisions`` are the registered
protocol: a primary horizon and two of decay, a partial correlation beside the plain one, Holm per role, selection under caps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.numeric import joined, reasons, rnd
from sessionloom.functions.staging import cut
from sessionloom.operators import aggregates as A
from sessionloom.operators import crosssection as X
from sessionloom.operators import windows as W
from sessionloom.plans.research import block_bootstrap, bootstrap_report

TRIAL = ["trial", "session_ix"]


def trials(panel: DataFrame, factors: list[str], horizons: tuple[int, ...]) -> DataFrame:
    """trial, session_ix, instrument_id, factor, target: each factor against the return of each horizon."""
    def ahead(h: int) -> Column:
        return F.when(F.lead("session_ix", h).over(W.BY) - F.col("session_ix") == h, F.lead("close", h).over(W.BY) / F.col("close") - 1)

    wide = panel.select("instrument_id", "session_ix", *factors, F.array(*[F.struct(F.lit(h).alias("h"), ahead(h).alias("target")) for h in horizons]).alias("_t"))
    tall = wide.select("instrument_id", "session_ix", *factors, F.explode("_t").alias("_t")).select("instrument_id", "session_ix", "_t.h", "_t.target", *factors)
    tall = A.unpivot(tall, ["instrument_id", "session_ix", "h", "target"], factors, value="factor")
    return tall.where("factor is not null and target is not null").select(F.concat_ws("|", "factor_id", "h").alias("trial"), "session_ix", "instrument_id", "factor", "target")


def screened(tall: DataFrame, replicates: int, block: int, seed: str, cost: float, floors: dict[str, float]) -> DataFrame:
    """One row per trial: mean rank correlation, its ratio and share above zero, bootstrap and Holm p values, net bucket spread, gates.

    ``cost`` is what one session's change of the top and the bottom bucket costs, as a return.
    """
    tall = cut(tall)
    ic = cut(A.rank_ic(tall, TRIAL, "factor", "target").where("ic is not null"))
    stats = ic.groupBy("trial").agg(F.count(F.lit(1)).alias("n_sessions"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_share"))
    boot = block_bootstrap(ic, "trial", "ic", replicates, block, seed)
    p = boot.groupBy("trial").agg(((F.count_if(F.col("boot") - F.col("mean") >= F.col("mean")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))
    means = X.rank_buckets(tall, "factor", TRIAL).groupBy(*TRIAL, "bucket").agg(F.avg("target").alias("m"))
    ends = means.groupBy(*TRIAL).agg((F.max(F.when(F.col("bucket") == 4, F.col("m"))) - F.max(F.when(F.col("bucket") == 0, F.col("m")))).alias("spread"))
    spread = ends.groupBy("trial").agg((F.avg("spread") - cost).alias("net_spread"))
    df = A.holm(stats.join(p, "trial").join(spread, "trial", "left"), "p_value", "trial").withColumn("ir", F.when(F.col("sd") > 0, F.col("mean_ic") / F.col("sd")))
    c = F.col
    failed = reasons((c("n_sessions") < floors["n_sessions"], "too_few_sessions"), (c("mean_ic") < floors["mean_ic"], "mean_ic_below_floor"), (c("positive_share") < floors["positive_share"], "sign_unstable"),
                     (c("p_holm") > floors["p_holm"], "not_significant_after_holm"), (F.coalesce(c("net_spread") <= 0, F.lit(True)), "no_spread_after_costs"))
    return df.withColumn("failed", joined(failed)).withColumn("decision", F.when(F.size(failed) == 0, "selected").otherwise("rejected")).drop("sd")


def paths(panel: DataFrame, registry: dict[str, tuple[str, str, int]], control: str, horizons: tuple[int, ...]) -> DataFrame:
    """factor_id, trial, session_ix, instrument_id, factor, target, control of each registered factor (role, related group, direction) and horizon.

    The factor is turned by its direction. Entry is the next session's open. The target is the return to the close of the horizon;
    for a risk guard, the deepest low on the way. A path with a missing session, price or factor takes no part.
    """
    def ahead(h: int, role: str) -> Column:
        entry = F.lead("open", 1).over(W.BY)
        lows = [F.lead("low", i).over(W.BY) for i in range(1, h + 1)]
        end = F.lead("close", h).over(W.BY) if role != "risk_guard" else F.least(*lows) if h > 1 else lows[0]
        return F.when(F.lead("session_ix", h).over(W.BY) - F.col("session_ix") == h, end / entry - 1)

    targets = {(role, h): ahead(h, role) for role in sorted({r for r, _, _ in registry.values()}) for h in horizons}
    names = {key: f"_t{i}" for i, key in enumerate(targets)}
    wide = panel.select("instrument_id", "session_ix", F.col(control).alias("control"), *registry, *[c.alias(names[k]) for k, c in targets.items()])
    cells = [F.struct(F.lit(f).alias("factor_id"), F.lit(f"{f}|{h}").alias("trial"), (F.col(f) * sign).alias("factor"), F.col(names[role, h]).alias("target")) for f, (role, _, sign) in registry.items() for h in horizons]
    return wide.select("instrument_id", "session_ix", "control", F.explode(F.array(*cells)).alias("_c")).select("_c.*", "instrument_id", "session_ix", "control").where("factor is not null and target is not null")


def horizon_results(tall: DataFrame, minimum: int, replicates: int, block: int, seed: str) -> DataFrame:
    """One row per trial: plain and partial session correlations with their bootstrap, halves, largest contribution, bucket order and spread."""
    tall = cut(tall)
    plain = A.rank_ic(tall, TRIAL, "factor", "target", minimum).where("ic is not null").select(*TRIAL, rnd("ic", 12).alias("ic"))  # an exact zero has no sign
    partial = A.partial_rank_ic(tall, TRIAL, "factor", "target", "control").where(F.col("n_obs") >= minimum).where("partial_ic is not null").select(*TRIAL, rnd("partial_ic", 12).alias("ic"))
    series = cut(plain.withColumn("kind", F.lit("standalone")).unionByName(partial.withColumn("kind", F.lit("partial"))).withColumn("series", F.concat_ws("|", "trial", "kind")))
    boot = bootstrap_report(cut(block_bootstrap(series, "series", "ic", replicates, block, seed)), "series")
    daily = series.where("kind = 'standalone'")
    by = Window.partitionBy("trial")  # a row a session
    c = F.col
    halves = daily.withColumn("_first", F.row_number().over(by.orderBy("session_ix")) <= F.floor(F.count(F.lit(1)).over(by) / 2))
    stats = halves.groupBy("trial").agg(
        F.count(F.lit(1)).alias("n_sessions"), F.avg((c("ic") > 0).cast("double")).alias("positive_share"), F.max(F.abs("ic")).alias("_max"), F.sum(F.abs("ic")).alias("_abs"),
        F.count_if("_first").alias("first_half"), F.avg(F.when(c("_first"), c("ic"))).alias("first_mean"), F.count_if(~c("_first")).alias("second_half"), F.avg(F.when(~c("_first"), c("ic"))).alias("second_mean"))
    stats = stats.withColumn("largest_share", F.when(c("_abs") > 0, c("_max") / c("_abs")).otherwise(0.0)).drop("_max", "_abs")
    means = X.rank_buckets(tall, "factor", TRIAL).groupBy(*TRIAL, "bucket").agg(F.avg("target").alias("m")).join(daily.select(*TRIAL), TRIAL, "left_semi")
    whole = means.groupBy(*TRIAL).agg(F.array_sort(F.collect_list(F.struct("bucket", "m"))).alias("_b")).where(F.size("_b") == 5)  # five buckets at most
    five = whole.groupBy("trial").agg(F.count(F.lit(1)).alias("bucket_sessions"), *[F.avg(c("_b")[k]["m"]).alias(f"b{k}") for k in range(5)])
    ms = F.array(*[c(f"b{k}") for k in range(5)])
    rank = lambda k: F.size(F.filter(ms, lambda x: x < c(f"b{k}"))) + (F.size(F.filter(ms, lambda x: x == c(f"b{k}"))) + 1) / 2.0
    five = five.withColumn("_r", F.array(*[rank(k) for k in range(5)]))
    dev = [(c("_r")[k] - 3.0) for k in range(5)]  # mid-ranks of five average three
    sxy, syy = sum((k - 2.0) * d for k, d in enumerate(dev)), sum(d * d for d in dev)
    five = five.select("trial", "bucket_sessions", (c("b4") - c("b0")).alias("spread"), F.when(syy > 0, sxy / F.sqrt(10.0 * syy)).alias("monotonic"))
    out = stats
    for kind, prefix in (("standalone", ""), ("partial", "partial_")):
        one = boot.where(c("series").endswith(f"|{kind}")).select(F.regexp_replace("series", r"\|[a-z]+$", "").alias("trial"), *[c(x).alias(prefix + y) for x, y in (("mean", "mean_ic"), ("lower", "lower"), ("upper", "upper"), ("p_value", "p_value"))])
        out = out.join(one, "trial", "left")
    n = series.where("kind = 'partial'").groupBy("trial").agg(F.count(F.lit(1)).alias("partial_sessions"))
    return out.join(n, "trial", "left").join(five, "trial", "left").withColumns({k: F.coalesce(c(k), F.lit(0)) for k in ("partial_sessions", "bucket_sessions")})


def screening_decisions(results: DataFrame, registry: dict[str, tuple[str, str, int]], primary: int, decay: tuple[int, ...], p: dict[str, float], caps: dict[str, int]) -> DataFrame:
    """One row per registered factor: worst p value, Holm within its role, worst effect and bound, failed gates, status.

    A factor without a numeric result stays in its family with p = 1. A risk guard is selected only beside a selected alpha; no two
    selected factors share a related group.
    """
    c, spark = F.col, results.sparkSession
    reg = spark.createDataFrame([(f, role, group) for f, (role, group, _) in registry.items()], "factor_id string, role string, related string")
    r = results.withColumns({"factor_id": F.split("trial", r"\|")[0], "h": F.split("trial", r"\|")[1].cast("int")})
    late = r.where(c("h").isin(*decay)).groupBy("factor_id").agg(F.count("mean_ic").alias("_n_decay"), F.min("mean_ic").alias("_decay"))
    df = cut(reg.join(r.where(c("h") == primary), "factor_id", "left").join(late, "factor_id", "left"))
    worst = {"raw": F.greatest("p_value", "partial_p_value"), "effect": F.least("mean_ic", "partial_mean_ic"), "bound": F.least("lower", "partial_lower")}  # nulls are skipped
    df = A.holm(df.withColumns(worst).withColumn("_p", F.coalesce("raw", F.lit(1.0))), "_p", "factor_id", ["role"])
    no = lambda ok: F.coalesce(~ok, F.lit(True))
    failed = F.array_sort(reasons(
        (no(c("mean_ic") >= p["mean_ic"]), "primary_mean_rank_ic"), (no(c("lower") > 0), "primary_rank_ic_lower_bound"), (no(c("partial_mean_ic") >= p["partial_ic"]), "incremental_mean_partial_rank_ic"),
        (no(c("partial_lower") > 0), "incremental_partial_rank_ic_lower_bound"), (no(c("positive_share") >= p["positive_share"]), "positive_session_share"), (no(c("largest_share") <= p["largest_share"]), "session_contribution_concentration"),
        (no(c("first_mean") > 0), "first_half_direction"), (no(c("second_mean") > 0), "second_half_direction"), (no(c("monotonic") >= p["monotonic"]), "bucket_monotonicity"), (no(c("spread") > 0), "bucket_top_minus_bottom"),
        (no((c("_n_decay") == len(decay)) & (c("_decay") >= p["decay"])), "decay_direction"), (c("p_holm") > p["alpha"], "holm_familywise_significance")))
    thin = (F.coalesce("n_sessions", F.lit(0)) < p["sessions"]) | (F.coalesce("first_half", F.lit(0)) < p["half"]) | (F.coalesce("second_half", F.lit(0)) < p["half"]) | (F.coalesce("partial_sessions", F.lit(0)) < p["sessions"])
    df = df.withColumns({"_failed": failed, "_thin": thin}).withColumn("_ok", (F.size("_failed") == 0) & ~c("_thin"))
    order = [F.desc("effect"), F.desc("bound"), "factor_id"]

    def chosen(role: str, free: Column) -> Column:
        """The best of each free group, the best of those under the role's cap."""
        here = c("_ok") & (c("role") == role) & free
        first = F.row_number().over(Window.partitionBy("related", here).orderBy(*order)) == 1
        return here & first, caps[role]

    for role, flag, free in (("candidate_alpha", "_alpha", F.lit(True)), ("risk_guard", "_guard", (F.size("_groups") > 0) & ~F.array_contains("_groups", c("related")))):
        lead, cap = chosen(role, free)
        df = df.withColumn("_lead", lead).withColumn(flag, c("_lead") & (F.row_number().over(Window.partitionBy("_lead").orderBy(*order)) <= cap))
        if role == "candidate_alpha":
            df = df.withColumn("_groups", F.collect_set(F.when(c("_alpha"), c("related"))).over(Window.partitionBy()))  # registered factors only
    status = (F.when(c("_thin"), "inconclusive_data").when(F.size("_failed") > 0, "rejected_screen").when(c("_alpha") | c("_guard"), "selected_model_candidate").otherwise("qualified_not_selected_cap"))
    return df.select("factor_id", "role", "related", status.alias("status"), "raw", F.col("p_holm"), "effect", "bound", joined(c("_failed")).alias("failed"))
