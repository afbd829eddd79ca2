"""State-interaction screening (JOB-54): does a factor's session rank correlation rise with a market state?

Every hypothesis meets each horizon and endpoint as a trial. Ranks of all trials come from one pass over one long table; what remains is one number per trial and
session. Slopes of halves are aggregates; two block lengths share one set of draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.numeric import reasons
from sessionloom.functions.ranking import quantiles
from sessionloom.functions.staging import cut
from sessionloom.operators.aggregates import chronological_halves, holm, rank_ic
from sessionloom.params.interaction import ALPHA, BLOCKS, ENDPOINTS, HORIZONS, HYPOTHESES, INCONCLUSIVE, MAXIMUM_SELECTED, MINIMUM_FAVOURABLE, MINIMUM_HALF, MINIMUM_SESSIONS, PRIMARY_HORIZON, REPLICATES
from sessionloom.plans.research import slope_bootstraps

TRIAL = ["hypothesis", "role", "horizon", "endpoint"]


def _transformed(metric: str, transform: str) -> Column:
    x = F.col(metric)
    return {"as_defined": x, "negated": -x, "centred_share": 2 * (x - 0.5)}[transform]


def evidence(factors: DataFrame, labels: DataFrame, states: DataFrame, sessions: DataFrame, minimum_instruments: int) -> DataFrame:
    """One row per trial and development session: rank correlation of factor and target, state, half.

    Targets of candidate alphas are the bounds of the relative return, those of risk guards the adverse excursion of exactly observed paths.
    """
    c = F.col
    wanted = [(h, r, f, sign, e) for h, (r, f, sign, *_) in HYPOTHESES.items() for e in ENDPOINTS[r]]
    target = {"lower": c("rel_lower"), "upper": c("rel_upper"), "complete_path": F.when(c("state") == "observed_eod_exact", c("adverse"))}
    used = sorted({f for _, f, *_ in HYPOTHESES.values()})
    rows = factors.select("instrument_id", "session_ix", *used).join(sessions.select("session_ix"), "session_ix").join(labels, ["instrument_id", "session_ix"])
    rows = rows.select("session_ix", *used, F.inline("labels"))
    sides = F.array(*[F.struct(F.lit(h).alias("hypothesis"), F.lit(r).alias("role"), F.lit(e).alias("endpoint"), (c(f) * sign).alias("x"), target[e].alias("y")) for h, r, f, sign, e in wanted])
    tall = rows.select("session_ix", "horizon", F.inline(F.filter(sides, lambda s: s["x"].isNotNull() & s["y"].isNotNull())))
    ic = rank_ic(cut(tall), [*TRIAL, "session_ix"], "x", "y").where((c("n_obs") >= minimum_instruments) & c("ic").isNotNull())
    moods = F.array(*[F.struct(F.lit(h).alias("hypothesis"), _transformed(m, tr).alias("state")) for h, (_, _, _, m, tr) in HYPOTHESES.items()])
    moods = states.select("session_ix", F.inline(moods)).where("state is not null")
    return ic.join(moods, ["session_ix", "hypothesis"]).join(chronological_halves(sessions), "session_ix").select(*TRIAL, "session_ix", "n_obs", "state", "ic", "half")


def _slope(cond: Column | None = None) -> Column:
    x, y = (F.col("state"), F.col("ic")) if cond is None else (F.when(cond, F.col("state")), F.when(cond, F.col("ic")))
    return F.when(F.min(x) < F.max(x), F.try_divide(F.covar_pop(y, x), F.var_pop(x)))


def summaries(ev: DataFrame, replicates: int = REPLICATES, seed: str = "interaction-v1") -> DataFrame:
    """One row per trial: regression, bootstrap of both block lengths, slopes of the halves, favourable sessions, reason codes.

    A trial without sessions has a row too.
    """
    c, ev = F.col, cut(ev)
    favourable = c("state") > 0
    first = c("half") == "first"
    s = ev.groupBy(*TRIAL).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(first).alias("n_first"), F.count_if(~first).alias("n_second"), _slope().alias("beta"), F.avg("ic").alias("_ic"), F.avg("state").alias("_state"), _slope(first).alias("first_beta"),
        _slope(~first).alias("second_beta"), F.count_if(favourable).alias("n_favourable"), F.avg(F.when(favourable, c("ic"))).alias("favourable_ic"))
    trials = [(h, r, k, e) for h, (r, *_) in HYPOTHESES.items() for k in HORIZONS for e in ENDPOINTS[r]]
    every = ev.sparkSession.createDataFrame(trials, "hypothesis string, role string, horizon int, endpoint string")
    s = every.join(s, TRIAL, "left").fillna(0, ["n", "n_first", "n_second", "n_favourable"])
    series = ev.select(F.concat_ws("|", "hypothesis", "horizon", "endpoint").alias("trial"), "session_ix", "state", "ic")
    boot = cut(slope_bootstraps(series, "trial", "state", "ic", replicates, BLOCKS, seed))
    beyond = F.count_if(c("boot") - c("slope") >= c("slope"))
    p = boot.groupBy("trial", "asked").agg(((beyond + 1) / (F.count(F.lit(1)) + 1)).alias("p"), (F.count("boot") == F.count(F.lit(1))).alias("whole"))
    p = p.join(quantiles(boot, ["trial", "asked"], "boot", {"lower": 0.1}).drop("n_group"), ["trial", "asked"], "left")
    wide = p.groupBy("trial").agg(F.min("whole").alias("whole"), *[F.max(F.when(c("asked") == b, c(x))).alias(f"{x}_{b}") for b in BLOCKS for x in ("lower", "p")])
    s = s.withColumn("trial", F.concat_ws("|", "hypothesis", "horizon", "endpoint")).join(wide, "trial", "left").drop("trial")
    ready = F.coalesce(c("whole") & c("beta").isNotNull() & c("first_beta").isNotNull() & c("second_beta").isNotNull() & (c("n") >= 2), F.lit(False))
    alpha = c("role") == "candidate_alpha"
    s = s.withColumn("ready", ready).withColumn("n_favourable", F.when(alpha, c("n_favourable"))).withColumn("favourable_ic", F.when(ready & alpha, c("favourable_ic"))).withColumn("intercept", F.when(ready, c("_ic") - c("beta") * c("_state")))
    for name in ("beta", "first_beta", "second_beta", *[f"{x}_{b}" for b in BLOCKS for x in ("lower", "p")]):
        s = s.withColumn(name, F.when(c("ready"), c(name)))
    codes = reasons((c("n") < MINIMUM_SESSIONS, INCONCLUSIVE[0]), (c("n_first") < MINIMUM_HALF, INCONCLUSIVE[1]), (~c("ready"), INCONCLUSIVE[2]), (c("n_second") < MINIMUM_HALF, INCONCLUSIVE[3]))
    return s.withColumn("codes", codes).drop("_ic", "_state", "whole", "ready")


def decisions(table: DataFrame) -> DataFrame:
    """One row per hypothesis from its primary horizon: worst p, Holm within the role, failed gates, selection of at most one of each role; a guard needs an alpha."""
    c = F.col
    p = table.where(c("horizon") == PRIMARY_HORIZON)
    low = lambda x: F.coalesce(x <= 0, F.lit(True))
    alpha = c("role") == "candidate_alpha"
    a, b = BLOCKS
    failed = reasons((low(c("beta")), "interaction_beta_not_positive"), (low(c(f"lower_{a}")), "primary_block_lower_bound_not_positive"), (low(c(f"lower_{b}")), "sensitivity_block_lower_bound_not_positive"),
                     (low(c("first_beta")), "first_half_beta_not_positive"), (low(c("second_beta")), "second_half_beta_not_positive"), (alpha & (c("n_favourable") < MINIMUM_FAVOURABLE), "alpha_favorable_state_session_floor_not_met"),
                     (alpha & low(c("favourable_ic")), "alpha_favorable_state_mean_rank_ic_not_positive"))
    worst = lambda x: F.when(F.count(x) == F.count(F.lit(1)), F.min(x))
    g = p.withColumn("_f", F.concat("codes", failed)).groupBy("hypothesis", "role").agg(
        F.count(F.lit(1)).alias("n_endpoints"), F.coalesce(F.when(F.count(c(f"p_{a}") + c(f"p_{b}")) == F.count(F.lit(1)), F.max(F.greatest(f"p_{a}", f"p_{b}"))), F.lit(1.0)).alias("raw_p"), worst(c("beta")).alias("worst_beta"),
        worst(F.least(f"lower_{a}", f"lower_{b}")).alias("worst_lower"), F.array_distinct(F.flatten(F.collect_list("_f"))).alias("_f"))
    g = holm(g, "raw_p", "hypothesis", ["role"])
    g = g.withColumn("failed", F.array_sort(F.concat("_f", F.array_compact(F.array(F.when(c("p_holm") > ALPHA, F.lit("holm_familywise_gate_failed"))))))).drop("_f")
    passed = F.size("failed") == 0
    by = Window.partitionBy("role", passed).orderBy(F.desc("worst_beta"), F.desc("worst_lower"), "hypothesis")
    top = passed & (F.row_number().over(by) <= MAXIMUM_SELECTED)
    g = g.withColumn("_top", top).withColumn("_alpha", F.max(c("_top") & alpha).over(Window.partitionBy()))
    selected = c("_top") & (alpha | c("_alpha"))
    status = F.when(selected, "selected_model_candidate").when(passed, "qualified_not_selected_cap").when(F.arrays_overlap("failed", F.array(*[F.lit(x) for x in INCONCLUSIVE])), "inconclusive_data").otherwise("rejected_screen")
    return g.select("hypothesis", "role", "n_endpoints", "raw_p", "p_holm", "worst_beta", "worst_lower", "failed", status.alias("status"))
