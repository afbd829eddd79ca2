"""Research plans: chronological splits, cohorts, labels, factors, screening, inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.staging import cut
from sessionloom.operators.filters import split_usability


def split_plan(sessions: DataFrame, warmup: int, horizon: int, purge: int, embargo: int) -> DataFrame:
    """JOB-56: 50 / 25 / 25 split of the calendar with warm-up, purge and embargo (one row per session)."""
    by = Window.orderBy("session_ix")
    s = sessions.select("session_ix", (F.row_number().over(by) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    v = F.floor(F.col("n") / 2)
    h = v + F.floor(F.col("n") / 4)
    codes = split_usability(F.col("i"), F.col("n"), warmup, horizon, purge, embargo)
    return s.select(
        "session_ix",
        F.when(F.col("i") < v, "development").when(F.col("i") < h, "validation").otherwise("holdout").alias("split"),
        codes.alias("codes"),
        (F.size(codes) == 0).alias("usable"),
    )


def session_spearman(panel: DataFrame, factors: list[str], minimum: int) -> DataFrame:
    """session_ix, pair_id, n_pairs, rho: rank correlation of every factor pair in each session that has ``minimum`` rows of both.

    Ranks depend on which rows a pair shares, so each pair is a group of its own in one long table:
    all pairs are ranked in one pass.
    """
    from sessionloom.functions.ranking import with_midranks
    from sessionloom.operators.aggregates import pearson

    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1:]]
    legs = F.array(*[F.struct(F.lit(f"{a}/{b}").alias("pair_id"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])
    tall = panel.select("session_ix", F.explode(legs).alias("_p")).select("session_ix", "_p.*").where("x is not null and y is not null")
    by = ["session_ix", "pair_id"]
    n, rho = pearson("rx", "ry", minimum)
    per = with_midranks(tall, by, {"rx": "x", "ry": "y"}).groupBy(*by).agg(n, rho.alias("rho"))
    return per.where(F.col("n_pairs") >= minimum)


def pairwise_spearman(panel: DataFrame, factors: list[str], minimum: int, threshold: float) -> DataFrame:
    """AGG-24: same-session rank correlation of every factor pair, averaged over sessions."""
    return session_spearman(panel, factors, minimum).groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n_sessions"), F.avg("rho").alias("mean_rho"), (F.abs(F.avg("rho")) >= threshold).alias("near_duplicate"))


def return_statistics(df: DataFrame, value: str, costs: list[int], by: list[str]) -> DataFrame:
    """AGG-29: win rate, average win / loss, payoff and profit factor, net of each cost in basis points."""
    from sessionloom.functions.numeric import ratio

    net = df.select("*", F.explode(F.array(*[F.lit(c) for c in costs])).alias("cost")).withColumn("_x", F.col(value) - F.col("cost") / 10000.0)
    x = F.col("_x")
    win, loss = F.when(x > 0, x), F.when(x < 0, x)
    return net.groupBy(*by, "cost").agg(
        F.count(F.lit(1)).alias("n"), F.avg((x > 0).cast("double")).alias("win_rate"), F.avg(win).alias("average_win"), F.avg(loss).alias("average_loss"),
        ratio(F.avg(win), F.abs(F.avg(loss))).alias("payoff"), ratio(F.sum(win), F.abs(F.sum(loss))).alias("profit_factor"), F.avg(x).alias("mean"))


def forward_labels(bars: DataFrame, bench: DataFrame, horizons=(1, 3, 5)) -> DataFrame:
    """JOB-51: enter at the next open, leave at the close h sessions ahead; relative return and excursions.

    A horizon that passes the last bar, or meets a gap, is pending and stays null.
    """
    from sessionloom.operators import windows as W

    df = W.versus_benchmark(bars, bench)
    by = W.BY

    def ahead(x, k):
        return F.when(F.lead("session_ix", k).over(by) - F.col("session_ix") == k, F.lead(x, k).over(by))

    out = []
    for h in horizons:
        own = ahead("close", h) / ahead("open", 1) - 1
        mkt = ahead("b_close", h) / ahead("b_open", 1) - 1
        span = by.rowsBetween(1, h)
        known = ahead("close", h).isNotNull()
        out += [own.alias(f"ret{h}"), (own - mkt).alias(f"rel{h}"),
                F.when(known, F.max("high").over(span) / ahead("open", 1) - 1).alias(f"mfe{h}"),
                F.when(known, F.min("low").over(span) / ahead("open", 1) - 1).alias(f"mae{h}"),
                F.when(known, "mature").otherwise("pending").alias(f"state{h}")]
    return df.select("instrument_id", "session_ix", *out)


def factor_catalog(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """JOB-46: the twelve first-generation factors of a 21-session window."""
    from sessionloom.functions.numeric import ratio, sorted_middle
    from sessionloom.operators import windows as W

    df = W.path_shape(W.average_true_range(W.versus_benchmark(bars, bench)))
    c = F.col
    ok = W.contiguous(21)
    span = lambda x, a, z: F.log((c(x) if z == 0 else W.lagged(x, z)) / W.lagged(x, a))
    rel = lambda a, z: span("close", a, z) - span("b_close", a, z)
    df = df.withColumn("_dv", c("close") * c("volume"))
    prior_high = F.max("close").over(W.rows(20, 1))
    ten = lambda agg: agg.over(W.rows(10, 1))
    path = F.collect_list("close").over(W.rows(11))
    df = df.select("*", ok.alias("_ok"), path.alias("_path"), sorted_middle(F.collect_list("_dv").over(W.rows(20, 1))).alias("_mdv"), prior_high.alias("_ph"),
                   (ten(F.max("close")) - ten(F.min("close"))).alias("_range10"), (c("open") - W.lagged("close", 1)).alias("_gap"),
                   rel(20, 0).alias("_rel20"), (rel(5, 0) - rel(20, 5) / 3).alias("_acc"))
    when = lambda x: F.when(c("_ok"), x)
    return df.select(
        "instrument_id", "session_ix",
        when(c("_rel20")).alias("relative_return_20"), when(c("_acc")).alias("relative_acceleration"),
        when(c("path_efficiency")).alias("signed_path_efficiency"), when(c("largest_share")).alias("largest_return_share"), when(c("positive_share")).alias("positive_share"),
        when(ratio("atr5_prior", "atr14_prior")).alias("atr_ratio_5_14"), when(ratio("_range10", "atr14_prior")).alias("prior_range_atr"),
        when(ratio(c("close") - c("_ph"), "atr14_prior")).alias("close_vs_prior_high_atr"), when(ratio(F.abs("_gap"), "atr14_prior")).alias("gap_atr"),
        when(ratio("_dv", "_mdv")).alias("dollar_volume_surprise"), when(ratio(c("close") - c("low"), c("high") - c("low"))).alias("close_location"),
        when(W._fold_drawdown(c("_path"), False)).alias("max_drawdown"))


#: Values of block sums that may be broadcast after they have been counted, some ten megabytes.
BROADCAST_VALUES = 500_000


def with_replicates(sums: DataFrame, keys: list[str], replicates: int) -> DataFrame:
    """``sums`` (one row of block sums per ``keys``) beside each replicate. Ids are spread before they meet the sums, so what is shuffled per replicate is a number.

    The sums are counted; within the bound they are broadcast, beyond it they are joined.
    """
    sums = cut(sums)
    ids = sums.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).repartition(*keys, "rep")
    small = (sums.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_VALUES
    return ids.join(F.broadcast(sums) if small else sums, keys)


def block_bootstrap(series: DataFrame, trial: str, value: str, replicates: int, block: int, seed: str) -> DataFrame:
    """INF-01: circular block bootstrap of the mean of a session series, draws from a hash.

    A series has one value per session, so it travels as an array; replicates are spread over tasks. A block is never
    longer than the series.
    """
    one = series.groupBy(trial).agg(F.transform(F.array_sort(F.collect_list(F.struct("session_ix", F.col(value).alias("v")))), lambda x: x["v"]).alias("a"))
    one = one.withColumn("n", F.size("a")).withColumn("block", F.least(F.lit(block), F.col("n"))).withColumn("mean", F.aggregate("a", F.lit(0.0), lambda s, x: s + x) / F.col("n"))

    def sums(length):
        return F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda s: F.aggregate(
            F.sequence(s, s + length - 1), F.lit(0.0), lambda acc, j: acc + F.get(F.col("a"), j % F.col("n"))))

    rest = F.col("n") % F.col("block")
    one = one.select(trial, "n", "block", "mean", sums(F.col("block")).alias("full"), F.when(rest > 0, sums(rest)).alias("tail"))
    reps = with_replicates(one, [trial], replicates)

    def start(k):
        key = F.concat_ws("|", F.lit(seed), F.col(trial), F.col("rep"), k)
        return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % F.col("n")).cast("int")

    whole = F.floor(F.col("n") / F.col("block")).cast("int")
    body = F.aggregate(F.sequence(F.lit(0), whole - 1), F.lit(0.0), lambda acc, k: acc + F.get("full", start(k)))
    total = body + F.when(F.col("n") % F.col("block") > 0, F.get("tail", start(whole))).otherwise(0.0)
    return reps.select(trial, "rep", "n", "mean", (total / F.col("n")).alias("boot"))


def bootstrap_report(boot: DataFrame, trial: str) -> DataFrame:
    """5 / 95 percent quantiles and the centred one-sided p value (exceed + 1) / (R + 1)."""
    from sessionloom.functions.ranking import quantiles

    q = quantiles(boot, [trial], "boot", {"lower": 0.05, "upper": 0.95}).drop("n_group")
    p = boot.groupBy(trial).agg(F.max("mean").alias("mean"), F.count(F.lit(1)).alias("r"), F.count_if(F.col("boot") - F.col("mean") >= F.col("mean")).alias("exceed"))
    return p.join(q, trial).select(trial, "mean", "lower", "upper", ((F.col("exceed") + 1) / (F.col("r") + 1)).alias("p_value"))


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """INF-03: compare each metric with its registered threshold."""
    j = metrics.join(thresholds, "metric", "right")
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return j.withColumn("outcome", F.when(F.col("value").isNull(), "inconclusive").when(ok, "pass").otherwise("fail"))


GRID = {"leadership_gate": ["rs80", "rs60"], "depth_band": ["shallow", "deep"], "recovery": ["close", "high"], "volume_cap": [0.8, 1.0, 1.2]}


def parameter_grid() -> list[dict]:
    """UDF-05: the 24 registered combinations."""
    from itertools import product

    return [dict(zip(GRID, v)) for v in product(*GRID.values())]


def cohorts(features: DataFrame) -> DataFrame:
    """JOB-57: role of every observation under each combination (an exploded literal array, no join)."""
    from sessionloom.operators.filters import cohort_role

    c = F.col
    roles = []
    for i, g in enumerate(parameter_grid()):
        floor = 80.0 if g["leadership_gate"] == "rs80" else 60.0
        depth = c("depth").between(0.0, 1.0) if g["depth_band"] == "shallow" else c("depth").between(1.0, 3.0)
        rec = c("above_prior_close") if g["recovery"] == "close" else c("above_prior_high")
        roles.append(F.struct(F.lit(i).alias("combo"), cohort_role(c("rs") >= floor, depth, rec, c("volume_ratio") <= g["volume_cap"], c("usable"), c("member")).alias("role")))
    return features.withColumn("_r", F.explode(F.array(*roles))).select(*features.columns, "_r.combo", "_r.role")


def slope_bootstrap(series: DataFrame, trial: str, x: str, y: str, replicates: int, block: int, seed: str) -> DataFrame:
    """INF-02: circular block bootstrap of a regression slope."""
    return slope_bootstraps(series, trial, x, y, replicates, (block,), seed).drop("asked")


def slope_bootstraps(series: DataFrame, trial: str, x: str, y: str, replicates: int, blocks: tuple[int, ...], seed: str) -> DataFrame:
    """The same for several block lengths (column ``asked``) at once; a trial's k-th draw of a replicate is the same for all of them.

    A slope needs five sums, and each is a sum over blocks, so a replicate adds precomputed block sums.
    """
    pair = F.struct("session_ix", F.col(x).alias("x"), F.col(y).alias("y"))
    slope = F.when(F.min(x) < F.max(x), F.try_divide(F.covar_pop(y, x), F.var_pop(x)))
    one = series.groupBy(trial).agg(F.array_sort(F.collect_list(pair)).alias("a"), slope.alias("slope")).withColumn("n", F.size("a"))
    one = one.withColumn("asked", F.explode(F.array(*[F.lit(b) for b in blocks]))).withColumn("block", F.least("asked", "n"))
    terms = {"sx": lambda p: p["x"], "sy": lambda p: p["y"], "sxx": lambda p: p["x"] * p["x"], "sxy": lambda p: p["x"] * p["y"]}
    rest = F.col("n") % F.col("block")

    def sums(term, length):
        return F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda s: F.aggregate(
            F.sequence(s, s + length - 1), F.lit(0.0), lambda acc, j: acc + term(F.get(F.col("a"), j % F.col("n")))))

    one = one.select(trial, "asked", "n", "block", "slope", *[sums(f, F.col("block")).alias(f"full_{k}") for k, f in terms.items()],
                     *[F.when(rest > 0, sums(f, rest)).alias(f"tail_{k}") for k, f in terms.items()])
    reps = with_replicates(one, [trial, "asked"], replicates)

    def start(k):
        key = F.concat_ws("|", F.lit(seed), F.col(trial), F.col("rep"), k)
        return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % F.col("n")).cast("int")

    whole = F.floor(F.col("n") / F.col("block")).cast("int")
    reps = reps.withColumn("_at", F.transform(F.sequence(F.lit(0), whole), start))

    def total(k):
        body = F.aggregate(F.slice("_at", F.lit(1), whole), F.lit(0.0), lambda acc, s: acc + F.get(f"full_{k}", s))
        return (body + F.when(rest > 0, F.get(f"tail_{k}", F.get("_at", whole))).otherwise(0.0)).alias(k)

    cols = [total(k) for k in terms]
    s = reps.select(trial, "asked", "rep", "n", "slope", *cols)
    den = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    return s.select(trial, "asked", "rep", "slope", F.when(den > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / den).alias("boot"))


def correlation_matrix(panel: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-25: pooled Pearson matrix over complete rows, one aggregation for all pairs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    g = panel.dropna(subset=columns).agg(F.count(F.lit(1)).alias("n"), *[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    tall = g.unpivot(["n"], [f"{a}|{b}" for a, b in pairs], "pair", "corr")
    return tall.select(F.substring_index("pair", "|", 1).alias("a"), F.substring_index("pair", "|", -1).alias("b"), "n", "corr")


def role_capped(df: DataFrame, caps: dict[str, int]) -> DataFrame:
    """TOP-08: best per related group, then a cap per role; a risk factor needs a selected alpha."""
    from sessionloom.operators.topk import top_n

    order = [F.desc("score"), F.col("factor_id")]
    best = top_n(df, ["related"], order, 1, "_g")
    kept = top_n(best, ["role"], order, max(caps.values()), "role_rank")
    ok = F.lit(False)
    for role, cap in caps.items():
        ok = ok | ((F.col("role") == role) & (F.col("role_rank") <= cap))
    kept = kept.where(ok)
    has_alpha = F.max((F.col("role") == "alpha").cast("int")).over(Window.partitionBy())
    return kept.withColumn("_a", has_alpha).where((F.col("role") != "risk") | (F.col("_a") == 1)).drop("_a", "_g")
