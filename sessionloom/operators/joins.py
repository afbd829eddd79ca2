"""Joins with session, interval, ambiguity and diff semantics.

Rules kept throughout: the side that can hold a hot key is reduced per key before it is joined, a
match list per key is folded into an array only where the calendar bounds it, and no size is
assumed: Spark broadcasts a side only when it has measured it to be small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.numeric import first_failing
from sessionloom.operators.aggregates import attach_one_row


def key_diff(left: DataFrame, right: DataFrame, key: Sequence[str], economic: Sequence[str], provenance: Sequence[str] = ()) -> DataFrame:
    """JOI-04: full-outer diff on a unique key: added / absent / economic_change / provenance_change / unchanged."""
    cols = [*economic, *provenance]
    a = left.select(*key, F.struct(*economic).alias("_ae"), F.struct(*cols).alias("_aa"), F.lit(True).alias("_in_a"))
    b = right.select(*key, F.struct(*economic).alias("_be"), F.struct(*cols).alias("_ba"), F.lit(True).alias("_in_b"))
    return a.join(b, list(key), "full_outer").withColumn("change", first_failing(
        (F.col("_in_a").isNull(), "added"), (F.col("_in_b").isNull(), "absent"),
        (~F.col("_ae").eqNullSafe(F.col("_be")), "economic_change"),
        (~F.col("_aa").eqNullSafe(F.col("_ba")), "provenance_change"), ok="unchanged")).select(*key, "change")


def snapshot_diff(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """JOI-05: two snapshots by id with the list of changed fields."""
    a = left.select(key, F.struct(*fields).alias("_a"))
    b = right.select(key, F.struct(*fields).alias("_b"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields]))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return a.join(b, key, "full_outer").select(
        key,
        first_failing((F.col("_a").isNull(), "added"), (F.col("_b").isNull(), "removed"), (F.size(changed) > 0, "changed"), ok="same").alias("change"),
        F.when(both, F.array_sort(changed)).otherwise(F.array().cast("array<string>")).alias("fields"),
    )


def set_compare(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JOI-06: retained / left_only / right_only."""
    a = left.select(key).distinct().withColumn("_a", F.lit(True))
    b = right.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full_outer").select(key, first_failing(
        (F.col("_b").isNull(), "left_only"), (F.col("_a").isNull(), "right_only"), ok="retained").alias("side"))


def asof_by_session(states: DataFrame, grid: DataFrame, key: str, ts: str, columns: Sequence[str]) -> DataFrame:
    """JOI-07: latest state at or before each session of the grid.

    States are reduced to the last one per (key, session) map-side first, so the window of a key never
    holds more rows than the calendar has sessions, however many states a hot key reports.
    """
    last = states.groupBy(key, "session_ix").agg(F.max_by(F.struct(ts, *columns), ts).alias("_s"))
    merged = last.select(key, "session_ix", "_s", F.lit(False).alias("_probe")).unionByName(
        grid.select(key, "session_ix", F.lit(None).cast(last.schema["_s"].dataType).alias("_s"), F.lit(True).alias("_probe")))
    by = Window.partitionBy(key).orderBy("session_ix", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    filled = merged.withColumn("_last", F.last("_s", ignorenulls=True).over(by)).where("_probe")
    return filled.select(key, "session_ix", *[F.col(f"_last.{c}").alias(c) for c in (ts, *columns)])


def asof_by_span(states: DataFrame, keys: DataFrame, key: str, ts: str, columns: Sequence[str], first: int, last: int) -> DataFrame:
    """The same for every session from ``first`` to ``last`` of each row of ``keys``.

    A state holds from its session to the one before the next state's, so only states are sorted; sessions are written out
    afterwards, without a shuffle. A state without a session precedes all others.
    """
    before, unknown = -(2**40), -(2**40) + 1
    known = states.groupBy(key, "session_ix").agg(F.max_by(F.struct(ts, *columns), ts).alias("_s"))
    known = known.select(key, F.coalesce(F.col("session_ix").cast("bigint"), F.lit(unknown)).alias("_from"), "_s", F.lit(None).cast("bigint").alias("_rows"))
    # a state that is null leaves the one before in force
    start = keys.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).select(key, F.lit(before).cast("bigint").alias("_from"), F.lit(None).cast(known.schema["_s"].dataType).alias("_s"), "_rows")
    by = Window.partitionBy(key)
    spans = known.where("_s is not null").unionByName(start).select(
        key, "_s", F.greatest("_from", F.lit(first)).alias("_a"), F.least(F.lead("_from").over(by.orderBy("_from")) - 1, F.lit(last)).alias("_z"), F.max("_rows").over(by).alias("_rows"))
    spans = spans.where("_rows is not null and _a <= _z")
    sessions = F.sequence(F.col("_a").cast("int"), F.col("_z").cast("int"))
    each = F.when(F.col("_rows") == 1, sessions).otherwise(F.flatten(F.array_repeat(sessions, F.col("_rows").cast("int"))))
    return spans.select(key, F.explode(each).alias("session_ix"), *[F.col(f"_s.{c}").alias(c) for c in (ts, *columns)])


def next_session_lookup(sessions: DataFrame, day: str, open_utc: str) -> DataFrame:
    """One row per calendar day: the first session opening on or after it, and the one after that.

    Turns the forward as-of search into an equi join on the day (JOI-08); its size is the calendar's.
    """
    by = Window.orderBy("_d")
    s = sessions.select(
        F.to_date(day).alias("_d"), F.struct(F.col(open_utc).alias("open"), "session_ix").alias("first"))
    s = s.select("_d", "first", F.lead("first").over(by).alias("second"), F.lag("_d").over(by).alias("_prev"))
    start = F.coalesce(F.date_add("_prev", 1), F.col("_d"))
    days = s.select(F.explode(F.sequence(start, F.col("_d"))).alias("lookup_day"), "first", "second", F.lit(False).alias("before"))
    # every stamp before the first session has that session ahead
    return days.unionByName(s.where("_prev is null").select(F.lit(None).cast("date").alias("lookup_day"), "first", "second", F.lit(True).alias("before")))


def first_open_after(df: DataFrame, ts: Column, lookup: DataFrame) -> DataFrame:
    """JOI-08: first session whose open is strictly after the timestamp; a midnight stamp rolls to the next day.

    Without a timestamp, or after the last open, there is no session.
    """
    midnight = F.date_trunc("day", ts) == ts
    bound = F.when(midnight, ts + F.expr("INTERVAL 1 DAY")).otherwise(ts)
    df = df.withColumn("_bound", bound)
    hit = F.when(F.col("first.open") > F.col("_bound"), F.col("first")).otherwise(F.col("second"))
    opening = lookup.where("before").select(F.to_date(F.col("first.open")).alias("_day0"))
    day = F.to_date("_bound")
    df = attach_one_row(df, opening).withColumn("_day", F.when(day < F.col("_day0"), F.col("_day0")).otherwise(day))
    return df.join(lookup.where("not before"), F.col("_day") == F.col("lookup_day"), "left").select(
        *[c for c in df.columns if c not in ("_bound", "_day", "_day0")], hit["session_ix"].alias("eligible_ix"))


def rule_arrays(rules: DataFrame, key: str) -> DataFrame:
    """Effective-dated rules of one key as an array (a published rule table has a handful per key)."""
    return rules.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("effective_from", "effective_to", "ratio"))).alias("_rules"))


def resolve_rule(df: DataFrame, rules: DataFrame, key: str, day: Column) -> DataFrame:
    """JOI-09: 0 matches -> missing, 1 -> resolved, more -> ambiguous; decided row by row without a range join."""
    hits = F.filter(F.col("_rules"), lambda r: (r["effective_from"] <= day) & (r["effective_to"].isNull() | (r["effective_to"] >= day)))
    df = df.join(rule_arrays(rules, key), key, "left").withColumn("_hits", hits)
    n = F.coalesce(F.size("_hits"), F.lit(0))
    return df.select(
        *[c for c in df.columns if c not in ("_hits", "_rules")],
        first_failing((F.col("_hits").isNull() | (n == 0), "missing"), (n > 1, "ambiguous"), ok="resolved").alias("rule_status"),
        F.when(n == 1, F.element_at("_hits", 1)["ratio"]).alias("ratio"))


def action_arrays(actions: DataFrame) -> DataFrame:
    """Per instrument, its actions as one array: at most one row per session after grouping by date."""
    per_date = actions.groupBy("instrument_id", "effective_ix").agg(
        F.product("split_from").alias("num"), F.product("split_to").alias("den"), F.count(F.lit(1)).alias("n_actions"))
    return per_date.groupBy("instrument_id").agg(
        F.array_sort(F.collect_list(F.struct("effective_ix", "num", "den", "n_actions"))).alias("_acts"))


def split_factor(df: DataFrame, actions: DataFrame, basis: Column) -> DataFrame:
    """JOI-10 / AGG-12: product of ratios of actions with session < effective <= basis, quantised once."""
    hit = F.filter(F.coalesce("_acts", F.array().cast("array<struct<effective_ix:int,num:double,den:double,n_actions:bigint>>")),
                   lambda a: (a["effective_ix"] > F.col("session_ix")) & (a["effective_ix"] <= basis))
    num = F.aggregate(hit, F.lit(1.0), lambda acc, a: acc * a["num"])
    den = F.aggregate(hit, F.lit(1.0), lambda acc, a: acc * a["den"])
    joined = df.join(action_arrays(actions), "instrument_id", "left")
    return joined.select(*df.columns, (num / den).alias("price_factor"), (den / num).alias("volume_factor"), F.size(hit).alias("n_events"))


def events_in_windows(df: DataFrame, actions: DataFrame, back: int, horizons: Sequence[int]) -> DataFrame:
    """JOI-11: events in the look-back (ix - back, ix] and in each horizon (ix, ix + h]."""
    joined = df.join(action_arrays(actions), "instrument_id", "left")
    ix = F.col("session_ix")

    def between(lo, hi):
        hit = F.filter("_acts", lambda a: (a["effective_ix"] > lo) & (a["effective_ix"] <= hi))
        return F.coalesce(F.aggregate(hit, F.lit(0).cast("bigint"), lambda acc, a: acc + a["n_actions"]), F.lit(0).cast("bigint"))

    return joined.select(*df.columns, between(ix - back, ix).alias("n_back"), *[between(ix, ix + h).alias(f"n_ahead{h}") for h in horizons])


def cardinality(n: Column) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) == 0, "none").when(n == 1, "unique").otherwise("ambiguous")


def match_verdict(events: DataFrame, targets: DataFrame, id_col: str) -> DataFrame:
    """JOI-14: event to target on (date, old or new symbol), then on numeric equality.

    Targets are counted per (date, symbol) and per (date, symbol, ratio) before the join: a symbol with
    millions of rows costs one joined row, and pairs are never listed.
    """
    sides = events.select(id_col, "event_ix", "ratio", F.explode(F.array_distinct(F.array("old_symbol", "new_symbol"))).alias("symbol"))
    per_symbol = targets.groupBy("event_ix", "symbol").agg(F.count(F.lit(1)).alias("_n"))
    per_ratio = targets.groupBy("event_ix", "symbol", "ratio").agg(F.count(F.lit(1)).alias("_m"))
    hit = sides.join(per_symbol, ["event_ix", "symbol"], "left").join(per_ratio, ["event_ix", "symbol", "ratio"], "left")
    agg = hit.groupBy(id_col).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_symbol"), F.coalesce(F.sum("_m"), F.lit(0)).alias("n_numeric"))
    return agg.select(id_col, "n_symbol", "n_numeric", cardinality(F.col("n_symbol")).alias("symbol_match"),
                      F.when(F.col("n_symbol") == 0, "none").otherwise(cardinality(F.col("n_numeric"))).alias("numeric_match"))


def completeness(df: DataFrame, first: int, last: int) -> DataFrame:
    """JOI-15 / JOI-16: per key, how many calendar sessions lack a row, hold one, or hold several.

    Counts replace the cross product of keys and sessions: only sessions present are read.
    """
    per = df.groupBy("instrument_id", "session_ix").agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n_present"),
        (F.lit(last - first + 1) - F.count_if(F.col("session_ix").between(first, last))).alias("n_missing"),
        F.count_if(F.col("_n") > 1).alias("n_duplicated"),
        F.count_if(~F.col("session_ix").between(first, last)).alias("n_extra"))


def missing_sessions(df: DataFrame, keys: DataFrame, first: int, last: int) -> DataFrame:
    """Declared members without a bar: the absent sessions of each key (an array bounded by the calendar)."""
    have = df.groupBy("instrument_id").agg(F.collect_set("session_ix").alias("_have"))
    return keys.join(have, "instrument_id", "left").select(
        "instrument_id",
        F.explode(F.array_except(F.sequence(F.lit(first), F.lit(last)), F.coalesce("_have", F.array().cast("array<int>")))).alias("session_ix"))


def best_partner(stock: DataFrame, legs: DataFrame, window: int, minimum: int, floor: float) -> DataFrame:
    """JOI-18: per stock bar the registered fund with positive 5-session return and the highest correlation.

    ``stock`` and ``legs`` carry (session_ix, lr); the registry is fixed and small, so a stock row meets
    one row per fund.  Rolling sums give the correlation of shared observations in the window.
    Stored legs are broadcast by their size, and one exchange by instrument serves windows and minimum.
    """
    by = Window.partitionBy("instrument_id", "fund").orderBy("session_ix").rangeBetween(-(window - 1), 0)
    pair = stock.select("instrument_id", "session_ix", "lr").repartition("instrument_id").join(
        legs.select(F.col("instrument_id").alias("fund"), "session_ix", F.col("lr").alias("flr"), "r5"), "session_ix")
    both = F.col("lr").isNotNull() & F.col("flr").isNotNull()
    x, y = F.when(both, F.col("lr")), F.when(both, F.col("flr"))
    pair = pair.select("instrument_id", "fund", "session_ix", "r5", F.count(x).over(by).alias("n"), F.corr(x, y).over(by).alias("corr"))
    ok = (F.col("r5") > 0) & (F.col("n") >= minimum) & (F.col("corr") >= floor)
    best = F.min(F.when(ok, F.struct((-F.round("corr", 10)).alias("neg"), "fund", "n")))
    return pair.groupBy("instrument_id", "session_ix").agg(best.alias("_b")).select(
        "instrument_id", "session_ix", F.col("_b.fund").alias("driver"), (-F.col("_b.neg")).alias("driver_corr"), F.col("_b.n").alias("driver_obs"))


def cascade(rows: DataFrame, index: DataFrame, row_id: str, identifiers: Sequence[str]) -> DataFrame:
    """JOI-28: resolve by the first identifier, in priority order, that has any reference.

    ``index`` holds (kind, value, n_targets, target) already reduced per identifier value.
    """
    tall = rows.select(row_id, F.posexplode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in identifiers])).alias("pos", "x"))
    tall = tall.where(F.col("x.value").isNotNull()).select(row_id, "pos", F.col("x.kind").alias("kind"), F.col("x.value").alias("value"))
    hits = tall.join(index, ["kind", "value"])
    best = hits.groupBy(row_id).agg(F.min(F.struct("pos", "kind", "n_targets", "target")).alias("_b"))
    has = F.array_compact(F.array(*identifiers))
    return rows.join(best, row_id, "left").select(
        row_id, F.col("_b.kind").alias("method"),
        first_failing((F.size(has) == 0, "no_identifier"), (F.col("_b").isNull(), "unjoined"),
                      ((F.col("_b.n_targets") > 1) & (F.col("_b.kind") == identifiers[-1]), "ambiguous"),
                      (F.col("_b.n_targets") > 1, "collision"), ok="resolved").alias("status"),
        F.when(F.col("_b.n_targets") == 1, F.col("_b.target")).alias("target"))


def consistent(df: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """JOI-26: records of one key seen in several panels must agree."""
    h = F.xxhash64(*fields)
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_copies"), (F.min(h) == F.max(h)).alias("consistent"))
