"""Decision ledgers and censuses: filer links, reported facts, universe policies, action dates, calendar coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.numeric import first_failing, joined, reasons
from sessionloom.operators.aggregates import attach_one_row
from sessionloom.operators.filters import link_status


def filer_links(securities: DataFrame, identities: DataFrame) -> DataFrame:
    """JOB-39: one disposition for each security and session, with all reasons and the securities that share its issuer number.

    ``securities``: session_ix, instrument_id, ticker, master_cik; ``identities``: session_ix, instrument_id, ticker, cik (text).
    Identities are reduced per security before the join; issuers are counted, not windowed, as one may hold most securities.
    """
    at = ["session_ix", "instrument_id"]
    valid = F.col("cik").rlike("^[0-9]{10}$")
    seen = identities.groupBy(*at).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ticker").alias("low"), F.max("ticker").alias("high"), F.countDistinct(F.when(valid, F.col("cik"))).alias("n_ciks"),
        F.min(F.when(valid, F.col("cik"))).alias("cik"), F.coalesce(F.bool_or(F.col("cik").isNotNull() & ~valid), F.lit(False)).alias("any_invalid"))
    c = F.col
    df = securities.join(seen, at, "left").na.fill(0, ["n_rows", "n_ciks"]).na.fill(False, ["any_invalid"])
    df = df.withColumn("ticker_matches", F.coalesce((c("low") == c("ticker")) & (c("high") == c("ticker")), F.lit(False)))
    df = df.withColumn("master_mismatch", F.coalesce((c("n_ciks") == 1) & (c("master_cik") != c("cik")), F.lit(False))).withColumn("custody_missing", F.lit(False))
    df = link_status(df)
    codes = reasons((c("n_rows") == 0, "resolved_identity_missing"), (~c("ticker_matches"), "effective_ticker_mismatch"), (c("any_invalid"), "cik_invalid"), (c("n_ciks") == 0, "cik_missing"),
                    (c("n_ciks") > 1, "cik_conflict"), (c("master_mismatch"), "instrument_master_cik_mismatch"))
    admitted = c("link_status") == "admitted_unique_cik"
    df = df.select(*at, "link_status", "n_rows", F.when(admitted, c("cik")).alias("cik"), F.when(admitted, "").otherwise(joined(codes)).alias("reasons"))
    shared = df.where("cik is not null").groupBy("session_ix", "cik").agg(F.count(F.lit(1)).alias("cik_instruments"))
    return df.join(shared, ["session_ix", "cik"], "left")


def facts_census(facts: DataFrame, key: list[str]) -> DataFrame:
    """JOB-40: per concept, how many facts repeat, conflict on their day, or revise an earlier value.

    Counted per key and day first; a key's first day is its original, a later day with another value a revision.
    """
    day = F.to_date("available_at").alias("day")
    daily = facts.groupBy(*key, day).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("values"), F.min("value").alias("low"), F.max("value").alias("high"))
    per = daily.groupBy(*key).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") - F.col("values")).alias("repeated"), F.count_if(F.col("values") > 1).alias("conflict_days"), F.count(F.lit(1)).alias("days"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    revised = (F.col("days") > 1) & (F.col("low") != F.col("high"))
    return per.groupBy("concept").agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_facts"), F.sum("repeated").alias("n_repeated"), F.count_if(F.col("conflict_days") > 0).alias("n_conflicting_keys"), F.count_if(revised).alias("n_revised_keys"),
        F.countDistinct("cik").alias("n_issuers"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def policy_review(decided: DataFrame, left: str, right: str) -> DataFrame:
    """JOB-26: members of two policies per session, what one has and the other lacks, and the turnover of each."""
    member = F.col("disposition") == "included"
    sides = decided.groupBy("session_ix", "instrument_id").agg(
        F.bool_or(member & (F.col("policy") == left)).alias("a"), F.bool_or(member & (F.col("policy") == right)).alias("b"))
    before = sides.select((F.col("session_ix") + 1).alias("session_ix"), "instrument_id", F.col("a").alias("pa"), F.col("b").alias("pb"))
    both = sides.join(before, ["session_ix", "instrument_id"], "full").na.fill(False, ["a", "b", "pa", "pb"])
    c, n = F.col, F.count_if
    return both.groupBy("session_ix").agg(
        n(c("a")).alias("n_left"), n(c("b")).alias("n_right"), n(c("a") & ~c("b")).alias("left_only"), n(c("b") & ~c("a")).alias("right_only"), n(c("a") & ~c("pa")).alias("left_in"), n(c("pa") & ~c("a")).alias("left_out"),
        n(c("b") & ~c("pb")).alias("right_in"), n(c("pb") & ~c("b")).alias("right_out"))


def actions_at_date(actions: DataFrame, identities: DataFrame) -> DataFrame:
    """JOB-29: an action resolves only to a security that carries its ticker on its very date; several are ambiguous."""
    held = identities.groupBy("session_ix", "ticker").agg(F.countDistinct("instrument_id").alias("n"), F.min("instrument_id").alias("resolved"))
    df = actions.join(held, (actions["effective_ix"] == held["session_ix"]) & (actions["symbol"] == held["ticker"]), "left")
    n = F.coalesce("n", F.lit(0))
    status = first_failing((n == 0, "unresolved_no_identity_on_date"), (n > 1, "ambiguous_identity_on_date"), (F.col("resolved") != F.col("instrument_id"), "resolved_to_other_security"), ok="resolved")
    return df.select("action_id", "effective_ix", "symbol", n.alias("n_identities"), F.when(n == 1, F.col("resolved")).alias("resolved_id"), status.alias("status"))


def calendar_evidence(sessions: DataFrame, notices: DataFrame, observed: DataFrame) -> DataFrame:
    """JOB-68: for each session, which of library, notices and observed states know it."""
    mark = lambda df, name: df.select("session_ix").distinct().withColumn(name, F.lit(True))
    df = mark(sessions, "in_library").join(mark(notices, "in_notices"), "session_ix", "full").join(mark(observed, "in_observed"), "session_ix", "full")
    df = df.na.fill(False, ["in_library", "in_notices", "in_observed"])
    c = F.col
    status = first_failing((c("in_library") & c("in_notices") & c("in_observed"), "agreed"), (~c("in_library"), "unknown_to_library"), (~c("in_observed"), "not_observed"), ok="not_announced")
    return df.withColumn("status", status)


def coverage_by_year(families: DataFrame, year: Column, expected: DataFrame) -> DataFrame:
    """JOB-69: sessions covered, rows and status of each data family and year against the calendar."""
    per = families.groupBy("family", "session_ix").agg(F.count(F.lit(1)).alias("n"))
    got = per.groupBy("family", year.alias("year")).agg(F.count(F.lit(1)).alias("covered"), F.sum("n").alias("n_rows"))
    want = expected.groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("expected"))
    years = expected.agg(F.sort_array(F.collect_set(year)).alias("years"))  # as many as the calendar has
    grid = attach_one_row(families.select("family").distinct(), years).select("family", F.explode("years").alias("year"))
    df = grid.join(want, "year").join(got, ["family", "year"], "left").na.fill(0, ["covered", "n_rows"])
    return df.withColumn("status", F.when(F.col("covered") >= F.col("expected"), "complete").when(F.col("covered") > 0, "partial").otherwise("missing"))


KNOWN_TYPES = ("CS", "ADRC", "ETF")


def type_evidence(rows: DataFrame, floor: float) -> DataFrame:
    """JOB-72: security type of each instrument from reference rows (instrument_id, type_code, row_text), exact repeats dropped.

    Several types make an instrument ambiguous. The gate compares the linked share of all distinct rows with ``floor``.
    """
    known = F.col("type_code").isin(*KNOWN_TYPES)
    distinct = rows.groupBy("instrument_id", "type_code", "row_text").agg(F.count(F.lit(1)).alias("n"))
    total = distinct.agg(F.count(F.lit(1)).alias("n_distinct"), F.count("instrument_id").alias("n_linked"))
    per = distinct.where("instrument_id is not null").groupBy("instrument_id").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct_rows"), F.countDistinct(F.when(known, F.col("type_code"))).alias("n_types"), F.min(F.when(known, F.col("type_code"))).alias("only"), F.count_if(~known).alias("n_unknown"))
    c = F.col
    codes = reasons((c("n_types") > 1, "conflicting_type_evidence"), (c("n_types") == 0, "no_supported_type"), (c("n_unknown") > 0, "unsupported_type_code"))
    status = first_failing((c("n_types") > 1, "ambiguous"), (c("n_types") == 0, "quarantined"), ok="classified")
    share = c("n_linked") / c("n_distinct")
    df = attach_one_row(per, total)
    return df.select("instrument_id", "n_rows", "n_distinct_rows", F.when(c("n_types") == 1, c("only")).alias("type_code"), status.alias("status"), joined(codes).alias("reasons"), share.alias("linked_share"), (share >= floor).alias("gate"))


def package_equivalence(snapshot: DataFrame, packages: DataFrame) -> DataFrame:
    """JOB-73: for each session, whether one candidate package equals the snapshot: its ids, its count and its values.

    Rows (session_ix, instrument_id, value_text; packages also candidate) are compared by order-free sums of row digests.
    """
    number = lambda text: F.sum(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)"))
    sums = lambda df, by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), number(F.col("instrument_id").cast("string")).alias("ids"), number(F.concat_ws("|", F.col("instrument_id").cast("string"), "value_text")).alias("values"))
    want = sums(snapshot, ["session_ix"])
    got = sums(packages, ["session_ix", "candidate"]).withColumnsRenamed({"n": "pn", "ids": "pids", "values": "pvalues"})
    c = F.col
    j = want.join(got, "session_ix", "left").select("session_ix", "candidate", (c("n") == c("pn")).alias("count_match"), (c("ids") == c("pids")).alias("identity_match"), (c("values") == c("pvalues")).alias("value_match"))
    exact = c("count_match") & c("identity_match") & c("value_match")
    per = j.groupBy("session_ix").agg(F.count("candidate").alias("n_candidates"), F.count_if(exact).alias("n_exact"), *[F.coalesce(F.bool_or(x), F.lit(False)).alias(x) for x in ("identity_match", "count_match", "value_match")])
    status = first_failing((c("n_candidates") == 0, "missing_source"), (c("n_exact") > 1, "several_candidates"), (c("n_exact") == 1, "exact_equivalent"), ok="identity_snapshot_mismatch")
    return per.withColumn("status", status)
