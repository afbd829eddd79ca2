"""Row predicates and disposition ladders (FIL-*): row-local expressions, so they add no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.numeric import first_failing, reasons

# fixed values: security forms of the two provider policies, supported venues, name review terms
POLICY_FORMS = {"A": ("CS",), "B": ("CS", "ADRC")}
REVIEW_TERMS = ("ACQUISITION", "TRUST", "PARTNERS", "FUND", "UNIT", "WARRANT", "RIGHT", "PREFERRED", "NOTE", "000")
LANES = {
    "technical_review_ready": "review_now",
    "monitor_for_trigger": "watch_trigger",
    "wait_for_reset": "wait_reset",
    "deprioritized": "other_research",
    "not_assessable": "other_research",
}


def bar_validity(df: DataFrame) -> DataFrame:
    """FIL-01: name the first OHLCV rule a bar breaks."""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    bad = F.isnan(o) | F.isnan(h) | F.isnan(l) | F.isnan(c) | F.isnan(v)
    reason = first_failing(
        (o.isNull() | h.isNull() | l.isNull() | c.isNull() | v.isNull(), "required_field_missing"),
        (bad, "non_finite"),
        (F.least(o, h, l, c) <= 0, "non_positive_price"),
        (v < 0, "negative_volume"),
        ((h < F.greatest(o, c, l)) | (l > F.least(o, c, h)), "ohlc_inconsistent"),
        ok="valid",
    )
    return df.withColumn("validity", reason)


def identity_category(df: DataFrame, resolver: DataFrame, statuses: DataFrame) -> DataFrame:
    """FIL-02: exact-case identity of a raw row; a lower-case ticker is rejected, never upper-cased."""
    t = F.col("ticker")
    joined = df.join(resolver, "ticker", "left").join(statuses, "ticker", "left")
    category = first_failing(
        (t.isNull() | (F.trim(t) == ""), "missing"),
        (t != F.upper(t), "rejected"),
        (F.col("resolved_id").isNotNull(), "resolved_eligible"),
        (F.col("identity_status") == "unresolved", "unresolved_eligible"),
        (F.col("identity_status") == "excluded", "expected_exclusion"),
        (F.col("identity_status").isin("ambiguous", "rejected"), F.col("identity_status")),
        ok="missing",
    )
    return joined.withColumn("category", category)


def members(df: DataFrame, universe: DataFrame) -> DataFrame:
    """FIL-03: keep members of a universe."""
    return df.join(universe, "instrument_id", "left_semi")


def outlier(current: Column, previous: Column) -> Column:
    """FIL-04: the close at least doubled or halved; multiplication form, no division."""
    return (current >= 2 * previous) | (2 * current <= previous)


def flag_checks(df: DataFrame, flags: str, material: list[str], allowed: list[str]) -> DataFrame:
    """FIL-05: any material flag present; flags outside the allow-list."""
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    unknown = F.array_sort(F.array_except(F.col(flags), lit(allowed)))
    return df.select("*", F.arrays_overlap(F.col(flags), lit(material)).alias("has_material"), unknown.alias("unknown_flags"))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """FIL-06 / FIL-07: one page of at most 200 rows in a total order; the caller counts separately."""
    if not 0 < limit <= 200:
        raise ValueError("limit must be within 1..200")
    return df.orderBy(*order).offset(offset).limit(limit)


def eligibility_funnel(df: DataFrame, steps: list[tuple[str, Column]], by: list[str]) -> DataFrame:
    """FIL-08: cumulative pass counts, non-increasing by construction."""
    passed, aggs = F.lit(True), [F.count(F.lit(1)).alias("n_base")]
    for name, cond in steps:
        passed = passed & F.coalesce(cond, F.lit(False))
        aggs.append(F.count_if(passed).alias(f"n_{name}"))
    return df.groupBy(*by).agg(*aggs)


MEMBERSHIP_STAGES = {
    "provider_evidence_missing": "provider_security_evidence",
    "target_security_form": "target_security_form",
    "unsupported_exchange": "supported_exchange",
    "missing_current_bar": "comparable_bars",
    "missing_previous_bar": "comparable_bars",
    "exchange_conflict": "input_quality",
    "material_quality_flag": "input_quality",
    "outlier_quarantine": "outlier_quarantine",
    "below_previous_close": "previous_close",
    "insufficient_history": "history_completeness",
    "below_trailing_liquidity": "trailing_liquidity",
    "included": "final_membership",
}


def membership_ladder(price_floor: float, liquidity_floor: float, history: int, exchanges: list[str]) -> Column:
    """FIL-09: the first failing stage decides membership of a named policy."""
    return first_failing(
        (F.col("form").isNull(), "provider_evidence_missing"),
        (~F.col("form").isin("CS", "ADRC") | ((F.col("policy") == "A") & (F.col("form") == "ADRC")), "target_security_form"),
        (~F.col("exchange").isin(*exchanges), "unsupported_exchange"),
        (F.col("close").isNull(), "missing_current_bar"),
        (F.col("prev_close").isNull(), "missing_previous_bar"),
        (~F.col("bar_exchange").eqNullSafe(F.col("exchange")), "exchange_conflict"),
        (F.col("has_material"), "material_quality_flag"),
        (outlier(F.col("close"), F.col("prev_close")), "outlier_quarantine"),
        (F.col("prev_close") < price_floor, "below_previous_close"),
        (F.col("n_history") < history, "insufficient_history"),
        (F.col("median_dv") < liquidity_floor, "below_trailing_liquidity"),
        ok="included",
    )


def stage_of(disposition: Column) -> Column:
    pairs = [F.lit(x) for kv in MEMBERSHIP_STAGES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), disposition)


def full_base_status(price_floor: float, liquidity_floor: float, history: int, exchanges: list[str]) -> Column:
    """FIL-10: metric status before any reviewed override applies."""
    return first_failing(
        (F.col("exchange").isNull(), "invalid_input"),
        (~F.col("exchange").isin(*exchanges), "unsupported_exchange"),
        (F.col("close").isNull(), "missing_current_bar"),
        (F.col("prev_close").isNull(), "missing_previous_bar"),
        (F.col("prev_close") < price_floor, "below_previous_close"),
        (F.col("n_history") < history, "insufficient_history"),
        (F.col("median_dv") < liquidity_floor, "below_liquidity_threshold"),
        ok="passed",
    )


def classify_security(df: DataFrame) -> DataFrame:
    """FIL-11: form, structure, scope and disposition from provider type, with name review flags."""
    form, name = F.col("form"), F.upper("ticker")
    flags = F.filter(F.array(*[F.lit(x) for x in REVIEW_TERMS]), lambda x: F.contains(name, x))
    known = form.isin("CS", "ADRC", "ETF")
    return df.select(
        "*",
        F.when(form == "CS", "common_stock").when(form == "ADRC", "adr_ads").when(form == "ETF", "fund_share").otherwise("unknown").alias("security_form"),
        F.when(form == "ETF", "etf").otherwise("unknown").alias("issuer_structure"),
        F.when(form == "ADRC", "depositary_receipt").when(form == "ETF", "other").otherwise("unknown").alias("listing_scope"),
        F.when(form == "ETF", "excluded").when(known, "eligible").otherwise("quarantine").alias("disposition"),
        F.when(known, "provider_explicit").when(F.size(flags) > 0, "heuristic_flag_only").otherwise("insufficient").alias("evidence_grade"),
        F.array_sort(flags).alias("review_flags"),
    )


def risk_rejections(p: dict, watch_score: float, price_floor: float, liquidity_floor: float, watch_confidence: float) -> Column:
    """FIL-13: every independent rejection reason of one risk mode, none short-circuits another."""
    c = F.col
    missing_or = lambda x, bad: c(x).isNull() | bad
    return reasons(
        (c("score").isNull(), "candidate_score_unavailable"),
        (c("score") < watch_score, "below_watch_score"),
        (c("price") < price_floor, "base_price_floor_failed"),
        (missing_or("median_dv", c("median_dv") < liquidity_floor), "base_liquidity_floor_failed"),
        (c("confidence") < watch_confidence, "base_confidence_floor_failed"),
        (c("quarantined"), "candidate_quarantined"),
        (c("price") < p["minimum_price"], "risk_mode_price_floor_failed"),
        (missing_or("median_dv", c("median_dv") < p["minimum_median_dollar_volume"]), "risk_mode_liquidity_floor_failed"),
        (missing_or("volatility", c("volatility") > p["maximum_annualized_volatility"]), "risk_mode_volatility_ceiling_failed"),
        (missing_or("gap", c("gap") > p["maximum_absolute_open_gap"]), "risk_mode_gap_ceiling_failed"),
        (c("confidence") < p["minimum_confidence"], "risk_mode_confidence_floor_failed"),
        ((c("form") == "ADRC") & F.lit(not p["adrc_permitted"]), "risk_mode_adrc_not_permitted"),
    )


def cohort_role(leader: Column, depth_ok: Column, recovery_ok: Column, volume_ok: Column, usable: Column, member: Column) -> Column:
    """FIL-14: role of one observation under one parameter combination."""
    return first_failing(
        (~usable, "excluded_chronological_boundary"),
        (~member, "excluded_membership"),
        (~leader, "excluded_not_leader"),
        (depth_ok & recovery_ok & volume_ok, "signal"),
        ok="eligible_leader_control",
    )


def fact_eligibility(df: DataFrame) -> DataFrame:
    """FIL-15: first reason a filing fact cannot answer a registered query (registry columns already joined)."""
    c = F.col
    days = F.datediff("end_date", "start_date")
    reason = first_failing(
        (c("unit") != c("q_unit"), "unit_not_allowed"),
        (~F.array_contains(c("q_forms"), c("form")), "form_not_allowed"),
        (c("end_date").isNull(), "missing_end_date"),
        ((c("q_shape") == "instant") != c("start_date").isNull(), "period_shape_mismatch"),
        ((c("q_shape") == "duration") & ~days.between(c("q_min_days"), c("q_max_days")), "year_duration_out_of_range"),
        (c("available_at").isNull(), "source_available_at_missing"),
        (c("value").isNull(), "value_not_accepted"),
        ok="query_eligible",
    )
    return df.withColumn("eligibility", reason)


def local_universe_ladder(df: DataFrame) -> DataFrame:
    """FIL-16: daily universe decision of a market with warning labels and suspensions."""
    c = F.col
    disposition = first_failing(
        (~c("listed_complete"), "quarantined"),
        (c("form") != "common_stock", "excluded"),
        (c("trading_status") == "unknown", "quarantined"),
        (c("trading_status") == "not_listed", "excluded"),
        (c("warning_status") == "unknown", "quarantined"),
        (c("warning_status") != "none", "excluded"),
        ok="included",
    )
    df = df.withColumn("disposition", disposition)
    eligible = (c("disposition") == "included") & c("trading_status").isin("trading", "resumed") & c("has_bar")
    return df.withColumn("performance_eligible", eligible)


def conservative_disposition(df: DataFrame) -> DataFrame:
    """FIL-17: uncertain rows are quarantined before warnings exclude them."""
    c = F.col
    return df.withColumn("disposition", first_failing(
        (c("listing_uncertain") | (c("warning_status") == "unknown") | (c("trading_status") == "unknown")
         | ~c("board_supported") | c("factor_changed") | (c("terminal") & c("is_last_row")) | c("at_interval_end"), "quarantined"),
        (c("warning_status") != "none", "excluded"), ok="included"))


def population_scope(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """FIL-18 / JOI-13: interval overlap decides scope, then the cross-source evidence."""
    c = F.col
    overlap = (c("listing_date") <= end) & (c("delist_date").isNull() | (c("delist_date") >= start))
    return df.select("*", overlap.alias("in_interval"), first_failing(
        (~overlap, "outside_scope"),
        (~c("form_proven") & ~c("needs_crosscheck"), "outside_scope"),
        (c("needs_crosscheck") & c("provider_listing_date").isNull(), "outside_scope"),
        (c("provider_listing_date").isNull(), "quarantined"),
        (c("board") == "unknown", "quarantined"),
        ok="resolved").alias("scope"))


def link_status(df: DataFrame) -> DataFrame:
    """FIL-19: admit a filer link only for a single valid issuer number without identity conflicts."""
    c = F.col
    return df.withColumn("link_status", first_failing(
        (c("custody_missing"), "quarantined_source_custody_missing"),
        ((c("n_rows") == 0) | ~c("ticker_matches") | c("any_invalid") | c("master_mismatch"), "quarantined_identity_mismatch"),
        (c("n_ciks") > 1, "quarantined_conflicting_cik"),
        (c("n_ciks") == 0, "quarantined_missing_cik"),
        ok="admitted_unique_cik"))


def lifecycle_reasons(df: DataFrame) -> DataFrame:
    """FIL-20: review-versus-quarantine reasons of an inactive instrument."""
    c = F.col
    codes = reasons(
        (c("delisted").isNull(), "delisted_date_missing"),
        (c("delisted") > c("anchor"), "delisted_date_after_anchor"),
        (c("stable_id").isNull(), "missing_stable_security_identifier"),
        (c("n_claims") > 1, "stable_identifier_collision"),
        (c("stable_id").isNotNull() & (c("n_claims") == 1) & c("first_seen").isNull(), "stable_identifier_absent_from_canonical_history"),
        (c("first_seen").isNotNull() & ~c("ticker_seen"), "source_ticker_absent_from_canonical_history"),
        (c("last_seen") > c("delisted"), "canonical_instrument_seen_after_delisted_date"),
    )
    return df.select("*", codes.alias("codes"), F.when(F.size(codes) == 0, "review_candidate").otherwise("quarantined").alias("disposition"))


def split_usability(index: Column, count: Column, warmup: int, horizon: int, purge: int, embargo: int) -> Column:
    """FIL-23: why a session may not carry a signal under a 50 / 25 / 25 chronological plan."""
    v = F.floor(count / 2)
    h = v + F.floor(count / 4)
    near = lambda b: (index >= b - purge) & (index < b)
    after = lambda b: (index >= b) & (index < b + embargo)
    return reasons(
        (index < warmup, "feature_warmup"),
        (index + horizon >= count, "outcome_not_mature"),
        (near(v) | near(h), "boundary_purge"),
        (after(v) | after(h), "boundary_embargo"),
    )


def entry_lane(posture: Column) -> Column:
    """FIL-24: review posture to entry lane."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANES.items() for x in kv]), posture)


def near_threshold(value: Column, thresholds: list[float], tolerance: float) -> Column:
    """FIL-25: within tolerance of any registered threshold."""
    gaps = F.transform(F.array(*[F.lit(float(x)) for x in thresholds]), lambda x: F.abs(value - x))
    return F.array_min(gaps) <= tolerance


def data_quality(quarantined: Column, missing: Column) -> Column:
    """FIL-26."""
    return first_failing((quarantined, "quarantined"), (missing > 0, "degraded"), ok="passed")
