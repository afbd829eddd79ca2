"""FIL-*: predicates and disposition ladders over the derived panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.catalog.core import R, query
from sessionloom.catalog.sqltext import FILINGS, I, MASTER, UNIVERSE, bars as B, lag, ret
from sessionloom.functions.numeric import joined, rnd
from sessionloom.operators import filters as P
from sessionloom.operators import windows as W
from sessionloom.operators.aggregates import attach_one_row
from sessionloom.sources.fixtures import bars, bars_between, filings, master, session_range, universe

ID = ["instrument_id", "session_ix"]
IDS = "instrument_id, session_ix"
PRICE_FLOOR, LIQUIDITY_FLOOR = 600.0, 50000.0
VENUES = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]
VENUE_SQL = "('AFRICA','AMERICA','ASIA','EUROPE')"


def dirty_bars(t):
    """Bars with deterministic defects, so every validity rule fires."""
    k = (F.col("instrument_id") * 31 + F.col("session_ix")) % 97
    b = bars(t)
    return b.select(
        "instrument_id", "session_ix",
        F.when(k == 1, -1.0).otherwise(F.col("open")).alias("open"),
        F.when(k == 2, F.col("low") / 2).otherwise(F.col("high")).alias("high"), "low",
        F.when(k == 3, F.lit(None).cast("double")).otherwise(F.col("close")).alias("close"),
        F.when(k == 4, -F.col("volume")).when(k == 5, F.lit(float("nan"))).otherwise(F.col("volume")).alias("volume"),
    )


_DIRTY = f"""{B('b0')}, d as (select instrument_id, session_ix, case when k=1 then -1.0 else open end as open,
  case when k=2 then low/2 else high end as high, low, case when k=3 then null else close end as close,
  case when k=4 then -volume when k=5 then 'nan'::double else volume end as volume
  from (select *, (instrument_id*31+session_ix)%97 as k from b0))"""


@query("fil_01_bar_validity", f"""with {_DIRTY}, v as (select case
  when open is null or high is null or low is null or close is null or volume is null then 'required_field_missing'
  when isnan(open) or isnan(high) or isnan(low) or isnan(close) or isnan(volume) then 'non_finite'
  when least(open,high,low,close)<=0 then 'non_positive_price' when volume<0 then 'negative_volume'
  when high<greatest(open,close,low) or low>least(open,close,high) then 'ohlc_inconsistent' else 'valid' end as validity from d)
 select validity, count(*) as n from v group by 1""")
def _(t):
    return P.bar_validity(dirty_bars(t)).groupBy("validity").agg(F.count(F.lit(1)).alias("n"))


def _raw_tickers(t):
    k = F.col("s_suppkey")
    up = F.upper("s_name")
    return t.supplier.select(
        k.alias("raw_id"),
        F.when(k % 23 == 0, F.lit("")).when(k % 11 == 0, F.col("s_name")).otherwise(up).alias("ticker"))


@query("fil_02_identity_category", """with raw as (select s_suppkey as raw_id, case when s_suppkey%23=0 then '' when s_suppkey%11=0 then s_name else upper(s_name) end as ticker from supplier),
 res as (select upper(s_name) as ticker, s_suppkey as resolved_id from supplier where s_suppkey%7>1),
 st as (select upper(s_name) as ticker, case s_suppkey%4 when 0 then 'unresolved' when 1 then 'excluded' when 2 then 'ambiguous' else 'rejected' end as s from supplier where s_suppkey%7=1)
 select raw_id, case when ticker='' then 'missing' when ticker<>upper(ticker) then 'rejected' when resolved_id is not null then 'resolved_eligible'
  when s='unresolved' then 'unresolved_eligible' when s='excluded' then 'expected_exclusion' when s in ('ambiguous','rejected') then s else 'missing' end as category
 from raw left join res using (ticker) left join st using (ticker)""")
def _(t):
    k = F.col("s_suppkey")
    names = t.supplier.select(k, F.upper("s_name").alias("ticker"))
    res = names.where(k % 7 > 1).select("ticker", k.alias("resolved_id"))
    st = names.where(k % 7 == 1).select("ticker", F.when(k % 4 == 0, "unresolved").when(k % 4 == 1, "excluded")
                                        .when(k % 4 == 2, "ambiguous").otherwise("rejected").alias("identity_status"))
    return P.identity_category(_raw_tickers(t), res, st).select("raw_id", "category")


@query("fil_03_universe_members", f"""with {B()}, {UNIVERSE} select session_ix, count(*) as n from b where instrument_id in (select instrument_id from u) group by 1""")
def _(t):
    return P.members(bars(t), universe(t)).groupBy("session_ix").agg(F.count(F.lit(1)).alias("n"))


@query("fil_04_return_outlier", f"""with {B()}, p as (select *, {lag('close', 1)} as pc from b)
 select {IDS}, close>=2*pc or 2*close<=pc as is_outlier from p where pc is not null""")
def _(t):
    df = bars(t).withColumn("pc", W.lagged("close", 1)).where("pc is not null")
    return df.select(*ID, P.outlier(F.col("close"), F.col("pc")).alias("is_outlier"))


def _flagged(t):
    b = bars(t)
    flags = F.array_compact(F.array(F.when(F.col("trades") == 1, "single_trade"), F.when(F.col("high") == F.col("low"), "zero_range"),
                                    F.when(F.col("volume") > 150, "heavy_volume"), F.when(F.col("high") > 20 * F.col("low"), "wide_range")))
    return b.withColumn("flags", flags)


@query("fil_05_quality_flags", f"""with {B()}, f as (select {IDS}, trades=1 as a, high=low as z, volume>150 as h, high>20*low as w from b)
 select {IDS}, w or z as has_material, case when h then 'heavy_volume' else '' end || case when h and w then '|' else '' end || case when w then 'wide_range' else '' end as unknown_flags from f""")
def _(t):
    df = P.flag_checks(_flagged(t), "flags", ["wide_range", "zero_range"], ["single_trade", "zero_range"])
    return df.select(*ID, "has_material", joined(F.col("unknown_flags")).alias("unknown_flags"))


@query("fil_06_bars_page", f"""with {B()}, {MASTER}, x as (select b.session_ix, m.ticker, m.form, {R('b.close')} as close, b.instrument_id from b join m using (instrument_id) where m.form='CS' and b.session_ix=100)
 select *, (select count(*) from x) as total from x order by ticker, instrument_id limit 50 offset 10""")
def _(t):
    x = bars_between(t, 100, 100).join(master(t).where("form = 'CS'"), "instrument_id")
    x = x.select("session_ix", "ticker", "form", rnd("close").alias("close"), "instrument_id")
    total = x.agg(F.count(F.lit(1)).alias("total"))
    rows = P.page(x, [F.col("ticker"), F.col("instrument_id")], 50, 10)
    return attach_one_row(rows, total)


@query("fil_07_returns_page", f"""with {B()}, {UNIVERSE}, r as (select {IDS}, {ret(1)} as r1 from b),
 x as (select * from r where r1 is not null and session_ix=100 and instrument_id in (select instrument_id from u))
 select instrument_id, {R('r1')} as r1, (select count(*) from x) as total from x order by r1 desc, instrument_id limit 25""")
def _(t):
    r = W.add_returns(P.members(bars_between(t, 99, 100), universe(t)), lags=(1,)).where("session_ix = 100 and r1 is not null")
    total = r.agg(F.count(F.lit(1)).alias("total"))
    return attach_one_row(P.page(r, [F.desc("r1"), F.col("instrument_id")], 25), total).select("instrument_id", rnd("r1").alias("r1"), "total")


def ladder_input(t):
    """Current / previous bar, 20-session history and exchange evidence per bar and policy."""
    b = _flagged(t).withColumn("dv", F.col("close") * F.col("volume"))
    hist = W.sessions(20)
    b = b.select(
        "instrument_id", "session_ix", "close", "flags", W.lagged("close", 1).alias("prev_close"),
        F.count("dv").over(hist).alias("n_history"), W.sorted_middle(F.collect_list("dv").over(hist)).alias("median_dv"))
    m = master(t).select("instrument_id", "form", "exchange")
    k = F.col("instrument_id")
    b = b.join(m, "instrument_id").select(
        "*", F.when(k % 29 == 0, "OTHER").otherwise(F.col("exchange")).alias("bar_exchange"),
        F.array_contains("flags", "wide_range").alias("has_material"))
    return b.withColumn("policy", F.explode(F.array(F.lit("A"), F.lit("B"))))


LADDER_SQL = f"""{B()}, {MASTER}, h0 as (select {IDS}, close, high>20*low as has_material, {lag('close', 1)} as prev_close,
   count(*) over w as n_history, median(close*volume) over w as median_dv from b
   window w as (partition by instrument_id order by session_ix range between 19 preceding and current row)),
 li as (select h0.*, m.form, m.exchange, case when instrument_id%29=0 then 'OTHER' else m.exchange end as bar_exchange, policy
   from h0 join m using (instrument_id), (values ('A'),('B')) p(policy)),
 ld as (select *, case when form is null then 'provider_evidence_missing'
   when form not in ('CS','ADRC') or (policy='A' and form='ADRC') then 'target_security_form'
   when exchange not in {VENUE_SQL} then 'unsupported_exchange' when close is null then 'missing_current_bar'
   when prev_close is null then 'missing_previous_bar' when bar_exchange<>exchange then 'exchange_conflict'
   when has_material then 'material_quality_flag' when close>=2*prev_close or 2*close<=prev_close then 'outlier_quarantine'
   when prev_close<{PRICE_FLOOR} then 'below_previous_close' when n_history<15 then 'insufficient_history'
   when median_dv<{LIQUIDITY_FLOOR} then 'below_trailing_liquidity' else 'included' end as disposition from li)"""


@query("fil_08_eligibility_funnel", f"""with {LADDER_SQL}, s as (select session_ix, exchange in {VENUE_SQL} as p1, prev_close is not null as p2, prev_close>={PRICE_FLOOR} as p3, median_dv>={LIQUIDITY_FLOOR} as p4, not has_material as p5 from li where policy='B')
 select session_ix, count(*) as n_base, count(*) filter (p1) as n_exchange, count(*) filter (p1 and p2) as n_bars, count(*) filter (p1 and p2 and p3) as n_price,
  count(*) filter (p1 and p2 and p3 and p4) as n_liquidity, count(*) filter (p1 and p2 and p3 and p4 and p5) as n_quality from s group by 1""")
def _(t):
    df = ladder_input(t).where("policy = 'B'")
    return P.eligibility_funnel(df, [
        ("exchange", F.col("exchange").isin(*VENUES)), ("bars", F.col("prev_close").isNotNull()),
        ("price", F.col("prev_close") >= PRICE_FLOOR), ("liquidity", F.col("median_dv") >= LIQUIDITY_FLOOR),
        ("quality", ~F.col("has_material"))], ["session_ix"])


def ladder(t):
    return ladder_input(t).withColumn("disposition", P.membership_ladder(PRICE_FLOOR, LIQUIDITY_FLOOR, 15, VENUES))


@query("fil_09_membership_ladder", f"""with {LADDER_SQL} select {IDS}, policy, disposition,
 case disposition when 'provider_evidence_missing' then 'provider_security_evidence' when 'target_security_form' then 'target_security_form' when 'unsupported_exchange' then 'supported_exchange'
  when 'missing_current_bar' then 'comparable_bars' when 'missing_previous_bar' then 'comparable_bars' when 'exchange_conflict' then 'input_quality' when 'material_quality_flag' then 'input_quality'
  when 'outlier_quarantine' then 'outlier_quarantine' when 'below_previous_close' then 'previous_close' when 'insufficient_history' then 'history_completeness'
  when 'below_trailing_liquidity' then 'trailing_liquidity' else 'final_membership' end as stage from ld""")
def _(t):
    return ladder(t).select(*ID, "policy", "disposition", P.stage_of(F.col("disposition")).alias("stage"))


@query("fil_10_full_base_status", f"""with {LADDER_SQL}, s as (select session_ix, instrument_id, form, case when exchange is null then 'invalid_input' when exchange not in {VENUE_SQL} then 'unsupported_exchange'
  when close is null then 'missing_current_bar' when prev_close is null then 'missing_previous_bar' when prev_close<{PRICE_FLOOR} then 'below_previous_close'
  when n_history<15 then 'insufficient_history' when median_dv<{LIQUIDITY_FLOOR} then 'below_liquidity_threshold' else 'passed' end as status from li where policy='B'),
 o as (select *, case when status='passed' and instrument_id%19=0 then 'reviewed_exclusion' when status='passed' then 'included' else status end as decision from s)
 select session_ix, status, decision, count(*) as n from o group by 1,2,3""")
def _(t):
    df = ladder_input(t).where("policy = 'B'").withColumn("status", P.full_base_status(PRICE_FLOOR, LIQUIDITY_FLOOR, 15, VENUES))
    k = F.col("s_suppkey")
    overrides = t.supplier.where(k % 19 == 0).select(k.alias("instrument_id"), F.lit("reviewed_exclusion").alias("override"))
    df = df.join(overrides, "instrument_id", "left").withColumn(
        "decision", F.when(F.col("status") == "passed", F.coalesce("override", F.lit("included"))).otherwise(F.col("status")))
    return df.groupBy("session_ix", "status", "decision").agg(F.count(F.lit(1)).alias("n"))


@query("fil_11_security_classification", f"""with {MASTER}, k as (select instrument_id, case when instrument_id%21=0 then 'ETF' when instrument_id%22=0 then 'ZZ' else form end as form, ticker from m)
 select instrument_id, case form when 'CS' then 'common_stock' when 'ADRC' then 'adr_ads' when 'ETF' then 'fund_share' else 'unknown' end as security_form,
 case form when 'ETF' then 'etf' else 'unknown' end as issuer_structure, case form when 'ADRC' then 'depositary_receipt' when 'ETF' then 'other' else 'unknown' end as listing_scope,
 case when form='ETF' then 'excluded' when form in ('CS','ADRC') then 'eligible' else 'quarantine' end as disposition,
 case when form in ('CS','ADRC','ETF') then 'provider_explicit' when contains(ticker,'000') then 'heuristic_flag_only' else 'insufficient' end as evidence_grade,
 case when contains(ticker,'000') then '000' else '' end as review_flags from k""")
def _(t):
    k = F.col("instrument_id")
    m = master(t).withColumn("form", F.when(k % 21 == 0, "ETF").when(k % 22 == 0, "ZZ").otherwise(F.col("form")))
    return P.classify_security(m).select("instrument_id", "security_form", "issuer_structure", "listing_scope", "disposition",
                                         "evidence_grade", joined(F.col("review_flags")).alias("review_flags"))


@query("fil_12_provider_policies", f"""with {MASTER} select count(*) filter (form='CS') as n_a, count(*) filter (form in ('CS','ADRC')) as n_b,
 count(*) filter (form='ADRC') as n_b_minus_a, 0::bigint as n_a_minus_b from m""")
def _(t):
    a, b = F.col("form").isin(*P.POLICY_FORMS["A"]), F.col("form").isin(*P.POLICY_FORMS["B"])
    return master(t).agg(F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(b & ~a).alias("n_b_minus_a"), F.count_if(a & ~b).alias("n_a_minus_b"))


MODES = {"conservative": dict(minimum_price=1500.0, minimum_median_dollar_volume=300000.0, maximum_annualized_volatility=20.0, maximum_absolute_open_gap=5.0, minimum_confidence=75.0, adrc_permitted=False),
         "aggressive": dict(minimum_price=700.0, minimum_median_dollar_volume=80000.0, maximum_annualized_volatility=60.0, maximum_absolute_open_gap=50.0, minimum_confidence=40.0, adrc_permitted=True)}


def risk_input(t):
    b = bars(t, grain="month").withColumn("dv", F.col("close") * F.col("volume"))
    b = W.open_gaps(W.realised_volatility(b, windows=(10,)))
    h = W.sessions(20)
    k = F.col("instrument_id")
    b = b.select("instrument_id", "session_ix", F.col("close").alias("price"), F.col("rv10").alias("volatility"), F.col("max_gap").alias("gap"),
                 F.when(F.count("dv").over(h) >= 15, W.sorted_middle(F.collect_list("dv").over(h))).alias("median_dv"),
                 F.when((k + F.col("session_ix")) % 17 != 0, ((k * 7 + F.col("session_ix") * 13) % 100).cast("double")).alias("score"),
                 ((k * 3 + F.col("session_ix") * 5) % 100).cast("double").alias("confidence"), (k % 31 == 0).alias("quarantined"))
    return b.join(master(t).select("instrument_id", "form"), "instrument_id")


def _risk_sql(mode, p):
    pairs = [("score is null", "candidate_score_unavailable"), ("score<60", "below_watch_score"), ("price<500", "base_price_floor_failed"),
             ("median_dv is null or median_dv<50000", "base_liquidity_floor_failed"), ("confidence<35", "base_confidence_floor_failed"), ("quarantined", "candidate_quarantined"),
             (f"price<{p['minimum_price']}", "risk_mode_price_floor_failed"), (f"median_dv is null or median_dv<{p['minimum_median_dollar_volume']}", "risk_mode_liquidity_floor_failed"),
             (f"volatility is null or volatility>{p['maximum_annualized_volatility']}", "risk_mode_volatility_ceiling_failed"),
             (f"gap is null or gap>{p['maximum_absolute_open_gap']}", "risk_mode_gap_ceiling_failed"), (f"confidence<{p['minimum_confidence']}", "risk_mode_confidence_floor_failed"),
             (f"form='ADRC' and {str(not p['adrc_permitted']).lower()}", "risk_mode_adrc_not_permitted")]
    arr = ",".join(f"case when {c} then '{n}' end" for c, n in pairs)
    return f"select {IDS}, '{mode}' as mode, array_to_string(list_sort(list_filter([{arr}], lambda x: x is not null)),'|') as rejections from ri"


RISK_SQL = f"""{B(grain='month')}, {MASTER}, g as (select *, ln(close/{lag('close', 1)}) as lr, open/{lag('close', 1)}-1 as gp from b),
 ri as (select g.instrument_id, session_ix, close as price, form,
   case when count(lr) over (partition by instrument_id order by session_ix rows between 9 preceding and current row)=10 then stddev_samp(lr) over (partition by instrument_id order by session_ix rows between 9 preceding and current row)*sqrt(252) end as volatility,
   case when count(gp) over (partition by instrument_id order by session_ix rows between 4 preceding and current row)=5 then max(abs(gp)) over (partition by instrument_id order by session_ix rows between 4 preceding and current row) end as gap,
   case when count(*) over w>=15 then median(close*volume) over w end as median_dv,
   case when (instrument_id+session_ix)%17<>0 then cast((instrument_id*7+session_ix*13)%100 as double) end as score,
   cast((instrument_id*3+session_ix*5)%100 as double) as confidence, instrument_id%31=0 as quarantined
   from g join m using (instrument_id) window w as (partition by instrument_id order by session_ix range between 19 preceding and current row))"""


@query("fil_13_risk_rejections", f"with {RISK_SQL} " + " union all ".join(_risk_sql(m, p) for m, p in MODES.items()))
def _(t):
    df = risk_input(t)
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), P.risk_rejections(p, 60.0, 500.0, 50000.0, 35.0).alias("r")) for m, p in MODES.items()])
    return df.withColumn("_x", F.explode(modes)).select(*ID, "_x.mode", joined(F.col("_x.r")).alias("rejections"))


REGISTRY = [("urgent_instant", "1-URGENT", "instant", ["10-K", "10-Q"], None, None), ("high_annual", "2-HIGH", "duration", ["10-K"], 330, 400),
            ("medium_annual", "3-MEDIUM", "duration", ["10-K", "10-Q"], 330, 400)]


def registry(spark):
    """Query registry (UDF-03): a handful of rows fixed in code."""
    return spark.createDataFrame(
        [(q, c, s, f, "USD", lo, hi) for q, c, s, f, lo, hi in REGISTRY],
        "query_id string, concept string, q_shape string, q_forms array<string>, q_unit string, q_min_days int, q_max_days int")


def facts(t):
    """Filing facts with unit, period start and nullable clocks."""
    k = F.col("accession")
    start = F.when(F.col("concept") == "1-URGENT", F.when(k % 10 == 0, F.date_sub("period_end", 90))).when(
        k % 9 == 0, F.lit(None).cast("date")).when(k % 8 == 0, F.date_sub("period_end", 90)).otherwise(F.date_sub("period_end", 364))
    return filings(t).select(
        "cik", "concept", "form", "accession", F.col("period_end").alias("end_date"), start.alias("start_date"),
        F.when(k % 13 == 0, "shares").otherwise("USD").alias("unit"), F.when(k % 41 != 0, F.col("available_at")).alias("available_at"),
        F.when(k % 43 != 0, F.col("value")).alias("value"))


FACTS_SQL = f"""{FILINGS}, fa as (select cik, concept, form, accession, period_end as end_date,
  case when concept='1-URGENT' then case when accession%10=0 then period_end-90 end when accession%9=0 then null when accession%8=0 then period_end-90 else period_end-364 end as start_date,
  case when accession%13=0 then 'shares' else 'USD' end as unit, case when accession%41<>0 then available_at end as available_at, case when accession%43<>0 then value end as value from f),
 rg(query_id, concept, q_shape, q_forms, q_min_days, q_max_days) as (values ('urgent_instant','1-URGENT','instant',['10-K','10-Q'],null,null),('high_annual','2-HIGH','duration',['10-K'],330,400),('medium_annual','3-MEDIUM','duration',['10-K','10-Q'],330,400)),
 fe as (select fa.*, query_id, case when unit<>'USD' then 'unit_not_allowed' when not list_contains(q_forms, form) then 'form_not_allowed' when end_date is null then 'missing_end_date'
   when (q_shape='instant')<>(start_date is null) then 'period_shape_mismatch' when q_shape='duration' and not (end_date-start_date between q_min_days and q_max_days) then 'year_duration_out_of_range'
   when available_at is null then 'source_available_at_missing' when value is null then 'value_not_accepted' else 'query_eligible' end as eligibility
   from fa join rg on fa.concept=rg.concept)"""


@query("fil_15_fact_eligibility", f"with {FACTS_SQL} select query_id, eligibility, count(*) as n, count(distinct cik) as n_filers from fe group by 1,2")
def _(t):
    df = P.fact_eligibility(facts(t).join(registry(t.spark), "concept"))
    return df.groupBy("query_id", "eligibility").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cik").alias("n_filers"))


def local_states(t):
    """Daily trading states of a market with warning labels, derived from order lines."""
    k, d = F.col("instrument_id"), F.col("session_ix")
    h = (k * 17 + d * 7) % 53
    return bars(t).select(
        "instrument_id", "session_ix", (k % 25 != 0).alias("listed_complete"), F.when(k % 14 == 0, "fund").otherwise("common_stock").alias("form"),
        F.when(h == 0, "unknown").when(h == 1, "suspended").when(h == 2, "resumed").when(h == 3, "not_listed").otherwise("trading").alias("trading_status"),
        F.when(h == 4, "unknown").when(k % 12 == 0, "special").otherwise("none").alias("warning_status"),
        (F.col("volume") > 20).alias("has_bar"), F.when(k % 18 == 0, "unknown").when(k % 2 == 0, "main").otherwise("growth").alias("board"))


LOCAL_SQL = f"""{B()}, ls as (select {IDS}, instrument_id%25<>0 as listed_complete, case when instrument_id%14=0 then 'fund' else 'common_stock' end as form,
  case h when 0 then 'unknown' when 1 then 'suspended' when 2 then 'resumed' when 3 then 'not_listed' else 'trading' end as trading_status,
  case when h=4 then 'unknown' when instrument_id%12=0 then 'special' else 'none' end as warning_status, volume>20 as has_bar,
  case when instrument_id%18=0 then 'unknown' when instrument_id%2=0 then 'main' else 'growth' end as board from (select *, (instrument_id*17+session_ix*7)%53 as h from b)),
 lu as (select *, case when not listed_complete then 'quarantined' when form<>'common_stock' then 'excluded' when trading_status='unknown' then 'quarantined' when trading_status='not_listed' then 'excluded'
   when warning_status='unknown' then 'quarantined' when warning_status<>'none' then 'excluded' else 'included' end as disposition from ls)"""


@query("fil_16_local_universe", f"with {LOCAL_SQL} select {IDS}, disposition, disposition='included' and trading_status in ('trading','resumed') and has_bar as performance_eligible from lu")
def _(t):
    return P.local_universe_ladder(local_states(t)).select(*ID, "disposition", "performance_eligible")


@query("fil_17_conservative_disposition", f"""with {LOCAL_SQL}, c as (select *, max(session_ix) over (partition by instrument_id) as last_ix,
  not (lag((session_ix//50)%3) {I} is not distinct from (session_ix//50)%3) and lag(session_ix) {I} is not null as fc from ls),
 x as (select session_ix, case when not listed_complete or warning_status='unknown' or trading_status='unknown' or board='unknown' or fc or (instrument_id%6=0 and session_ix=last_ix) or session_ix=(select max(session_ix) from ls) then 'quarantined'
  when warning_status<>'none' then 'excluded' else 'included' end as disposition from c)
 select session_ix, disposition, count(*) as n from x group by 1,2""")
def _(t):
    s = local_states(t)
    by = W.BY
    factor = F.floor(F.col("session_ix") / 50) % 3
    s = s.select("*", (~F.lag(factor).over(by).eqNullSafe(factor) & F.lag("session_ix").over(by).isNotNull()).alias("factor_changed"),
                 (F.col("session_ix") == F.max("session_ix").over(Window.partitionBy("instrument_id"))).alias("is_last_row"),
                 (~F.col("listed_complete")).alias("listing_uncertain"), (F.col("board") != "unknown").alias("board_supported"),
                 (F.col("instrument_id") % 6 == 0).alias("terminal"), (F.col("session_ix") == session_range(t)[1]).alias("at_interval_end"))
    return P.conservative_disposition(s).groupBy("session_ix", "disposition").agg(F.count(F.lit(1)).alias("n"))


@query("fil_18_population_scope", """with s as (select o_custkey as security, cast(min(o_orderdate) as date) as listing_date, case when o_custkey%3=0 then cast(max(o_orderdate) as date) end as delist_date from orders group by o_custkey),
 x as (select *, o.security%7<>0 as form_proven, o.security%5=0 as needs, case when o.security%11<>0 then listing_date end as pl, case when o.security%13=0 then 'unknown' else 'main' end as board,
  listing_date<=date '1999-12-31' and (delist_date is null or delist_date>=date '1996-01-01') as in_interval from s o)
 select security, in_interval, case when not in_interval then 'outside_scope' when not form_proven and not needs then 'outside_scope' when needs and pl is null then 'outside_scope'
  when pl is null then 'quarantined' when board='unknown' then 'quarantined' else 'resolved' end as scope from x""")
def _(t):
    k = F.col("security")
    s = t.orders.groupBy(F.col("o_custkey").alias("security")).agg(F.to_date(F.min("o_orderdate")).alias("listing_date"), F.to_date(F.max("o_orderdate")).alias("_last"))
    provider = s.where(k % 11 != 0).select("security", F.col("listing_date").alias("provider_listing_date"))
    s = s.join(provider, "security", "left").select(
        "*", F.when(k % 3 == 0, F.col("_last")).alias("delist_date"), (k % 7 != 0).alias("form_proven"), (k % 5 == 0).alias("needs_crosscheck"),
        F.when(k % 13 == 0, "unknown").otherwise("main").alias("board"))
    return P.population_scope(s, F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date")).select("security", "in_interval", "scope")


@query("fil_19_link_status", """with r as (select s_suppkey as instrument_id, c_custkey as cik, c_custkey%37=0 as bad from supplier join customer on c_custkey%(select count(*) from supplier)=s_suppkey where c_custkey%5=0 or s_suppkey%4=0),
 a as (select instrument_id, count(*) as n_rows, count(distinct case when not bad then cik%3 end) as n_ciks, bool_or(bad) as any_invalid from r group by 1)
 select s_suppkey as instrument_id, coalesce(n_ciks,0) as n_ciks, case when s_suppkey%33=0 then 'quarantined_source_custody_missing' when coalesce(n_rows,0)=0 or s_suppkey%27=0 or coalesce(any_invalid,false) or s_suppkey%26=1 then 'quarantined_identity_mismatch'
  when n_ciks>1 then 'quarantined_conflicting_cik' when n_ciks=0 then 'quarantined_missing_cik' else 'admitted_unique_cik' end as link_status
 from supplier left join a on a.instrument_id=s_suppkey""")
def _(t):
    n = t.supplier.agg(F.count(F.lit(1)).alias("_n"))
    rows = attach_one_row(t.customer, n).select((F.col("c_custkey") % F.col("_n")).alias("instrument_id"), F.col("c_custkey").alias("cik"))
    rows = rows.where((F.col("cik") % 5 == 0) | (F.col("instrument_id") % 4 == 0))
    bad = F.col("cik") % 37 == 0
    agg = rows.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.when(~bad, F.col("cik") % 3)).alias("n_ciks"), F.bool_or(bad).alias("any_invalid"))
    k = F.col("instrument_id")
    df = t.supplier.select(F.col("s_suppkey").alias("instrument_id")).join(agg, "instrument_id", "left").select(
        "instrument_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_ciks", F.lit(0)).alias("n_ciks"), F.coalesce("any_invalid", F.lit(False)).alias("any_invalid"),
        (k % 33 == 0).alias("custody_missing"), (k % 27 != 0).alias("ticker_matches"), (k % 26 == 1).alias("master_mismatch"))
    return P.link_status(df).select("instrument_id", "n_ciks", "link_status")


def lifecycle_input(t):
    """Observed delistings with the claims on their stable identifier and the history scan of it."""
    k = F.col("instrument_id")
    hist = bars(t).groupBy(k.alias("stable_id")).agg(F.min("session_ix").alias("first_seen"), F.max("session_ix").alias("last_seen"), F.count(F.lit(1)).alias("n_seen"))
    obs = t.supplier.select(F.col("s_suppkey").alias("instrument_id")).select(
        "instrument_id", F.when(k % 14 != 0, 340 + k % 30).alias("delisted"), F.lit(session_range(t)[1]).alias("anchor"),
        F.when(k % 9 != 0, k - F.when(k % 20 == 1, 1).otherwise(0)).alias("stable_id"), (k % 8 != 3).alias("ticker_seen"))
    claims = obs.where("stable_id is not null").groupBy("stable_id").agg(F.count(F.lit(1)).alias("n_claims"))
    return obs.join(claims, "stable_id", "left").join(hist.where(F.col("stable_id") % 15 != 2), "stable_id", "left")


@query("fil_20_lifecycle_reasons", f"""with {B()}, h as (select instrument_id, min(session_ix) as first_seen, max(session_ix) as last_seen from b group by 1),
 o as (select s_suppkey as instrument_id, case when s_suppkey%14<>0 then 340+s_suppkey%30 end as delisted, case when s_suppkey%9<>0 then s_suppkey-(case when s_suppkey%20=1 then 1 else 0 end) end as stable_id, s_suppkey%8<>3 as ticker_seen from supplier),
 c as (select o.*, count(*) over (partition by stable_id) as n0, case when stable_id%15<>2 then first_seen end as first_seen, case when stable_id%15<>2 then last_seen end as last_seen from o left join h on h.instrument_id=o.stable_id),
 r as (select instrument_id, list_sort(list_filter([case when delisted is null then 'delisted_date_missing' end, case when delisted>(select max(session_ix) from b) then 'delisted_date_after_anchor' end,
   case when stable_id is null then 'missing_stable_security_identifier' end, case when stable_id is not null and n0>1 then 'stable_identifier_collision' end,
   case when stable_id is not null and n0=1 and first_seen is null then 'stable_identifier_absent_from_canonical_history' end,
   case when first_seen is not null and not ticker_seen then 'source_ticker_absent_from_canonical_history' end, case when last_seen>delisted then 'canonical_instrument_seen_after_delisted_date' end], lambda x: x is not null)) as codes from c)
 select instrument_id, array_to_string(codes,'|') as codes, case when len(codes)=0 then 'review_candidate' else 'quarantined' end as disposition from r""")
def _(t):
    df = lifecycle_input(t)
    return P.lifecycle_reasons(df).select("instrument_id", joined(F.col("codes")).alias("codes"), "disposition")


@query("fil_21_knowledge_time_gate", f"""with {B()}, e as (select {IDS}, instrument_id%6<>0 as contemporaneous, session_date + interval 21 hour + interval 1 hour * ((instrument_id*5+session_ix)%200) as evaluated_at, session_date + interval 7 day + interval '14 hours 30 minutes' as next_open from b)
 select session_ix, case when contemporaneous and evaluated_at<next_open then 'signal_eligible' else 'outcome_reconciliation_only' end as eligibility,
  case when contemporaneous and evaluated_at<next_open then 'source_and_evaluation_completed_before_next_session_open' else array_to_string(list_filter([case when not contemporaneous then 'identity_source_outcome_reconciliation_only' end, case when evaluated_at>=next_open then 'membership_evaluation_not_before_next_session_open' end], lambda x: x is not null),'|') end as reasons, count(*) as n from e group by 1,2,3""")
def _(t):
    k = F.col("instrument_id")
    day = F.col("session_date").cast("timestamp")
    e = bars(t).select(
        "session_ix", (k % 6 != 0).alias("c"), (day + F.expr("INTERVAL 21 HOURS") + F.make_dt_interval(hours=((k * 5 + F.col("session_ix")) % 200).cast("int"))).alias("at"),
        (day + F.expr("INTERVAL 7 DAYS") + F.expr("INTERVAL 14 HOURS 30 MINUTES")).alias("next_open"))
    ok = F.col("c") & (F.col("at") < F.col("next_open"))
    why = F.concat_ws("|", F.when(~F.col("c"), "identity_source_outcome_reconciliation_only"), F.when(F.col("at") >= F.col("next_open"), "membership_evaluation_not_before_next_session_open"))
    e = e.select("session_ix", F.when(ok, "signal_eligible").otherwise("outcome_reconciliation_only").alias("eligibility"),
                 F.when(ok, "source_and_evaluation_completed_before_next_session_open").otherwise(why).alias("reasons"))
    return e.groupBy("session_ix", "eligibility", "reasons").agg(F.count(F.lit(1)).alias("n"))


@query("fil_22_evidence_tier", f"""with {FILINGS} select cast(floor(date_diff('day', date '1995-01-02', cast(available_at as date))/7.0)+1 as bigint) as session_ix,
 case when available_at <= date_trunc('week', available_at)+interval '4 days 14 hours 30 minutes' then 'observed_before_open' else 'reconstructed_later' end as tier, count(*) as n from f group by 1,2""")
def _(t):
    at = F.col("available_at")
    open_utc = F.date_trunc("week", at) + F.expr("INTERVAL 4 DAYS") + F.expr("INTERVAL 14 HOURS 30 MINUTES")
    f = filings(t).select((F.floor(F.datediff(at, F.lit("1995-01-02")) / 7) + 1).alias("session_ix"), F.when(at <= open_utc, "observed_before_open").otherwise("reconstructed_later").alias("tier"))
    return f.groupBy("session_ix", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("fil_23_split_usability", f"""with {B()}, s as (select distinct session_ix from b), x as (select session_ix, row_number() over (order by session_ix)-1 as i, count(*) over () as n from s),
 y as (select *, n//2 as v, n//2+n//4 as h from x)
 select session_ix, case when i<v then 'development' when i<h then 'validation' else 'holdout' end as split,
 array_to_string(list_sort(list_filter([case when i<126 then 'feature_warmup' end, case when i+5>=n then 'outcome_not_mature' end, case when (i>=v-5 and i<v) or (i>=h-5 and i<h) then 'boundary_purge' end,
  case when (i>=v and i<v+5) or (i>=h and i<h+5) then 'boundary_embargo' end], lambda x: x is not null)),'|') as codes from y""")
def _(t):
    from sessionloom.plans.research import split_plan

    return split_plan(bars(t).select("session_ix").distinct(), warmup=126, horizon=5, purge=5, embargo=5).select("session_ix", "split", joined(F.col("codes")).alias("codes"))


@query("fil_24_entry_lane", f"""with {B()}, p as (select {IDS}, case cast((instrument_id+session_ix)%5 as int) when 0 then 'technical_review_ready' when 1 then 'monitor_for_trigger' when 2 then 'wait_for_reset' when 3 then 'deprioritized' else 'not_assessable' end as posture from b)
 select posture, case posture when 'technical_review_ready' then 'review_now' when 'monitor_for_trigger' then 'watch_trigger' when 'wait_for_reset' then 'wait_reset' else 'other_research' end as lane, count(*) as n from p group by 1,2""")
def _(t):
    names = F.array(*[F.lit(x) for x in P.LANES])
    b = bars(t).select(F.element_at(names, ((F.col("instrument_id") + F.col("session_ix")) % 5 + 1).cast("int")).alias("posture"))
    return b.groupBy("posture", P.entry_lane(F.col("posture")).alias("lane")).agg(F.count(F.lit(1)).alias("n"))


@query("fil_25_threshold_proximity", f"""with {B()}, r as (select session_ix, {ret(1)} as r1 from b)
 select session_ix, {R('avg(case when least(abs(r1+0.04), abs(r1), abs(r1-0.04))<=0.05 then 1.0 else 0.0 end)')} as near_share from r where r1 is not null group by 1""")
def _(t):
    r = W.add_returns(bars(t), lags=(1,)).where("r1 is not null")
    return r.groupBy("session_ix").agg(rnd(F.avg(P.near_threshold(F.col("r1"), [-0.04, 0.0, 0.04], 0.05).cast("double"))).alias("near_share"))


@query("fil_26_data_quality", f"""with {RISK_SQL}, x as (select session_ix, case when quarantined then 'quarantined' when volatility is null or gap is null or median_dv is null then 'degraded' else 'passed' end as status from ri)
 select session_ix, status, count(*) as n from x group by 1,2""")
def _(t):
    missing = sum((F.col(c).isNull().cast("int") for c in ("volatility", "gap", "median_dv")), F.lit(0))
    df = risk_input(t).withColumn("status", P.data_quality(F.col("quarantined"), missing))
    return df.groupBy("session_ix", "status").agg(F.count(F.lit(1)).alias("n"))
