"""SCA-*: scalar families applied to whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.catalog.core import R, query
from sessionloom.catalog.filters import RISK_SQL, risk_input
from sessionloom.catalog.joins import RULES_SQL, calendar, rule_table
from sessionloom.catalog.sqltext import FILINGS, I, MASTER, bars as B, lag, ret
from sessionloom.functions import numeric as N
from sessionloom.functions import scalars as S
from sessionloom.functions.numeric import joined, rnd
from sessionloom.operators import joins as J
from sessionloom.operators import windows as W
from sessionloom.sources.fixtures import bars, filings, master, session_range

ID = ["instrument_id", "session_ix"]
IDS = "instrument_id, session_ix"


@query("sca_01_math", f"with {B()} select {IDS}, {R('ln(close)')} as ln, {R('log10(volume)')} as lg, {R('sqrt(close)')} as sq, {R('abs(open-close)', 8)} as ab, cast(sign(close-open) as int) as sg from b")
def _(t):
    c = F.col
    return bars(t).select(*ID, rnd(F.log("close")).alias("ln"), rnd(F.log10("volume")).alias("lg"), rnd(F.sqrt("close")).alias("sq"), rnd(F.abs(c("open") - c("close")), 8).alias("ab"),
                          F.signum(c("close") - c("open")).cast("int").alias("sg"))


@query("sca_02_normalisers", f"""with {B()}, r as (select {IDS}, volume, {ret(1)} as x from b) select {IDS}, {R('least(100.0,greatest(0.0,100*(x+0.5)/1.0))')} as linear, {R('100-least(100.0,greatest(0.0,100*(x+0.5)/1.0))')} as declining,
 {R('case when x is null then null when x<=-0.5 or x>=1.5 then 0.0 when x<=0.1 then least(100.0,greatest(0.0,100*(x+0.5)/0.6)) else least(100.0,greatest(0.0,100*(1.5-x)/1.4)) end')} as triangular,
 {R('least(100.0,greatest(0.0,100*(log10(volume)-log10(10))/(log10(500)-log10(10))))')} as log_linear from r where x is not null""")
def _(t):
    r = W.add_returns(bars(t), lags=(1,)).where("r1 is not null")
    return r.select(*ID, rnd(N.linear_score("r1", -0.5, 0.5)).alias("linear"), rnd(N.declining_score("r1", -0.5, 0.5)).alias("declining"),
                    rnd(N.triangular_score("r1", -0.5, 0.1, 1.5)).alias("triangular"), rnd(N.log_linear_score("volume", 10.0, 500.0)).alias("log_linear"))


@query("sca_03_half_even", f"""with {B()} select {IDS}, round_even(volume/8, 2)+0.0 as q2, round_even(-volume/8, 0)+0.0 as q0 from b""")
def _(t):
    return bars(t).select(*ID, N.quantise(F.col("volume") / 8, 2).alias("q2"), N.quantise(-F.col("volume") / 8, 0).alias("q0"))


@query("sca_04_weight_redistribution", f"""with {RISK_SQL}, a as (select {IDS}, score is not null as a1, volatility is not null as a2, gap is not null as a3 from ri),
 s as (select *, (case when a1 then 35.0 else 0 end)+(case when a2 then 40.0 else 0 end)+(case when a3 then 25.0 else 0 end) as tot from a),
 k as (select *, case when a1 then round_even(3500.0::double/tot,4) else 0 end as s1, case when a2 then round_even(4000.0::double/tot,4) else 0 end as s2 from s)
 select {IDS}, {R('case when not a1 then 0 when a2 or a3 then s1 else 100 end')} as w1, {R('case when not a2 then 0 when a3 then s2 else 100-s1 end')} as w2, {R('case when not a3 then 0 else 100-s1-s2 end')} as w3 from k""")
def _(t):
    r = risk_input(t)
    ws = N.redistribute([(F.col("score").isNotNull(), 35), (F.col("volatility").isNotNull(), 40), (F.col("gap").isNotNull(), 25)])
    return r.select(*ID, *[rnd(w).alias(f"w{i + 1}") for i, w in enumerate(ws)])


@query("sca_05_close_location", f"with {B()} select {IDS}, {R('case when high>low then (close-low)/(high-low) end')} as clv, case when high=low then 'zero_signal_session_range' end as reason from b")
def _(t):
    c = F.col
    return bars(t).select(*ID, rnd(N.ratio(c("close") - c("low"), c("high") - c("low"))).alias("clv"), F.when(c("high") == c("low"), "zero_signal_session_range").alias("reason"))


@query("sca_06_factor_reconcile", f"""with {B()}, d as (select {IDS}, close, {lag('close', 1)} as pc, close*0.01::double as cash from b) select {IDS}, {R('(pc-cash)/pc')} as backward_factor, {R('close*((pc-cash)/pc)/((pc-cash)/pc)', 8)} as restored,
 case when pc is null then 'not_comparable' when (pc-cash)/pc=0.99::double then 'exact' when (pc-cash)/pc=0 then 'not_comparable' when abs(0.99::double/((pc-cash)/pc)-1)<=0.01 then 'within_tolerance' else 'mismatch' end as verdict from d""")
def _(t):
    d = bars(t).select(*ID, "close", W.lagged("close", 1).alias("pc"), (F.col("close") * 0.01).alias("cash"))
    f = (F.col("pc") - F.col("cash")) / F.col("pc")
    return d.select(*ID, rnd(f).alias("backward_factor"), rnd(F.col("close") * f / f, 8).alias("restored"), S.factor_reconcile(F.lit(0.99), f, 0.01).alias("verdict"))


ASSUMPTIONS = [dict(name="low", coefficient=0.5, commission=0.5, half_spread=1.0, delay=0.5), dict(name="base", coefficient=0.8, commission=1.0, half_spread=2.0, delay=1.0), dict(name="stress", coefficient=1.2, commission=2.0, half_spread=5.0, delay=3.0)]


@query("sca_07_impact_cost", f"""with {RISK_SQL}, o as (select {IDS}, volatility/sqrt(252) as v, 20000.0/median_dv as p from ri where volatility is not null and median_dv is not null),
 a(name, c, k) as (values ('low',0.5,2.0),('base',0.8,4.0),('stress',1.2,10.0)) select {IDS}, name as scenario, {R('c*v*sqrt(p)*1e4+k', 4)} as cost_bps, p>0.1 as capacity_exceeded from o, a""")
def _(t):
    r = risk_input(t).where("volatility is not null and median_dv is not null")
    v, p = F.col("volatility") / F.sqrt(F.lit(252.0)), 20000.0 / F.col("median_dv")
    sc = F.array(*[F.struct(F.lit(a["name"]).alias("scenario"), S.impact_cost_bps(v, p, a).alias("c")) for a in ASSUMPTIONS])
    return r.select(*ID, (p > 0.1).alias("capacity_exceeded"), F.explode(sc).alias("x")).select(*ID, "x.scenario", rnd("x.c", 4).alias("cost_bps"), "capacity_exceeded")


@query("sca_08_local_cost", f"""with o as (select l_returnflag as flag, l_extendedprice as amount, case when l_linestatus='O' then 'sell' else 'buy' end as side from lineitem),
 c as (select flag, side, greatest(round(amount::decimal(18,2)*0.0003::decimal(10,8),2)::double,5.0::double) as comm, round(amount::decimal(18,2)*0.00002::decimal(10,8),2)::double as tr, round(amount::decimal(18,2)*0.00005::decimal(10,8),2)::double as ha, case when side='sell' then round(amount::decimal(18,2)*0.001::decimal(10,8),2)::double else 0::double end as st from o)
 select flag, side, count(*) as n, {R('avg(comm)', 4)} as commission, {R('avg(tr)', 4)} as transfer, {R('avg(ha)', 4)} as handling, {R('avg(st)', 4)} as stamp from c group by 1,2""")
def _(t):
    fees = dict(commission=0.0003, minimum=5.0, transfer=0.00002, handling=0.00005, stamp=0.001)
    o = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.when(F.col("l_linestatus") == "O", "sell").otherwise("buy").alias("side"), F.col("l_extendedprice").alias("amount"))
    c = o.select("flag", "side", *S.local_cost(F.col("amount"), F.col("side"), fees))
    return c.groupBy("flag", "side").agg(F.count(F.lit(1)).alias("n"), *[rnd(F.avg(x), 4).alias(x) for x in ("commission", "transfer", "handling", "stamp")])


@query("sca_09_price_limits", f"""with {B()}, p as (select {IDS}, close, round({lag('close', 1)},2) as pc from b), l as (select *, round(pc::decimal(18,2)*1.1::decimal(6,4),2)::double as limit_up, round(pc::decimal(18,2)*0.9::decimal(6,4),2)::double as limit_down from p where pc is not null)
 select session_ix, count(*) filter (close<=limit_up and close>=limit_down) as n_inside, count(*) filter (close>limit_up) as n_above, count(*) filter (close<limit_down) as n_below from l group by 1""")
def _(t):
    p = bars(t).select(*ID, "close", F.round(W.lagged("close", 1), 2).alias("pc")).where("pc is not null")
    l = p.select("*", *S.price_limits(F.col("pc"), F.lit(0.1)))
    c = F.col
    return l.groupBy("session_ix").agg(F.count_if(c("close").between(c("limit_down"), c("limit_up"))).alias("n_inside"), F.count_if(c("close") > c("limit_up")).alias("n_above"), F.count_if(c("close") < c("limit_down")).alias("n_below"))


@query("sca_10_ex_right_reference", f"""with {B()}, p as (select {IDS}, {lag('close', 1)} as pc, (instrument_id%4)*0.1::double as bonus, (instrument_id%3)*0.2::double as rr, close from b) select {IDS}, {R('(pc-1.5::double+8.0::double*rr)/(1+rr+bonus)')} as reference, {R('close/((pc-1.5::double+8.0::double*rr)/(1+rr+bonus))-1')} as step_error from p""")
def _(t):
    k = F.col("instrument_id")
    ref = S.ex_right_reference(F.col("pc"), F.lit(1.5), F.lit(8.0), k % 3 * 0.2, k % 4 * 0.1)
    p = bars(t).select(*ID, W.lagged("close", 1).alias("pc"), "close")
    return p.select(*ID, rnd(ref).alias("reference"), rnd(F.col("close") / ref - 1).alias("step_error"))


@query("sca_11_session_arithmetic", """with f as (select o_orderkey, cast(o_orderdate as date) as d from orders), x as (select *, cast(floor(date_diff('day', date '1995-01-02', d)/7.0) as int)+1 as ix from f)
 select o_orderkey, ix as at_or_before, cast(case when date_diff('day', date '1995-01-02', d)%7=0 then ix-1 else ix end as int) as previous_ix, cast(ix+1 as int) as next_ix, cast(ix-5 as int) as fifth_before, strftime(date '1995-01-02' + (ix-1)*7 + interval '14 hours 30 minutes','%Y-%m-%d %H:%M:%S') as open_utc from x""")
def _(t):
    d = F.datediff("o_orderdate", F.lit("1995-01-02"))
    ix = (F.floor(d / 7) + 1).cast("int")
    day = F.date_add(F.lit("1995-01-02").cast("date"), (ix - 1) * 7)
    return t.orders.select("o_orderkey", ix.alias("at_or_before"), F.when(d % 7 == 0, ix - 1).otherwise(ix).alias("previous_ix"), (ix + 1).alias("next_ix"), (ix - 5).alias("fifth_before"),
                           F.date_format(day.cast("timestamp_ntz") + F.expr("INTERVAL 14 HOURS 30 MINUTES"), "yyyy-MM-dd HH:mm:ss").alias("open_utc"))


@query("sca_12_freshness", f"""with {B()}, l as (select instrument_id, max(session_ix) as last_ix from b group by 1) select instrument_id, (select max(session_ix) from b)-last_ix as lag_sessions, case when last_ix=(select max(session_ix) from b) then 'fresh' when last_ix>=(select max(session_ix)-2 from b) then 'stale' else 'unavailable' end as freshness from l""")
def _(t):
    l = bars(t).groupBy("instrument_id").agg(F.max("session_ix").alias("l"))
    latest = session_range(t)[1]
    return l.select("instrument_id", (latest - F.col("l")).alias("lag_sessions"), F.when(F.col("l") == latest, "fresh").when(F.col("l") >= latest - 2, "stale").otherwise("unavailable").alias("freshness"))


@query("sca_13_market_zone_date", """select cast(cast(timezone('America/New_York', timezone('UTC', date_trunc('millisecond', ts))) as date) as varchar) as session_date, count(*) as n from events group by 1""")
def _(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.events.groupBy(S.session_date_of_millis(ms).cast("string").alias("session_date")).agg(F.count(F.lit(1)).alias("n"))


@query("sca_14_age_buckets", f"""with {FILINGS}, d as (select date_diff('day', period_end, cast(available_at as date))*(1+cik%8) as days from f) select case when days<=120 then '0-120' when days<=240 then '121-240' when days<=450 then '241-450' when days<=730 then '451-730' else '731+' end as bucket, count(*) as n from d group by 1""")
def _(t):
    days = F.datediff("available_at", "period_end") * (1 + F.col("cik") % 8)
    return filings(t).groupBy(S.age_bucket(days).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("sca_15_stable_identity", """select s_suppkey, nullif(upper(trim(case when s_suppkey%4=0 then '  ' else ' '||s_name||' ' end)),'') as identifier from supplier""")
def _(t):
    return t.supplier.select("s_suppkey", S.identifier(F.when(F.col("s_suppkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "s_name", F.lit(" ")))).alias("identifier"))


UUID_NS = "6ba7b8109dad11d180b400c04fd430c8"


@query("sca_15_uuid5", f"""with h as (select s_suppkey, sha1(unhex('{UUID_NS}') || encode(s_name)) as h from supplier)
 select s_suppkey, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab', cast(('0x'||substr(h,17,1)) as int)%4+1, 1)||substr(h,18,3)||'-'||substr(h,21,12) as uuid from h""")
def _(t):
    return t.supplier.select("s_suppkey", S.uuid5(UUID_NS, F.col("s_name")).alias("uuid"))


@query("sca_16_ticker_charset", "select s_suppkey, regexp_matches(upper(s_name), '^[A-Z0-9.-]+$') as ok_raw, regexp_matches(replace(upper(s_name),'#','-'), '^[A-Z0-9.-]+$') as ok_clean from supplier")
def _(t):
    up = F.upper("s_name")
    return t.supplier.select("s_suppkey", S.ticker_ok(up).alias("ok_raw"), S.ticker_ok(F.replace(up, F.lit("#"), F.lit("-"))).alias("ok_clean"))


@query("sca_17_ratio_text", f"""with x as (select o_orderkey, case when o_orderkey%11=0 then '3:0' when o_orderkey%13=0 then 'x:2' when o_orderkey%7=0 then '5' else (1+o_orderkey%5)||':'||(1+o_orderkey%3) end as rt, o_orderpriority||':'||o_orderkey as tag from orders)
 select o_orderkey, {R("case when len(string_split(rt,':'))=2 and try_cast(string_split(rt,':')[2] as double)<>0 then try_cast(string_split(rt,':')[1] as double)/try_cast(string_split(rt,':')[2] as double) end")} as ratio, string_split(tag,':')[-1] as stamp from x""")
def _(t):
    k = F.col("o_orderkey")
    rt = F.when(k % 11 == 0, "3:0").when(k % 13 == 0, "x:2").when(k % 7 == 0, "5").otherwise(F.concat_ws(":", 1 + k % 5, 1 + k % 3))
    return t.orders.select("o_orderkey", rnd(S.ratio_text(rt)).alias("ratio"), S.right_of_last_colon(F.concat_ws(":", "o_orderpriority", k)).alias("stamp"))


@query("sca_18_distribution_text", f"""with x as (select s_suppkey, '10' || case when s_suppkey%2=0 then '送'||(s_suppkey%5)||'股' else '' end || case when s_suppkey%3=0 then '转'||(s_suppkey%7)||'.5股' else '' end || case when s_suppkey%4<>0 then '派'||(s_suppkey%9)||'.25元' else '' end as txt from supplier)
 select s_suppkey, {R("coalesce(try_cast(regexp_extract(txt,'派([0-9.]+)元',1) as double),0)/10")} as cash, {R("coalesce(try_cast(regexp_extract(txt,'送([0-9.]+)股',1) as double),0)/10")} as bonus, {R("coalesce(try_cast(regexp_extract(txt,'转([0-9.]+)股',1) as double),0)/10")} as capitalisation from x""")
def _(t):
    k = F.col("s_suppkey")
    txt = F.concat(F.lit("10"), F.when(k % 2 == 0, F.concat(F.lit("送"), k % 5, F.lit("股"))).otherwise(""), F.when(k % 3 == 0, F.concat(F.lit("转"), k % 7, F.lit(".5股"))).otherwise(""),
                   F.when(k % 4 != 0, F.concat(F.lit("派"), k % 9, F.lit(".25元"))).otherwise(""))
    return t.supplier.select("s_suppkey", *S.distribution_text(txt)).select("s_suppkey", *[rnd(c).alias(c) for c in ("cash", "bonus", "capitalisation")])


@query("sca_19_text_markers", r"""select doc_id, len(regexp_extract_all(text,'(?i)\bmerger\b')) as merger, len(regexp_extract_all(text,'(?i)\bthe\b')) as the_word, len(regexp_extract_all(text,'[0-9]+')) as digits, len(regexp_extract_all(text,'\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b')) as iso_date from documents""")
def _(t):
    return t.documents.select("doc_id", *S.marker_counts(F.col("text")))


@query("sca_20_table_digest", """select l_returnflag as flag, count(*) as n_rows, cast(sum(cast(('0x'||substr(sha256(l_orderkey||'|'||l_partkey||'|'||l_suppkey||'|'||l_linenumber||'|'||cast(cast(round(l_extendedprice*100) as bigint) as varchar)),1,15)) as bigint)) as varchar) as fingerprint from lineitem group by 1""")
def _(t):
    from sessionloom.operators.aggregates import multiset_fingerprint

    row = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(*multiset_fingerprint(row))


@query("sca_21_flag_arrays", """select user_id, array_to_string(list_sort(list_distinct(list(event_type))),'|') as kinds, len(list_distinct(list(event_type))) as n_kinds, list_contains(list(event_type),'error') as has_error from events group by 1""")
def _(t):
    s = F.collect_set("event_type")
    return t.events.groupBy("user_id").agg(s.alias("s")).select("user_id", joined(F.array_sort("s")).alias("kinds"), F.size("s").cast("bigint").alias("n_kinds"), F.array_contains("s", "error").alias("has_error"))


@query("sca_22_metric_ledger", f"""with {B()} select {IDS}, {R('(case when close>open then 1 else 0 end)*40.0+(case when volume>100 then 1 else 0 end)*35.0+(case when high>2*low then 1 else 0 end)*25.0')} as total,
 array_to_string(list_filter([case when close>open then 'close_up' end, case when volume>100 then 'heavy' end, case when high>2*low then 'wide' end], lambda x: x is not null),'|') as met from b""")
def _(t):
    c = F.col
    ledger = F.array(*[F.struct(F.lit(k).alias("id"), v.alias("hit"), F.lit(w).alias("weight")) for k, v, w in
                       (("close_up", c("close") > c("open"), 40.0), ("heavy", c("volume") > 100, 35.0), ("wide", c("high") > 2 * c("low"), 25.0))])
    hits = F.filter("ledger", lambda x: x["hit"])
    return bars(t).withColumn("ledger", ledger).select(*ID, rnd(F.aggregate(hits, F.lit(0.0), lambda a, x: a + x["weight"])).alias("total"), joined(F.transform(hits, lambda x: x["id"])).alias("met"))


@query("sca_23_json_paths", """with x as (select event_id%97 as k, json_extract_string(props,'$.k') as v from events) select case when v is null then 'missing' when regexp_matches(v,'^-?[0-9]+$') then 'int' when regexp_matches(v,'^-?[0-9]*\\.[0-9]+$') then 'decimal' else 'text' end as kind, count(*) as n, cast(sum(try_cast(v as bigint)) as bigint) as total from x group by 1""")
def _(t):
    v = F.get_json_object("props", "$.k")
    return t.events.groupBy(S.json_value_kind(F.col("props"), "$.k").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(v.try_cast("bigint")).alias("total"))


@query("sca_24_strict_numbers", f"""with x as (select o_orderkey, case when o_orderkey%9=0 then 'NaN' when o_orderkey%10=0 then '1e5' when o_orderkey%14=0 then '' when o_orderkey%15=0 then '-12' else (o_orderkey%1000)||'.5' end as s from orders)
 select o_orderkey, {R("case when regexp_matches(s,'^-?[0-9]+(\\.[0-9]+)?$') then try_cast(s as double) end")} as value, regexp_matches(s,'^[0-9]+$') as is_count from x""")
def _(t):
    k = F.col("o_orderkey")
    s = F.when(k % 9 == 0, "NaN").when(k % 10 == 0, "1e5").when(k % 14 == 0, "").when(k % 15 == 0, "-12").otherwise(F.concat(k % 1000, F.lit(".5")))
    return t.orders.select("o_orderkey", rnd(S.strict_decimal(s)).alias("value"), s.rlike("^[0-9]+$").alias("is_count"))


@query("sca_25_bands", f"""with {RISK_SQL} select {IDS}, case when score is null then 'unavailable' when score>=60 then 'supporting' when score<=40 then 'conflicting' else 'neutral' end as band from ri""")
def _(t):
    s = F.col("score")
    return risk_input(t).select(*ID, F.when(s.isNull(), "unavailable").when(s >= 60, "supporting").when(s <= 40, "conflicting").otherwise("neutral").alias("band"))


@query("sca_26_explanations", f"""with {RISK_SQL} select {IDS}, 'score='||case when score is null then 'unavailable' else cast(cast(score as bigint) as varchar) end||'; confidence='||cast(cast(confidence as bigint) as varchar)||'; form='||form as text from ri""")
def _(t):
    s = F.coalesce(F.col("score").cast("bigint").cast("string"), F.lit("unavailable"))
    return risk_input(t).select(*ID, F.format_string("score=%s; confidence=%d; form=%s", s, F.col("confidence").cast("bigint"), F.col("form")).alias("text"))
