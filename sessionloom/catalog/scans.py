"""SRC-*: scans, ingestion and sinks over payloads derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.core import R, query
from sessionloom.catalog.sqltext import MASTER, SPLITS, DIVIDENDS, bars as B
from sessionloom.functions.numeric import rnd
from sessionloom.sources import ingest as G
from sessionloom.sources import sinks
from sessionloom.sources.fixtures import bars, bars_between, dividends, master, splits

ID = ["instrument_id", "session_ix"]
IDS = "instrument_id, session_ix"


@query("src_01_session_scan", f"with {B()}, {MASTER} select b.instrument_id, ticker, form, exchange, {R('close', 8)} as close, volume from b join m using (instrument_id) where session_ix=200")
def _(t):
    b = bars_between(t, 200, 200).join(master(t), "instrument_id")
    return b.select("instrument_id", "ticker", "form", "exchange", rnd("close", 8).alias("close"), "volume")


@query("src_02_session_set", f"with {B()} select session_ix, count(*) as n, sum(volume) as volume from b where session_ix in (10,20,30,40) group by 1")
def _(t):
    return bars_between(t, 10, 40).where(F.col("session_ix").isin(10, 20, 30, 40)).groupBy("session_ix").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query("src_03_session_index", f"with {B()} select distinct session_ix, cast(session_date as varchar) as session_date from b")
def _(t):
    return bars(t).select("session_ix", F.col("session_date").cast("string").alias("session_date")).distinct()


@query("src_04_presence_scan", "select distinct l_suppkey as instrument_id, cast(date_diff('day', date '1995-01-02', cast(date_trunc('week', l_shipdate) as date))//7+1 as int) as session_ix from lineitem")
def _(t):
    from sessionloom.sources.fixtures import session_index, session_start

    return t.lineitem.select(F.col("l_suppkey").alias("instrument_id"), session_index(session_start("l_shipdate", "week"), "week").alias("session_ix")).distinct()


@query("src_05_projected_scan", f"with {B()} select {IDS}, {R('open', 8)} as open, {R('close', 8)} as close from b")
def _(t):
    return bars(t).select(*ID, rnd("open", 8).alias("open"), rnd("close", 8).alias("close"))


@query("src_06_publish_plan", f"""with {B()}, n as (select session_ix, bool_or((instrument_id+session_ix)%97=0) as changed from b group by 1) select session_ix, case when session_ix>300 then 'write' when changed then 'conflict' else 'no_op' end as action from n""")
def _(t):
    b = bars(t).select(*ID, "close", "volume")
    new = b.withColumn("volume", F.when((F.col("instrument_id") + F.col("session_ix")) % 97 == 0, F.col("volume") + 1).otherwise(F.col("volume")))
    return sinks.publish_plan(new, b.where("session_ix <= 300"), ["close", "volume"])


def payload_pages(t):
    """Grouped-daily pages: at most 50 instruments of one session each."""
    page = F.floor(F.col("instrument_id") / 50).alias("page")
    item = F.struct(F.concat(F.lit("S"), "instrument_id").alias("T"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"),
                    F.col("trades").alias("n"), F.unix_millis(F.col("session_date").cast("timestamp")).alias("t"))
    return bars(t).groupBy("session_ix", page).agg(F.to_json(F.struct(F.collect_list(item).alias("results"))).alias("body"))


@query("src_08_grouped_daily", f"with {B()} select session_ix, 'S'||instrument_id as ticker, {R('close', 8)} as close, volume, trades, epoch_ms(cast(session_date as timestamp)) as millis from b")
def _(t):
    return G.grouped_daily(payload_pages(t), "body", ["session_ix"]).select("session_ix", "ticker", rnd("close", 8).alias("close"), "volume", "trades", "millis")


def action_json(t):
    s = splits(t).select(F.to_json(F.struct(F.col("action_id").alias("id"), F.lit("split").alias("kind"), "ticker", F.col("effective_ix").alias("ex_ix"),
                                            F.when(F.col("instrument_id") % 24 == 0, 0).otherwise(F.col("split_from")).cast("double").alias("split_from"), F.col("split_to").cast("double").alias("split_to"))).alias("body"))
    d = dividends(t, bars(t)).select(F.to_json(F.struct(F.when(F.col("instrument_id") % 9 != 0, F.col("action_id")).alias("id"), F.lit("dividend").alias("kind"), F.col("ex_ix"), F.col("cash"))).alias("body"))
    return s.unionAll(d)


@query("src_10_action_mapping", f"""with {B()}, {SPLITS}, {DIVIDENDS}, x as (select action_id as id, 'split' as kind, case when instrument_id%24=0 then 'ratio_not_positive' end as issue from sp union all select case when instrument_id%9<>0 then action_id end, 'dividend', case when instrument_id%9=0 then 'identifier_missing' end from dv)
 select coalesce(issue,'mapped') as outcome, kind, count(*) as n from x group by 1,2""")
def _(t):
    good, issues = G.action_observations(action_json(t), "body")
    return good.select(F.lit("mapped").alias("outcome"), "kind").unionAll(issues.select("issue", "kind")).groupBy("outcome", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("src_11_day_aggregates", f"with {B()} select session_ix, 'S'||instrument_id as ticker, volume, {R('close', 8)} as close, trades as transactions from b")
def _(t):
    line = F.concat_ws(",", F.concat(F.lit("S"), "instrument_id"), "volume", "open", "close", "high", "low", F.lit(0), "trades")
    lines = bars(t).select("session_ix", line.alias("body"))
    return G.day_aggregates(lines, "body", ["session_ix"]).select("session_ix", "ticker", "volume", rnd("close", 8).alias("close"), "transactions")


def facts_docs(t):
    """One document per issuer and filing block: facts{namespace{concept{units{unit[fact]}}}}."""
    o = t.orders
    fact = F.struct(F.col("o_orderkey").cast("string").alias("accn"), F.col("o_totalprice").alias("val"), F.to_date("o_orderdate").cast("string").alias("end"))
    per = o.groupBy("o_custkey", F.floor(F.col("o_orderkey") / 2000).alias("blk"), "o_orderpriority").agg(F.collect_list(fact).alias("fs"))
    concept = F.map_from_entries(F.collect_list(F.struct("o_orderpriority", F.struct(F.create_map(F.lit("USD"), F.col("fs")).alias("units")))))
    docs = per.groupBy("o_custkey", "blk").agg(concept.alias("c"))
    return docs.select(F.to_json(F.struct(F.col("o_custkey").alias("cik"), F.create_map(F.lit("gaap"), F.col("c")).alias("facts"))).alias("body"))


@query("src_12_company_facts", f"select o_custkey as cik, 'gaap' as namespace, o_orderpriority as concept, 'USD' as unit, cast(o_orderkey as varchar) as accession, {R('o_totalprice', 4)} as value, cast(cast(o_orderdate as date) as varchar) as end_date from orders")
def _(t):
    return G.company_facts(facts_docs(t), "body").select("cik", "namespace", "concept", "unit", "accession", rnd("value", 4).alias("value"), "end_date")


@query("src_13_submissions", """with d as (select o_custkey as cik, o_orderkey//2000 as blk, count(*) as n from orders group by 1,2), o as (select o.o_custkey as cik, o.o_orderkey//2000 as blk, cast(o_orderkey as varchar) as accession, o_orderstatus as form from orders o)
 select cik, accession, form from o where (cik+blk)%11<>0 union all select cik, null, 'columns_differ' from d where (cik+blk)%11=0""")
def _(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("cik"), F.floor(F.col("o_orderkey") / 2000).alias("blk")).agg(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("a"), F.col("o_orderstatus").alias("f"), F.col("o_orderdate").cast("string").alias("d"))).alias("x"))
    dates = F.when((F.col("cik") + F.col("blk")) % 11 == 0, F.array().cast("array<string>")).otherwise(F.col("x.d"))
    docs = o.select("cik", F.to_json(F.struct(F.col("x.a").alias("accession"), F.col("x.f").alias("form"), dates.alias("accepted"))).alias("body"))
    return G.submissions(docs, "body", ["cik"]).select("cik", "accession", "form")


@query("src_14_payload_census", """with x as (select event_type, case when event_id%10=0 then substr(props,1,4) when event_id%7=0 then '['||props||']' when event_id%5=0 then '12' else props end as b from events)
 select event_type, case when not json_valid(b) then 'malformed' when b like '{%' then 'object' when b like '[%' then 'array' else 'scalar' end as kind, count(*) as n from x group by 1,2""")
def _(t):
    k, p = F.col("event_id"), F.col("props")
    body = F.when(k % 10 == 0, F.substring(p, 1, 4)).when(k % 7 == 0, F.concat(F.lit("["), p, F.lit("]"))).when(k % 5 == 0, "12").otherwise(p)
    return t.events.groupBy("event_type", G.payload_kind(body).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("src_16_month_accounting", """select strftime(date_trunc('month', o_orderdate),'%Y-%m') as month, count(*) as n_rows, count(distinct o_custkey) as n_securities, count(*) filter (o_orderstatus='F') as n_events from orders group by 1""")
def _(t):
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_custkey").alias("n_securities"), F.count_if(F.col("o_orderstatus") == "F").alias("n_events"))


@query("src_17_visible_text", r"""with a as (select page_id, regexp_replace(html,'(?is)<(script|style)\b.*?</(script|style)>',' ','g') as x from pages), b as (select page_id, regexp_replace(regexp_replace(x,'(?s)<!--.*?-->',' ','g'),'(?s)<[^>]*>',' ','g') as x from a),
 c as (select page_id, replace(replace(replace(replace(replace(replace(x,'&nbsp;',' '),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&amp;','&') as x from b), d as (select page_id, trim(regexp_replace(x,'[ \t\r\n\f]+',' ','g')) as x from c)
 select page_id, length(x) as n_chars, cast(strlen(x) as bigint) as n_bytes, sha256(x) as digest from d""")
def _(t):
    from sessionloom.functions.scalars import visible_text

    d = t.pages.select("page_id", visible_text(F.col("html")).alias("x"))
    return d.select("page_id", F.length("x").cast("bigint").alias("n_chars"), F.octet_length("x").cast("bigint").alias("n_bytes"), F.sha2("x", 256).alias("digest"))


@query("src_19_snapshot_split", f"with {B()} select session_ix, count(*) as n, count(*) as n_equal from b group by 1")
def _(t):
    b = bars(t)
    summary, detail = b.select(*ID, "close"), b.select(*ID, "open", "high", "low", "volume")
    back = summary.join(detail, ID).select(*ID, F.struct("open", "high", "low", "close", "volume").alias("r"))
    j = b.select(*ID, F.struct("open", "high", "low", "close", "volume").alias("o")).join(back, ID, "full_outer")
    return j.groupBy("session_ix").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o").eqNullSafe(F.col("r"))).alias("n_equal"))


@query("src_20_source_choice", f"""with {B()}, p as (select session_ix, instrument_id as package, instrument_id%5 as pr, (instrument_id+session_ix)%7=0 and instrument_id%6=1 as valid from b), m as (select session_ix, min(pr) filter (valid) as best from p group by 1),
 g as (select p.session_ix, count(*) filter (valid and pr=best) as n, min(package) filter (valid and pr=best) as pick from p join m using (session_ix) group by 1) select session_ix, case n when 0 then 'missing' when 1 then 'selected' else 'ambiguous' end as status, case when n=1 then pick end as package from g""")
def _(t):
    k = F.col("instrument_id")
    p = bars(t).select("session_ix", k.alias("package"), (k % 5).alias("pr"), (((k + F.col("session_ix")) % 7 == 0) & (k % 6 == 1)).alias("valid"))
    return G.choose_source(p, "session_ix", "pr")
