"""Landed files to tables: explicit schemas, permissive parsing, a quarantine side for what does not parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPED = "results array<struct<T:string,o:double,h:double,l:double,c:double,v:double,n:bigint,t:bigint>>"
GROUPED_NAMED = "array<struct<ticker:string,open:double,high:double,low:double,close:double,volume:double,trades:bigint,millis:bigint>>"
SUBMISSIONS = "accession array<string>, form array<string>, accepted array<string>"
FACTS = "cik bigint, facts map<string,map<string,struct<units:map<string,array<struct<accn:string,val:double,`end`:string>>>>>>"
CSV_BARS = "ticker string, volume double, open double, close double, high double, low double, window_start bigint, transactions bigint"
ACTION = "id string, kind string, ticker string, ex_ix int, split_from double, split_to double, cash double"


def grouped_daily(payloads: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """SRC-08: grouped-daily JSON pages to one row per raw bar."""
    parsed = payloads.select(*keep, F.from_json(text, GROUPED, {"mode": "PERMISSIVE"}).alias("_p"))
    # keys T and t differ only in case, so fields are renamed by position before they are read
    named = F.col("_p.results").cast(GROUPED_NAMED)
    return parsed.select(*keep, F.explode_outer(named).alias("_r")).select(*keep, "_r.*")


def day_aggregates(lines: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """SRC-11: day-aggregate CSV lines with a fixed schema."""
    return lines.select(*keep, F.from_csv(text, CSV_BARS, {"mode": "PERMISSIVE"}).alias("_c")).select(*keep, "_c.*")


def action_observations(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """SRC-10: split / dividend JSON rows to one observation schema, and the rows it cannot represent."""
    p = rows.select(F.from_json(text, ACTION).alias("a")).select("a.*")
    c = F.col
    issue = (
        F.when(c("id").isNull(), "identifier_missing").when(~c("kind").isin("split", "dividend"), "unknown_kind").when(c("ex_ix").isNull(), "date_missing")
        .when((c("kind") == "split") & ~((c("split_from") > 0) & (c("split_to") > 0)), "ratio_not_positive")
        .when((c("kind") == "dividend") & ~(c("cash") > 0), "cash_not_positive"))
    p = p.withColumn("issue", issue)
    good = p.where("issue is null").select("id", "kind", "ticker", "ex_ix", F.when(c("kind") == "split", c("split_from") / c("split_to")).alias("price_ratio"), F.when(c("kind") == "dividend", c("cash")).alias("cash"))
    return good, p.where("issue is not null").select("id", "kind", "issue")


def company_facts(docs: DataFrame, text: str) -> DataFrame:
    """SRC-12: nested facts to one row per occurrence, with its ordinal."""
    p = docs.select(F.from_json(text, FACTS).alias("p")).select("p.cik", F.explode("p.facts").alias("namespace", "_c"))
    p = p.select("cik", "namespace", F.explode("_c").alias("concept", "_u")).select("cik", "namespace", "concept", F.explode("_u.units").alias("unit", "_f"))
    return p.select("cik", "namespace", "concept", "unit", F.posexplode("_f").alias("ordinal", "_o")).select(
        "cik", "namespace", "concept", "unit", "ordinal", F.col("_o.accn").alias("accession"), F.col("_o.val").alias("value"), F.col("_o.end").alias("end_date"))


def submissions(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """SRC-13: parallel arrays to rows; arrays of unequal length are flagged, not zipped."""
    p = docs.select(*keep, F.from_json(text, SUBMISSIONS).alias("p")).select(*keep, "p.*")
    same = (F.size("accession") == F.size("form")) & (F.size("form") == F.size("accepted"))
    zipped = F.when(same, F.arrays_zip("accession", "form", "accepted")).otherwise(F.array(F.struct(
        F.lit(None).cast("string").alias("accession"), F.lit("columns_differ").alias("form"), F.lit(None).cast("string").alias("accepted"))))
    return p.select(*keep, F.explode(zipped).alias("_z")).select(*keep, "_z.*")


def payload_kind(text: Column) -> Column:
    """SRC-14: malformed, object, array or scalar payload."""
    t = F.trim(text)
    return (F.when(F.try_parse_json(text).isNull(), "malformed").when(t.startswith("{"), "object").when(t.startswith("["), "array").otherwise("scalar"))


def choose_source(packages: DataFrame, session: str, priority: str) -> DataFrame:
    """SRC-20: the single valid package of the best priority; several at that priority are ambiguous."""
    valid = F.col("valid")
    g = packages.groupBy(session).agg(
        F.min(F.when(valid, F.col(priority))).alias("_best"))
    best = packages.join(g.select(session, "_best"), session).groupBy(session).agg(
        F.count_if(valid & (F.col(priority) == F.col("_best"))).alias("n_best"), F.min(F.when(valid & (F.col(priority) == F.col("_best")), F.col("package"))).alias("_pick"))
    return best.select(session, F.when(F.col("n_best") == 0, "missing").when(F.col("n_best") == 1, "selected").otherwise("ambiguous").alias("status"), F.when(F.col("n_best") == 1, F.col("_pick")).alias("package"))
