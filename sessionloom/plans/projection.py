"""Filings projected on securities (JOB-43, JOB-45): issuers' change points meet link intervals in one ordered pass per issuer.

Links of an issuer are reduced to events per session first, so an issuer never has more rows than the calendar has sessions. Running sums
over the events say how many securities an issuer has at any time and, where it is one, which. Sessions are counted by the
lengths of the resulting segments, not by a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.numeric import first_failing

#: Upper ends of the age buckets in days; the last bucket is open.
AGES = (120, 240, 450, 730)
TIERS = ("as_operated", "reconstructed")


def bucket_names() -> list[str]:
    low = 0
    names = []
    for top in AGES:
        names.append(f"{low}_{top}")
        low = top + 1
    return [*names, f"{low}_plus"]


def link_sweep(links: DataFrame) -> DataFrame:
    """cik, from_ix, and for each kind of security how many are linked: n_all, n_common, and of the common ones sums of id, tier and clock.

    ``links``: cik, instrument_id, first_ix, last_ix, common, tier (index into TIERS, null without custody), observed_ix. A sum over one security is its own value.
    """
    c = F.col
    one = c("common").cast("int")
    fields = {"n_all": F.lit(1), "n_common": one, "id": one * c("instrument_id"), "tier": one * F.coalesce(c("tier") + 1, F.lit(0)), "observed": one * c("observed_ix")}
    ends = F.array(F.struct(c("first_ix").alias("from_ix"), F.lit(1).alias("sign")), F.struct((c("last_ix") + 1).alias("from_ix"), F.lit(-1).alias("sign")))
    events = links.select("cik", *[x.cast("bigint").alias(k) for k, x in fields.items()], F.inline(ends))
    events = events.groupBy("cik", "from_ix").agg(*[F.sum(c(k) * c("sign")).alias(k) for k in fields])
    run = Window.partitionBy("cik").orderBy("from_ix").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("cik", "from_ix", *[F.sum(k).over(run).alias(k) for k in fields])


def projected(points: DataFrame, sweep: DataFrame, concepts: DataFrame, last: int, day_of_first: Column) -> DataFrame:
    """Segments of (issuer, concept) in which one common security is linked: cik, concept, instrument_id, tier, from_ix, to_ix, status, first_age.

    A link of session s is evaluated at s + 1. ``points``: cik, concept, session_ix, status, period_end; before the first point the status is unavailable.
    """
    c = F.col
    state = F.struct("n_common", "id", "tier")
    links = sweep.join(concepts, "cik").select("cik", "concept", (c("from_ix") + 1).alias("ix"), state.alias("link"), F.lit(None).cast(points.select(F.struct("status", "period_end").alias("p")).schema["p"].dataType).alias("point"))
    facts = points.select("cik", "concept", c("session_ix").alias("ix"), F.lit(None).cast(links.schema["link"].dataType).alias("link"), F.struct("status", "period_end").alias("point"))
    merged = links.unionByName(facts).groupBy("cik", "concept", "ix").agg(F.max("link").alias("link"), F.max("point").alias("point"))
    w = Window.partitionBy("cik", "concept").orderBy("ix")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    s = merged.select("cik", "concept", c("ix").alias("from_ix"), (F.least(F.lead("ix").over(w), F.lit(last + 1)) - 1).alias("to_ix"), F.last("link", ignorenulls=True).over(past).alias("link"), F.last("point", ignorenulls=True).over(past).alias("point"))
    s = s.where((c("link.n_common") == 1) & (c("link.tier") > 0) & (c("to_ix") >= c("from_ix")))
    age = F.datediff(F.date_add(day_of_first, ((c("from_ix") - 1) * 7).cast("int")), c("point.period_end"))
    status = F.coalesce("point.status", F.lit("unavailable"))
    return s.select("cik", "concept", c("link.id").alias("instrument_id"), F.element_at(F.array(*[F.lit(x) for x in TIERS]), c("link.tier").cast("int")).alias("tier"), "from_ix", "to_ix", status.alias("status"), F.when(status == "selected", age).alias("first_age"))


def by_age(segments: DataFrame) -> DataFrame:
    """concept, tier, status, age bucket: sessions (by length), securities and segments; ages rise by seven days a session."""
    c = F.col
    size = c("to_ix") - c("from_ix") + 1
    young = [F.greatest(F.lit(0), F.least(size, F.floor((F.lit(t) - c("first_age")) / 7) + 1)) for t in AGES]
    counts = [young[0], *[b - a for a, b in zip(young, young[1:])], size - young[-1]]
    parts = F.when(c("first_age").isNull(), F.array(F.struct(F.lit("none").alias("age"), size.cast("bigint").alias("n")))).otherwise(F.array(*[F.struct(F.lit(k).alias("age"), x.cast("bigint").alias("n")) for k, x in zip(bucket_names(), counts)]))
    tall = segments.select("concept", "tier", "status", "instrument_id", F.inline(parts)).where("n > 0")
    return tall.groupBy("concept", "tier", "status", "age").agg(F.sum("n").alias("n_sessions"), F.countDistinct("instrument_id").alias("n_instruments"))


def applicability(endpoints: DataFrame, sweep: DataFrame, last: int) -> DataFrame:
    """Each endpoint with its first failing stage; ``endpoints``: cik, endpoint, session_ix of the latest component (null if any is unknown).

    The links of an issuer at that session are the last event of its sweep at or before it.
    """
    c = F.col
    state = F.struct("n_all", "n_common", "id", "tier", "observed")
    kind = sweep.select(state.alias("s")).schema["s"].dataType
    probes = endpoints.where("session_ix is not null").select("cik", c("session_ix").alias("ix"), F.lit(None).cast(kind).alias("s")).distinct().withColumn("probe", F.lit(True))
    rows = sweep.select("cik", c("from_ix").alias("ix"), state.alias("s")).withColumn("probe", F.lit(False)).unionByName(probes)
    w = Window.partitionBy("cik").orderBy("ix", "probe").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("l", F.last("s", ignorenulls=True).over(w)).where("probe").select("cik", c("ix").alias("session_ix"), "l")
    e = endpoints.join(found, ["cik", "session_ix"], "left")
    n = lambda x: F.coalesce(c(f"l.{x}"), F.lit(0))
    blocker = first_failing(
        (c("session_ix").isNull(), "financial_lineage_signal_session_missing"), (c("session_ix") > last, "identity_link_session_unavailable"), (n("n_all") == 0, "stable_security_cik_link_missing_or_quarantined"),
        (n("n_common") == 0, "no_common_security_at_signal_session"), (n("n_common") > 1, "multiple_common_securities_for_cik"), (n("tier") != 1, "identity_evidence_outcome_reconciliation_only"),
        (n("observed") >= c("session_ix"), "identity_evidence_not_known_by_signal_open"), ok="security_form_not_effective_dated")
    return e.select("cik", "endpoint", "session_ix", n("n_all").alias("n_linked"), n("n_common").alias("n_common"), F.when(n("n_common") == 1, c("l.id")).alias("instrument_id"), blocker.alias("blocker"))
