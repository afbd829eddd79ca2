"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet as log probabilities of each language:

* text: byte trigrams of the whole lower-cased text under one smoothed trigram model per language. The models are counts over
  all texts by declared language, one grouped aggregation. Trigrams of one text depend on each other, so n of them weigh as
  n * REST / (n + REST).
* declared markup language: a confusion table of declared against text-only language, over all rows.
* address suffix: the share of each language that has the suffix, shrunk to the suffix's overall share.
* host prior: counts of text-only languages by host, smoothed towards those of its domain (last two labels), smoothed
  towards those of the whole table.

A row is kept if its text has a letter and the most probable language reaches ``least``.

Defined cases: a null or empty text, or one without letters, has no text evidence, counts nowhere and is rejected; null or
unknown declared languages and null addresses give no evidence of their kind; repeated rows are judged alike;
an empty table gives no rows; without any declared row all languages are equally probable.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_small, slices, stored

#: Languages of the production query; trigram classes; smoothing; the weight that text evidence tends to; least posterior.
LANGUAGES = ("de", "en", "es", "fr")
CLASSES, SMOOTH, SHRINK, REST, LEAST = 1 << 14, 0.5, 20.0, 200.0, 0.7


def trigrams(text: str | None) -> np.ndarray:
    """Class of each byte trigram of a lower-cased text, a space added at both ends; none for a text without letters."""
    if not text or not any(map(str.isalpha, text)):
        return np.zeros(0, np.int64)
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(18)).astype(np.int64)


def trigram_counts(rows: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Counts [language, class] over all rows whose declared language is one of ``languages``; a task sends its sums only."""
    place = {x: i for i, x in enumerate(languages)}

    def run(batches):
        counts = np.zeros((len(languages), CLASSES), np.int64)
        for batch in slices(batches):
            for text, declared in zip(batch.column("text").to_pylist(), batch.column("declared").to_pylist()):
                if (at := place.get(declared)) is not None and len(grams := trigrams(text)):
                    counts[at] += np.bincount(grams, minlength=CLASSES)
        i, j = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(counts[i, j])], ["language", "class", "n"])

    sums = rows.filter(F.col("declared").isin(*languages)).select("text", "declared").mapInArrow(run, "language int, class int, n long")
    got = sums.groupBy("language", "class").agg(F.sum("n").alias("n")).toArrow()  # languages * CLASSES rows at most
    out = np.zeros((len(languages), CLASSES))
    out[got["language"].to_numpy(), got["class"].to_numpy()] = got["n"].to_numpy()
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """Smoothed log probabilities [language, class]."""
    smoothed = counts + SMOOTH
    return np.log(smoothed / smoothed.sum(axis=1, keepdims=True))


def text_evidence(text: str | None, model: np.ndarray) -> np.ndarray | None:
    """Weighted log likelihood of each language; None without letters."""
    grams = trigrams(text)
    return model[:, grams].sum(axis=1) * (REST / (len(grams) + REST)) if len(grams) else None


def _text_only(model, languages):
    """declared, host and the place of the language that is most probable by text alone (null without letters)."""

    def run(batches):
        for batch in slices(batches):
            best = [None if (e := text_evidence(t, model.value)) is None else int(np.argmax(e)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("declared"), batch.column("host"), pa.array(best, pa.int32())], ["declared", "host", "best"])

    return run


def suffix_of(host: Column) -> Column:
    """Last label of a host with several labels; null else."""
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1))


def host_evidence(judged: DataFrame, languages: tuple[str, ...]) -> tuple[DataFrame, np.ndarray]:
    """host, prior (log, by language), suffix (log, by language) for every host, and the log prior of the whole table."""
    n = len(languages)
    counts = [F.count_if(F.col("best") == i).alias(f"n{i}") for i in range(n)]
    hosts = stored(judged.filter("best is not null").groupBy("host").agg(*counts).withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", suffix_of(F.col("host"))), "hosts")
    sums = lambda *by: hosts.groupBy(*by).agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(n)])
    total = np.array(sums().first(), np.float64)
    base = (total + 1) / (total.sum() + n)
    all_of = lambda prefix: F.aggregate(F.array(*[F.col(f"{prefix}{i}").cast("double") for i in range(n)]), F.lit(0.0), lambda a, x: a + x)
    domains = sums("domain").withColumnsRenamed({f"n{i}": f"d{i}" for i in range(n)})
    suffixes = sums("suffix").filter("suffix is not null").withColumnsRenamed({f"n{i}": f"s{i}" for i in range(n)})
    # domains and suffixes are as many as hosts at most; these joins never see the rows of the table itself
    both = join_small(join_small(hosts, domains, "domain", F.col("host")), suffixes, "suffix", F.col("host"))
    domain = [(F.col(f"d{i}") + F.lit(SHRINK * base[i])) / (all_of("d") + SHRINK) for i in range(n)]
    prior = [F.ln((F.col(f"n{i}") + SHRINK * domain[i]) / (all_of("n") + SHRINK)) for i in range(n)]
    share = all_of("s") / F.lit(float(max(1.0, total.sum())))
    suffix = [F.coalesce(F.ln((F.col(f"s{i}") + SHRINK * share) / F.lit(float(total[i] + SHRINK))), F.lit(0.0)) for i in range(n)]
    known = F.col("host").isNotNull()
    return stored(both.select("host", F.when(known, F.array(*prior)).alias("prior"), F.array(*suffix).alias("suffix")), "evidence"), np.log(base)


def declared_evidence(judged: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Log P(declared | language): [language, declared], zero in the last column (no known declaration)."""
    n = len(languages)
    known = judged.filter(F.col("best").isNotNull() & F.col("declared").isin(*languages)).groupBy("best", "declared").count().collect()  # n * n rows at most
    counts = np.ones((n, n))
    for best, declared, c in known:
        counts[best, languages.index(declared)] += c
    return np.hstack([np.log(counts / counts.sum(axis=1, keepdims=True)), np.zeros((n, 1))])


def identified(rows: DataFrame, text: Column, declared: Column, host: Column, languages: tuple[str, ...] = LANGUAGES, least: float = LEAST, carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``carry`` with language, posterior and keep of each row.

    Three passes over the texts, none of which shuffles them: trigram models, text-only languages for the evidence tables,
    and the fusion, with the host's evidence joined by a side of counted size.
    """
    base = rows.select(*carry, text.cast("string").alias("__text"), F.lower(F.substring(declared.cast("string"), 1, 2)).alias("__declared"), F.lower(host.cast("string")).alias("__host"))
    plain = base.select(F.col("__text").alias("text"), F.col("__declared").alias("declared"), F.col("__host").alias("host"))
    sc = rows.sparkSession.sparkContext
    model = sc.broadcast(log_model(trigram_counts(plain, languages)))
    judged = stored(plain.mapInArrow(_text_only(model, languages), "declared string, host string, best int"), "judged")
    hosts, table_prior = host_evidence(judged, languages)
    said = declared_evidence(judged, languages)
    place = {x: i for i, x in enumerate(languages)}
    joined = join_small(base, hosts.withColumnsRenamed({"host": "__host", "prior": "__prior", "suffix": "__suffix"}), "__host", F.xxhash64("__text"))
    joined = joined.select(*carry, "__text", "__declared", "__prior", "__suffix")
    schema = T.StructType([*joined.select(*carry).schema.fields, T.StructField("language", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def fuse(batches):
        for batch in slices(batches):
            names, sure, keep = [], [], []
            for t, d, p, s in zip(*(batch.column(c).to_pylist() for c in ("__text", "__declared", "__prior", "__suffix"))):
                evidence = text_evidence(t, model.value)
                total = said[:, place.get(d, len(languages))] + (table_prior if p is None else np.array(p)) + (0 if s is None else np.array(s))
                if evidence is not None:
                    total = total + evidence
                chance = np.exp(total - total.max())
                chance /= chance.sum()
                best = int(np.argmax(chance))
                names.append(languages[best])
                sure.append(float(chance[best]))
                keep.append(evidence is not None and chance[best] >= least)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(names), pa.array(sure), pa.array(keep)], schema.names)

    return joined.mapInArrow(fuse, schema)


def document_languages(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Documents declare their language in ``lang``; their source stands for the host."""
    return identified(docs, F.col("text"), F.col("lang"), F.col("source"), carry=carry)


def accepted(docs: DataFrame) -> DataFrame:
    """Documents whose language is clear."""
    packed = docs.select("text", "lang", "source", F.struct("*").alias("row"))
    return document_languages(packed, ("row",)).filter("keep").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def page_languages(pages: DataFrame) -> DataFrame:
    """Pages declare their language in the html element; suffix and host come from the url."""
    html = F.coalesce("html", F.lit(""))
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    declared = F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1), F.lit(""))
    host = F.nullif(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#:]*)", 1), F.lit(""))
    return identified(pages, body, declared, host, carry=("page_id",))
