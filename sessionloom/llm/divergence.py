"""Audit of how the sources of a language differ in their words.

A document's sparse vector is its term counts. Terms found in ``min_df`` documents of their language are its vocabulary, without
a cap on its size. Each task adds vectors into sums per (language, source) and Spark merges the tasks' sums. A group gives a
kept term with count c the share p = 1 + floor(10**9 (c + 1) / (N + V)), N being its words in the vocabulary and V the size of that; f(p, q) =
floor((p - q)**2 / q) tells two shares apart, and a pair of groups by the sum of f over the vocabulary. That sum is taken sparsely: all
terms as if absent from both groups, a correction for each distinct count of either group (terms with equal
counts differ alike), and one for each term that both have.

Vocabulary and sums stay tables: a fitted ``CountVectorizerModel`` holds its vocabulary on the driver and in each executor, and that grows with the corpus.

Defined cases: null text, lang and source are ''; a group without kept terms takes part with the shares of absent terms; in a
language without kept terms all pairs have value 0; very long texts are counted whole; repeated rows count again; an empty
table gives no rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SALTS, join_counted, slices, stored

#: The share of a whole, the documents that a kept term needs, the ranks of the part ``term``.
WHOLE, MIN_DF, RANKS = 1_000_000_000, 3, 200
#: Bytes of a UTF-8 text to spaces, or A-Z to a-z, so that what is left between spaces are its terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms that a task holds before it hands its sums on, and pairs of groups compared at once.
HELD, PAIRS = 800_000, 1 << 20


def terms(text: str) -> list[str]:
    """Terms of a text in order: runs of letters and of characters beyond ASCII, only A-Z lower-cased."""
    return [t.decode("utf-8", "surrogatepass") for t in text.encode("utf-8", "surrogatepass").translate(_FOLD).split()]


def _vector(text: str) -> Counter:
    return Counter(text.encode("utf-8", "surrogatepass").translate(_FOLD).split())


def _sums(batches, most: int = HELD):
    """Sums of the vectors of a task's documents per (lang, source), term b'' standing for the group itself.

    A sum holds occurrences and documents in one integer, the latter in its lower half. Sums are handed on whenever ``most`` are held.
    """
    held: dict[tuple, dict] = {}
    size = 0

    def out():
        for (lang, source), sums in held.items():
            n = len(sums)
            words, values = pa.array(list(sums), pa.binary()).cast(pa.string()), np.fromiter(sums.values(), np.int64, n)
            batch = pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n), words, pa.array(values >> 31), pa.array(values & 0x7FFFFFFF)], ["lang", "source", "term", "c", "d"])
            for at in range(0, n, 50_000):
                yield batch.slice(at, 50_000)

    for batch in slices(batches):
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            sums = held.get((lang, source))
            if sums is None:
                sums = held[lang, source] = {b"": 0}
            before, get = len(sums), sums.get
            for t, c in _vector(text).items():
                sums[t] = get(t, 0) + (c << 31) + 1
            size += len(sums) - before
            if size > most:
                yield from out()
                held, size = {}, 0
    yield from out()


def group_sums(docs: DataFrame) -> DataFrame:
    """lang, source, term, c (occurrences), d (documents); term '' with zeros names a group."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = rows.mapInArrow(_sums, "lang string, source string, term string, c long, d long")
    # a task's sums are merged already; dealt by term, those of one term also meet for the vocabulary
    return parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def vocabulary(sums: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """lang, term, in_lang (occurrences in the language) of the kept terms."""
    return sums.filter("term <> ''").groupBy("lang", "term").agg(F.sum("c").alias("in_lang"), F.sum("d").alias("docs")).filter(F.col("docs") >= min_df).drop("docs")


def document_vectors(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, doc_id, term, c: the vectors themselves, one row per document and kept term, for other uses than sums."""
    fold = F.udf(terms, "array<string>")
    rows = docs.select("doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "text")])
    return rows.select("doc_id", "lang", F.explode(fold("text")).alias("term")).groupBy("doc_id", "lang", "term").agg(F.count("*").alias("c")).join(kept.select("lang", "term"), ["lang", "term"])


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10**9 (count + 1) / (n + v)), in decimals where a long might not hold the product; null for an empty vocabulary."""
    whole = F.greatest(n + v, F.lit(1))
    top = F.lit(WHOLE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    short = F.call_function("div", (count + 1).cast("long") * F.lit(WHOLE).cast("long"), whole.cast("long"))
    return F.when(v > 0, F.lit(1) + F.when(count < (1 << 33), short).otherwise(F.call_function("div", top, whole.cast("decimal(19,0)")))).cast("long")


def _far(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _both(batches):
    """Corrections for terms that two groups have; rows come with all groups of a term together.

    f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), summed per pair of groups over ``PAIRS`` pairs at a time.
    """
    far = lambda p, q: (p - q) ** 2 // q

    def out(lang, starts, source, p, p0):
        # each row meets all rows of its term: row x of a run of k rows gives k pairs
        ends = np.append(starts[1:], len(p))
        first, size = np.repeat(starts, ends - starts), np.repeat(ends - starts, ends - starts)
        code, names = pd.factorize(pd.Series(source))
        name = pd.Series(names)
        for lo, hi in _blocks(size):
            a = np.repeat(np.arange(lo, hi), size[lo:hi])
            b = np.arange(len(a)) - np.repeat(np.cumsum(size[lo:hi]) - size[lo:hi], size[lo:hi]) + first[a]
            a, b = a[a != b], b[a != b]
            if not len(a):
                continue
            v = far(p[a], p[b]) - far(p[a], p0[b]) - far(p0[a], p[b]) + far(p0[a], p0[b])
            keys, at = np.unique(code[a].astype(np.int64) * len(names) + code[b], return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at, v)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(keys), pa.string()), pa.array(name.iloc[keys // len(names)].tolist(), pa.string()), pa.array(name.iloc[keys % len(names)].tolist(), pa.string()), pa.array(sums)], ["lang", "source", "item", "value"])

    for lang, rows in _whole_terms(batches):
        starts = np.flatnonzero(np.r_[True, rows["term"].to_numpy()[1:] != rows["term"].to_numpy()[:-1]])
        yield from out(lang, starts, rows["source"].tolist(), rows["p"].to_numpy(), rows["p0"].to_numpy())


def _blocks(size: np.ndarray):
    """Ranges of rows whose pairs fit ``PAIRS``, one row at least."""
    total = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
        yield lo, hi
        lo = hi


def _whole_terms(batches):
    """(lang, rows) where no term's rows are split; rows come ordered by lang and term."""
    left = None
    for batch in itertools.chain(batches, [None]):
        rows = left if batch is None else pd.concat([left, batch.to_pandas()], ignore_index=True) if left is not None else batch.to_pandas()
        if rows is None or rows.empty:
            continue
        if batch is not None:
            end = (rows["lang"] == rows["lang"].iloc[-1]) & (rows["term"] == rows["term"].iloc[-1])
            rows, left = rows[~end], rows[end]
        yield from ((lang, part) for lang, part in rows.groupby("lang", sort=False))


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = rows.withColumn("rank", place)
    out = out if most is None else out.filter(F.col("rank") <= most)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _with_others(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (lang, ...) beside each group of their language, as (item, q0): what a result of all pairs of groups asks for."""
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    if groups.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(others), "lang")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    return salted.join(others.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["lang", "salt"]).drop("salt")


def audit(docs: DataFrame, min_df: int = MIN_DF, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of the language, and the terms that the source has more of."""
    of_term = Window.partitionBy("lang", "term")
    sums = group_sums(docs).withColumn("in_lang", F.sum("c").over(of_term)).withColumn("docs", F.sum("d").over(of_term)).withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1)
    # the rows of a group itself have no term; a term counts towards its vocabulary once
    counts = stored(sums.filter((F.col("docs") >= min_df) | (F.col("term") == "")).drop("docs"), "counts")
    terms_ = counts.filter("term <> ''")
    langs = terms_.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("c").alias("n_lang"))
    sizes = terms_.groupBy("lang", "source").agg(F.sum("c").alias("n_group"), F.count("*").alias("n"))
    groups = counts.filter("term = ''").select("lang", "source").join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").fillna(0, ["v", "n_lang", "n_group", "n"])
    groups = stored(groups.withColumn("p0", _share(F.lit(0), F.col("n_group"), F.col("v"))), "groups")
    if groups.count() <= BROADCAST_ROWS:
        there = terms_.join(F.broadcast(groups), ["lang", "source"])
    else:
        there = stored(join_counted(terms_, groups.filter("n > 0"), ["lang", "source"], ["term"]), "shares")
    there = there.select("lang", "source", "term", "p0", _share(F.col("c"), F.col("n_group"), F.col("v")).alias("p"), _share(F.col("in_lang"), F.col("n_lang"), F.col("v")).alias("q"))

    more = there.filter("p > q").select("lang", "source", F.col("term").alias("item"), _far(F.col("p"), F.col("q")).alias("value"))

    absent = _with_others(groups.select("lang", "source", "v", "p0"), groups).filter("item <> source")
    absent = absent.select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * _far(F.col("p0"), F.col("q0"))).otherwise(0).alias("value"))
    # terms of a group that have equal counts have equal shares
    alike = stored(there.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("k")), "alike")
    single = _with_others(alike, groups).filter("item <> source")
    none = lambda a, b: _far(F.col(a), F.col(b))
    ahead = F.struct("source", "item", (F.col("k") * (none("p", "q0") - none("p0", "q0"))).alias("value"))
    back = F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("k") * (none("q0", "p") - none("q0", "p0"))).alias("value"))
    single = single.select("lang", F.inline(F.array(ahead, back)))
    shared = there.select("lang", "source", "term", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_both, "lang string, source string, item string, value long")
    pairs = absent.unionByName(single).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(pairs, "pair").unionByName(_ranked(more, "term", ranks))
