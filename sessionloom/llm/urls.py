"""URL rules by a cascade of Bloom filters.

A rule is a host and a path prefix. Each url names the few keys that could be a rule for it: a host suffix of as many labels
as some rule has, joined with a path prefix as long as some rule's. Of all keys that the corpus names (the universe), the
first filter encodes the listed ones, the second the false positives of the first, the third the listed keys that the
second takes for false positives, and so on until none is left. A key of the universe is then judged by the first
filter that denies it, without a join and without error.

Defined cases: a null url, or one without ``://``, has an empty host and path, so no rule fits; repeated urls are judged
alike; an empty table gives no rows; a key in both lists is refused with ValueError.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: The rules of the contract, (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Bytes that all filters of a cascade may have together; they are sent to every executor.
MAX_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Level:
    """One Bloom filter: ``bits`` positions (a multiple of 64), ``hashes`` probes, and its own mixing constant."""

    bits: int
    hashes: int
    salt: int
    words: np.ndarray = field(repr=False, default=None)

    def positions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (a.astype(np.uint64) ^ np.uint64(self.salt)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            step = b.astype(np.uint64) * np.uint64(2 * self.salt + 1) | np.uint64(1)
            probes = x[:, None] + step[:, None] * np.arange(self.hashes, dtype=np.uint64)[None, :]
            probes ^= probes >> np.uint64(32)
        return probes % np.uint64(self.bits)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.positions(a, b)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


@dataclass
class Cascade:
    """Levels in order; a key that all levels hold is listed if their number is odd."""

    levels: list[Level]

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        answer = np.full(len(a), len(self.levels) % 2 == 1)
        open_ = np.arange(len(a))
        for i, level in enumerate(self.levels):
            held = level.holds(a[open_], b[open_])
            answer[open_[~held]] = i % 2 == 1
            open_ = open_[held]
        return answer


def key_hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes of a key."""
    return [F.xxhash64(F.lit(17), key).alias("a"), F.xxhash64(F.lit(91), key).alias("b")]


def _hash_columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)


def _encoded(keys: DataFrame, level: Level) -> Level:
    """Set the level's bits for all ``keys``: each task combines its own words, one bit_or joins them."""

    def bits(batches):
        for batch in batches:
            at = level.positions(*_hash_columns(batch)).ravel()
            words, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            masks = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(masks, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(masks.view(np.int64))], ["word", "mask"])

    level.words = np.zeros(level.bits // 64, np.uint64)
    # at most bits / 64 rows, which MAX_BYTES bounds
    for word, mask in keys.select("a", "b").mapInArrow(bits, "word long, mask long").groupBy("word").agg(F.bit_or("mask")).collect():
        level.words[word] = np.uint64(mask & 0xFFFFFFFFFFFFFFFF)
    return level


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    """Keys that the level holds."""
    sent = keys.sparkSession.sparkContext.broadcast(level)

    def held(batches):
        for batch in batches:
            yield batch.filter(pa.array(sent.value.holds(*_hash_columns(batch))))

    return keys.mapInArrow(held, keys.schema)


def build_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES) -> Cascade | None:
    """Cascade for the ``listed`` keys (column key) that is exact for every key of ``universe``; None if it outgrows ``max_bytes``.

    The first filter gets a false positive rate of about listed / universe, the others one half each, so all
    levels together hold a few bits for each listed key and logarithm of the universe.
    """
    listed = stored(listed.select("key").filter(F.col("key").isNotNull()).distinct().select("key", *key_hashes(F.col("key"))), "listed")
    universe = universe.select("key").filter(F.col("key").isNotNull()).distinct().select("key", *key_hashes(F.col("key")))
    n, others = listed.count(), None
    total = universe.count() if n else 0
    inside, levels, used = listed, [], 0
    while n:
        rate = 0.5 if levels else min(0.5, max(1e-9, n / max(1, total)))
        bits = max(64, 64 * math.ceil(n * math.log(1 / rate) / math.log(2) ** 2 / 64))
        used += bits // 8
        if used > max_bytes:
            return None
        level = _encoded(inside, Level(bits, max(1, round(math.log2(1 / rate))), 2 * len(levels) + 3))
        levels.append(level)
        against = universe if others is None else others
        wrong = _passing(against, level)
        if others is None:
            wrong = wrong.join(listed.select("key"), "key", "left_anti")
        inside, others = stored(wrong, "level"), inside
        n = inside.count()
    return Cascade(levels)


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty for null and without ``://``."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, r"://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(text, r"://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, rules) -> Column:
    """Array of the keys that could be a rule for a url, longest first (then longer host)."""
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, *_ in rules})
    labels = F.size(F.split(host, r"\."))
    made = [
        F.when((labels >= n) & (F.length(path) >= p), F.struct((-F.length(F.substring_index(host, ".", -n)) - p).alias("a"), (-F.length(F.substring_index(host, ".", -n))).alias("b"), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, p)).alias("key")))
        for n, p in shapes
    ]
    return F.transform(F.array_sort(F.array_compact(F.array(*made))), lambda x: x["key"])


def _first_listed(rows: DataFrame, cascades: dict[str, Cascade]) -> DataFrame:
    """Add, for each name of ``cascades``, the place of the first key of array ``keys`` that it lists (from 1; 0: none)."""
    sent = rows.sparkSession.sparkContext.broadcast(cascades)
    names = list(cascades)
    schema = T.StructType(rows.schema.fields + [T.StructField(x, T.IntegerType()) for x in names])

    def judge(batches):
        for batch in batches:
            keys = batch.column("hashes")
            sizes = np.diff(keys.offsets.to_numpy())
            start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            flat = keys.flatten()
            a, b = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("a", "b"))
            out = []
            for name in names:
                place = np.zeros(len(sizes), np.int32)
                hit = np.flatnonzero(sent.value[name].listed(a, b))
                row = np.repeat(np.arange(len(sizes)), sizes)[hit]
                np.maximum.at(place, row, np.iinfo(np.int32).max - (hit - start[row] + 1).astype(np.int32))
                out.append(pa.array(np.where(place > 0, np.iinfo(np.int32).max - place, 0).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], schema.names)

    return rows.mapInArrow(judge, schema)


def judge_urls(pages: DataFrame, rules=RULES, otherwise: str = "allow", max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict of every url; ``otherwise`` is the verdict where no key is listed.

    The longest rule that fits wins. Should a list outgrow ``max_bytes``, its keys are joined instead.
    """
    verdicts = {h + p: v for h, p, v in rules}
    if len(verdicts) < len({(h + p, v) for h, p, v in rules}):
        raise ValueError("a key has two verdicts")
    spark = pages.sparkSession
    host, path = parsed(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", candidate_keys(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("hashes", F.transform("keys", lambda k: F.struct(*key_hashes(k))))
    universe = rows.select(F.explode("keys").alias("key")).distinct()
    names = sorted(set(verdicts.values()))
    cascades, joined = {}, []
    for name in names:
        listed = spark.createDataFrame([(k,) for k, v in verdicts.items() if v == name], "key string")
        cascade = build_cascade(listed, universe, max_bytes)
        if cascade is None:
            joined.append((name, listed))
        else:
            cascades[name] = cascade
    if joined:
        return _by_join(rows, verdicts, otherwise)
    found = _first_listed(rows, cascades)
    place = F.least(*[F.when(F.col(n) > 0, F.col(n)) for n in names]) if len(names) > 1 else F.when(F.col(names[0]) > 0, F.col(names[0]))
    verdict = F.coalesce(*[F.when(F.col(n) == place, F.lit(n)) for n in names], F.lit(otherwise))
    return found.select("page_id", "host", "path", F.when(place.isNotNull(), F.element_at("keys", place)).alias("rule"), verdict.alias("verdict"))


def _by_join(rows: DataFrame, verdicts: dict[str, str], otherwise: str) -> DataFrame:
    """The same answer for lists that are too large to send: distinct keys meet the list in a shuffled join."""
    listed = rows.sparkSession.createDataFrame(list(verdicts.items()), "key string, verdict string").hint("merge")
    hits = stored(rows.select(F.explode("keys").alias("key")).distinct().join(listed, "key"), "listed")
    urls = rows.select("host", "path", F.posexplode("keys").alias("at", "key")).distinct()
    best = urls.join(hits.hint("merge"), "key").groupBy("host", "path").agg(F.min_by(F.struct("key", "verdict"), "at").alias("best"))
    return rows.join(best.hint("merge"), ["host", "path"], "left").select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
