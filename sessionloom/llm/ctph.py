"""Context-triggered piecewise hashing of whole texts.

A rolling hash over the last seven bytes ends a chunk wherever its low bits are zero. The block size is the smallest power of
two that leaves at most 63 chunk ends, so a text of any length gets a bounded signature without cutting it. A
fingerprint is ``block:chunks at block:chunks at twice the block``, two base64 characters a chunk. Fingerprints whose blocks
are equal or differ by a factor of two have a signature for the same block; their likeness is 1 - d / (chunks of both),
where d is the edit distance (insertions and deletions) between the two. Others have likeness 0.

Defined cases: a null text is empty; empty texts have equal fingerprints (likeness 1), and likeness 0 to others;
rows with equal doc_id follow each other by a hash of their text; null doc_ids come last; the only row is its own next;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bytes that the rolling hash sees, the most chunk ends, the least block as a power of two, the digits.
WINDOW, MOST, LEAST = 7, 63, 2
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_BYTES = np.random.default_rng(7).integers(1, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions of possible chunk ends and, for each, the largest power of two that divides its rolling hash."""
    t = _BYTES[np.frombuffer(data, np.uint8)]
    h = t.copy()
    for j in range(1, min(WINDOW, len(t))):
        h[j:] += (t[:-j] << np.uint32(j)) | (t[:-j] >> np.uint32(32 - j))
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    at = np.flatnonzero((h & np.uint32((1 << LEAST) - 1)) == 0)
    low = h[at]
    low = (low & (~low + np.uint32(1))).astype(np.float64)
    return at, np.where(low > 0, np.log2(np.maximum(low, 1)), 31).astype(np.int64)


def _tokens(data: bytes, ends: np.ndarray) -> str:
    out, start = [], 0
    for end in [*(ends + 1).tolist(), len(data)]:
        if end > start:
            x = xxhash.xxh32_intdigest(data[start:end])
            out.append(DIGITS[x & 63] + DIGITS[x >> 6 & 63])
        start = end
    return "".join(out)


def fingerprint(text: str | None) -> str:
    """Fingerprint of a whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return f"{1 << LEAST}::"
    at, power = chunk_ends(data)
    ends = np.bincount(power, minlength=33)[::-1].cumsum()[::-1]
    k = LEAST + int(np.argmax(ends[LEAST:] <= MOST))
    return f"{1 << k}:{_tokens(data, at[power >= k])}:{_tokens(data, at[power > k])}"


def edit_distance(a: list[str], b: list[str]) -> int:
    """Insertions and deletions that turn ``a`` into ``b``: bit-parallel longest common subsequence."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for y in b:
        if m := masks.get(y):
            v = ((v + (v & m)) | (v & ~m)) & full
    return len(a) + len(b) - 2 * (len(a) - v.bit_count())


def _alike(a: str, b: str) -> float:
    x, y = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (a, b))
    return 1 - edit_distance(x, y) / (len(x) + len(y)) if x and y else 0.0


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    (n, a1, a2), (m, b1, b2) = a.split(":"), b.split(":")
    n, m = int(n), int(m)
    if n == m:
        return max(_alike(a1, b1), _alike(a2, b2))
    return _alike(a1, b2) if n == 2 * m else _alike(a2, b1) if m == 2 * n else 0.0


def edited(text: str, following: str) -> str:
    """The text, its last half (rounded down) replaced by as many code points from the start of the following text, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judged(batches):
    """Rows come by bucket and order; the last row of a bucket is a copy of the row after it and gives no output."""
    last = None
    for batch in slices(batches):
        out: list[tuple] = []
        for doc_id, text, bucket in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket"))):
            mark = fingerprint(text)
            if last and last[3] == bucket:
                new = edited(last[1], text)
                new_mark = fingerprint(new)
                out.append((last[0], len(last[1]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), last[2], new_mark, likeness(last[2], new_mark), likeness(last[2], mark)))
            last = (doc_id, text, mark, bucket)
        if out:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], [c.split()[0] for c in OUT.split(", ")])


def _bucket(cuts: list[int], nulls: int):
    """Bucket numbers that rise with (doc_id, hash); an id that fills several ranges is spread over them by the hash."""
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket(doc_id, tie):
        share = (tie.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
        none = doc_id.isna().to_numpy()
        ids = doc_id.fillna(0).astype("int64").to_numpy()
        low, high = np.searchsorted(edges, ids, "left"), np.searchsorted(edges, ids, "right")
        at = low + np.minimum((share * (high - low + 1)).astype(np.int64), high - low)
        return doc_id.__class__(np.where(none, np.minimum((share * nulls).astype(np.int64), nulls - 1) - nulls, at).astype(np.int32))

    return bucket


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text, with the likeness to the latter and to the next document.

    Documents follow each other by descending doc_id, the first one after the last. Ranges of doc_id become buckets; a
    bucket gets a copy of the first row of the bucket after it, so tasks stream their rows without looking elsewhere.
    """
    spark = docs.sparkSession
    many = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / many for i in range(1, many)]
    total, nulls, cuts = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", shares, 20 * many)).first()
    empty = max(1, math.ceil(many * nulls / max(1, total)))
    # a range fraction of the id is enough while ids differ, so equal ids alone need the hash
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("bucket", _bucket(sorted(cuts or []), empty)(F.col("doc_id"), F.col("tie")))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie").alias("at")
    heads = rows.groupBy("bucket").agg(F.max(order).alias("at")).collect()  # one row for each of at most 2 * many buckets
    names = sorted(x["bucket"] for x in heads)
    before = {b: names[(i + 1) % len(names)] for i, b in enumerate(names)}  # whose last row is followed by the first row of b
    wanted = spark.createDataFrame([(x["bucket"], x["at"]["doc_id"], x["at"]["tie"], before[x["bucket"]]) for x in heads], "bucket int, doc_id long, tie long, into int")
    ghosts = rows.alias("r").join(F.broadcast(wanted).alias("w"), (F.col("r.bucket") == F.col("w.bucket")) & F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("r.tie") == F.col("w.tie")))
    ghosts = ghosts.select("r.doc_id", "r.text", "r.tie", F.col("w.into").alias("bucket")).dropDuplicates(["bucket"])
    flow = rows.withColumn("copy", F.lit(0)).unionByName(ghosts.withColumn("copy", F.lit(1)))
    flow = flow.repartition(many // 4, "bucket").sortWithinPartitions(F.desc("bucket"), "copy", F.desc_nulls_last("doc_id"), F.desc("tie"))
    return flow.select("doc_id", "text", "bucket").mapInArrow(_judged, OUT)
