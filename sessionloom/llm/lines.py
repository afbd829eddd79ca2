"""Line deduplication by winnowing.

The lines of a text that hold a word are hashed. A window starts at each such line and ends with the first line that brings it
to 50 words, so a single long line is a window too. The smallest line hash of a window (the last one among equals)
is its fingerprint; a run of lines that repeats somewhere and holds a window gives the same fingerprint at the same line in
both places. Positions of fingerprints that occur more than once are joined: the match at a fingerprint is extended to
both sides over the windows that chose it, each window finds its earliest place, and a window with an earlier place is deleted.
Adjacent windows of a run overlap, so the run goes as a whole while its first place stays.

In short: a line goes exactly if it lies in a window whose lines stood, in the same order, at an earlier (doc_id, line).

Windows that run forward only leave the end of a run (up to 49 words) where none of them ends there. With ``whole``, a window also
ends at each line and starts at the last line that brings 50 words; both kinds are found in the same way, as it depends on the lines of
a window alone of which kind it is. Together they cover every common run of 50 words from its first to its last line, so a line goes
exactly if it lies in a run of lines of 50 words or more that stood at an earlier place. The pipeline and ``op2_whole_runs`` work this way;
``op2_line_dedup`` follows its SQL, which has forward windows.

Lines are compared without white space at their ends; lines without words between them don't separate a run.

Defined cases: null and empty texts stay as they are; null doc_ids come after all others; rows with equal doc_id and text
are one document and get the same result; a text whose lines all go becomes empty; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_counted, slices, stored

#: Words that a repeated run needs.
WORDS = 50

WINDOWS = "array<struct<first:int,last:int,a:long,b:long>>"


def windows(text: str, words: int = WORDS, whole: bool = False) -> list[tuple[bytes, list[tuple[int, int, bytes]]]]:
    """Fingerprints of a text: the line's digest, and the windows that choose it as (first line, last line, digest of the lines)."""
    lines = [x.strip() for x in text.encode("utf-8", "surrogatepass").split(b"\n")]
    at = [i for i, x in enumerate(lines) if x]
    marks = [xxhash.xxh3_128_digest(lines[i]) for i in at]
    sizes = [len(lines[i].split()) for i in at]
    out: dict[int, list[tuple[int, int, bytes]]] = {}
    end = total = 0
    smallest: list[int] = []  # places in the window whose hash is below all later ones
    for start in range(len(at)):
        while end < len(at) and total < words:
            while smallest and marks[smallest[-1]] >= marks[end]:
                smallest.pop()
            smallest.append(end)
            total += sizes[end]
            end += 1
        if total < words:
            break
        if smallest[0] < start:
            smallest.pop(0)
        out.setdefault(smallest[0], []).append((at[start], at[end - 1], xxhash.xxh3_128_digest(b"".join(marks[start:end]))))
        total -= sizes[start]
    start = total = 0
    smallest = []
    for end in range(len(at) if whole else 0):
        while smallest and marks[smallest[-1]] >= marks[end]:
            smallest.pop()
        smallest.append(end)
        total += sizes[end]
        while total - sizes[start] >= words:
            total -= sizes[start]
            start += 1
        while smallest[0] < start:
            smallest.pop(0)
        if total - sizes[end] >= words > 0:  # else it is too short, or a forward window as well
            out.setdefault(smallest[0], []).append((at[start], at[end], xxhash.xxh3_128_digest(b"".join(marks[start : end + 1]))))
    return [(marks[m], w) for m, w in out.items()]


def _fingerprints(words: int, whole: bool):
    names = ["mark", "doc_id", "k1", "k2", "windows"]

    def run(batches):
        for batch in slices(batches):
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text, k1, k2 in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "k1", "k2"))):
                if text:
                    for mark, found in windows(text, words, whole):
                        spans = [dict(zip(("first", "last", "a", "b"), (a, b, *np.frombuffer(d, np.int64).tolist()))) for a, b, d in found]
                        for to, value in zip(rows, (int(np.frombuffer(mark, np.int64)[0]), doc_id, k1, k2, spans)):
                            to.append(value)
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in rows[:4]), pa.array(rows[4], kind)], names)

    return run


def keys(text: Column) -> list[Column]:
    """Two hashes that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def repeated_runs(docs: DataFrame, words: int = WORDS, whole: bool = False) -> DataFrame:
    """doc_id, k1, k2, runs: the windows (first, last line) to delete of each document that has some."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keys(F.col("text")))
    marks = stored(rows.mapInArrow(_fingerprints(words, whole), f"mark long, doc_id long, k1 long, k2 long, windows {WINDOWS}"), "marks")
    again = stored(marks.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1"), "again")
    met = join_counted(marks, again, ["mark"], ["doc_id", "k1", "k2"]).select("doc_id", "k1", "k2", F.explode("windows").alias("w")).select("doc_id", "k1", "k2", "w.*")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "first")
    earliest = stored(met.groupBy("a", "b").agg(F.min(place).alias("origin"), F.count("*").alias("n")).filter("n > 1"), "earliest")
    later = join_counted(met, earliest, ["a", "b"], ["doc_id", "k1", "k2"]).filter(place > F.col("origin"))
    return later.groupBy("doc_id", "k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def _without(batches):
    """Delete the lines of ``runs``; the text column comes back as ``kept`` with the number of lines before and deleted."""
    for batch in slices(batches):
        texts, counts, gone = [], [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            lines = (text or "").split("\n")
            drop = set()
            for r in runs or ():
                drop.update(range(r["first"], r["last"] + 1))
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
            counts.append(len(lines) if text else 0)
            gone.append(len(drop))
        rest = [c for c in batch.schema.names if c not in ("text", "runs")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], [*rest, "kept", "lines", "deleted"])


def without_repeats(docs: DataFrame, words: int = WORDS, carry: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """doc_id, text (without later repeats), lines, deleted of every document, and the columns of ``carry``.

    Only documents are dealt by the hash of their text here, one row for each, so no key is hot.
    """
    runs = repeated_runs(docs, words, whole).withColumnsRenamed({"doc_id": "rd", "k1": "r1", "k2": "r2"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keys(F.col("text")), *carry)
    on = (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")) & F.col("doc_id").eqNullSafe(F.col("rd"))
    joined = rows.join(runs, on, "left").select("doc_id", *carry, "text", "runs")
    kept = [f for f in joined.select("doc_id", *carry).schema.fields]
    schema = T.StructType([*kept, T.StructField("kept", T.StringType()), T.StructField("lines", T.LongType()), T.StructField("deleted", T.LongType())])
    return joined.mapInArrow(_without, schema).withColumnRenamed("kept", "text").select("doc_id", "text", "lines", "deleted", *carry)


def deduplicated(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with the repeated runs deleted as a whole from text; documents that lose all their words that way go."""
    packed = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))
    out = without_repeats(packed, words, ("row",), whole=True).filter((F.col("deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
