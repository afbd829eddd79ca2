"""Exact duplicates: a 128-bit content hash groups the texts, their bytes decide.

A text is compared after each run of ASCII white space became one space. Texts are grouped by (hash, bytes) with a map-side combine,
so a group of copies costs one row a task, and a hash that two texts share gives two classes. Rows then look their class
up by the hash alone; only rows of a shared hash are looked up by their bytes. The row with the smallest doc_id of a class stays.

Defined cases: a null text is empty, and empty texts equal each other; a null doc_id comes after all others; rows that repeat a
doc_id and a text are separate documents of which one stays; very long texts are hashed and compared whole; an empty table gives
no rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, stored

#: Fixed value: white space that compares equal.
SPACE = r"[\x20\x09-\x0D]+"
#: Copies of one (doc_id, text) that a task writes at once.
CHUNK = 4096


def content_hash(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text))


def normalised(text: Column | str) -> Column:
    """The text as it is compared."""
    return F.regexp_replace(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), SPACE, " ")


def _classes(texts: DataFrame) -> DataFrame:
    """One row per (hash, text): rows, smallest doc_id (null if all are null)."""
    return texts.groupBy("hash", "text").agg(F.count("*").alias("n"), F.min("doc_id").alias("keep_id"))


def exact_classes(docs: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and hash of every row of ``docs``; ``digest`` may be any hash."""
    texts = docs.select("doc_id", normalised("text").alias("text")).withColumn("hash", digest(F.col("text")))
    classes = stored(_classes(texts).select("hash", "n", "keep_id", F.sha2("text", 256).alias("text_sha256")), "classes")
    shared = stored(classes.groupBy("hash").agg(F.count("*").alias("texts")).filter("texts > 1").select("hash"), "shared")
    # rows of one document and text are counted first, so that a row repeated many times is a number
    rows = texts.groupBy("hash", "doc_id").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long"))))
    if shared.isEmpty():
        judged = join_counted(rows, classes, ["hash"], ["doc_id", "chunk"])
    else:
        judged = join_counted(rows.join(shared, "hash", "left_anti"), classes.join(shared, "hash", "left_anti"), ["hash"], ["doc_id", "chunk"])
        judged = judged.unionByName(_by_bytes(texts.join(shared, "hash", "left_semi")).select(judged.columns))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chunk") == 0)
    written = judged.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(CHUNK), F.col("copies") - F.col("chunk")) - 1)))
    return written.select("doc_id", "keep_id", F.col("n").alias("group_size"), (first & (F.col("copy") == 0)).alias("kept"), "text_sha256", "hash")


def _by_bytes(texts: DataFrame) -> DataFrame:
    """The same lookup for texts whose hash another text has too."""
    classes = stored(_classes(texts).withColumn("text_sha256", F.sha2("text", 256)), "shared-classes")
    rows = texts.groupBy("hash", "text", "doc_id").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long"))))
    return join_counted(rows, classes, ["hash", "text"], ["doc_id", "chunk"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows with the same doc_id and equal texts, the one with the smallest hash of all its columns stays.
    """
    names = docs.columns
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", content_hash(normalised("text")).alias("hash"), F.sha2(normalised("text"), 256).alias("text_sha256"))
    keyed = keyed.withColumn("tie", F.xxhash64(F.to_json("row")))
    stay = exact_classes(docs).filter("kept").select("doc_id", "hash", "text_sha256")
    keys = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "hash", "text_sha256"]
    best = keyed.select(*keys, "tie").groupBy("id", "hash", "text_sha256").agg(F.min("tie").alias("tie")).join(stay.select(*keys), ["id", "hash", "text_sha256"])
    kept = keyed.select("row", *keys, "tie").join(best, ["id", "hash", "text_sha256", "tie"], "left_semi")
    one = kept.dropDuplicates(["id", "hash", "text_sha256"])
    return one.select(*[F.col("row")[c].alias(c) for c in names])
