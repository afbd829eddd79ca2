"""Mixing sources to target weights with DataFrame operations only.

Every document gets a hash-random key. Within a source the keys are cut into equal ranges (the hash makes them
even), the word counts of the ranges are summed, and a document's place is the words of the ranges before its own plus the
words before it inside its range. A source whose target exceeds its size is taken in whole epochs; the last, partial
epoch ends at the exact word of the budget.

Defined cases: a null text counts 0 words and is never taken; null sources form one source, last in order; repeated
rows are separate documents whose order among themselves doesn't show; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, numbered, stored

#: A word, the weights dealt to the sources in order, and how often a source may be used.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"


def word_count(text):
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, the random key (60 bits of a digest), and a tie-breaker for equal keys."""
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    tie = [F.xxhash64("text").alias("tie")] if carry else []
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("key"), *tie, *carry)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, docs, source_size, target from (source, size) rows.

    Sources in code point order, null last, take the weights in turn and share the words of all of them. A source
    stops at ``epochs`` times its size; what it can't take is shared again by weight. The level ``(total - capped) / weight
    of the others`` only rises, so the loop ends when no more source is capped; each step moves two sums to the driver.
    """
    totals = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    place = numbered(totals, "place", [F.col("source").asc_nulls_last()])
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stored(place.select("source", "docs", "source_size", turn.cast("long").alias("weight")), "sources")
    total, left = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    budget, cap = total, F.col("source_size") * epochs
    while left:
        capped = F.col("weight") * F.lit(float(budget)) / F.lit(float(left)) >= cap
        used, weight = sources.filter(capped).agg(F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        all_weight = sources.agg(F.sum("weight")).first()[0]
        if (total - used, all_weight - weight) == (budget, left):
            break
        budget, left = total - used, all_weight - weight
    share = F.when(capped, cap.cast("double")).otherwise(F.col("weight") * F.lit(float(budget)) / F.lit(float(left))) if left else cap.cast("double")
    return sources.select("source", "docs", "source_size", share.alias("target"))


def mix(docs: DataFrame, carry: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document, and the columns of ``carry``.

    ``taken`` is the number of words the mix takes of the document, repeats counted. Without ``carry`` only the
    narrow columns are shuffled.
    """
    rows = keyed(docs, carry) if carry else stored(keyed(docs), "sized")
    targets = source_targets(keyed(docs) if carry else rows, weights, epochs)
    spark = docs.sparkSession
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    everything = targets.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    cuts = F.greatest(F.lit(1), F.ceil(F.col("docs") * ranges / F.lit(float(max(1, everything))))).cast("long")
    placed = join_small(rows, targets.withColumn("cuts", cuts), "source", F.col("doc_id"))
    placed = placed.withColumn("cut", F.least(F.col("cuts") - 1, F.floor(F.col("key") / F.lit(float(1 << 60)) * F.col("cuts"))).cast("long"))
    sums = stored(placed.groupBy("source", "cut").agg(F.sum("size").alias("words")), "cuts")
    earlier = Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("at_source"), F.col("cut").alias("at_cut"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "cut").orderBy("key", "doc_id", "size", *(["tie"] if carry else [])).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # both sides are one row per (source, range) or already dealt by it, and there are a few ranges per partition only
    joined = within.join(F.broadcast(offsets) if sums.count() <= 2 * ranges + 100_000 else offsets, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("cut") == F.col("at_cut")))
    budget = F.floor("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - full * F.col("source_size") - F.col("before") - F.col("inside")
    taken = full * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *carry)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each one once per whole epoch, and the one that the budget cuts with its first words only.

    Words of the cut document are joined by a space; all other texts stay as they are.
    """
    packed = docs.select("doc_id", "source", "text", F.struct("*").alias("row"))
    taken = mix(packed, carry=("row",))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)).cast("int")
    copies = taken.select("row", F.explode(F.concat(F.array_repeat(F.lit(0), whole), F.array_repeat(part, (part > 0).cast("int")))).alias("words"))
    text = F.when(F.col("words") == 0, F.col("row.text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(F.col("words"), F.lit(1))), " "))
    return copies.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
