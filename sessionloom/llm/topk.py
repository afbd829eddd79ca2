"""Exact top-k by inner product with a KD-tree per shard.

Vectors are dealt by hash into shards of bounded size, queries into blocks of bounded size; each (shard, block) pair is one
group. A group builds the shard's tree by median splits, keeps the tight bounding box of each node, and searches it
best-first: the bound of a box is the largest inner product that a vector inside it could have with the query, and the
search ends when the best open bound can't beat the k-th result. First every block searches one shard; the k-th
result found there is then carried into the searches of all other shards, where most boxes fall to it.

Components become floor(scale * x). Scores are exact integers.

Defined cases: vectors that are null or hold a null or non-finite component take no part; all other vectors do, however long they are:
products that doubles can't hold exactly are taken in whole numbers. A result whose score leaves a long is an error,
not a wrong number; shorter vectors count as padded with zeros; rows with equal id and vector
are one vector; a query doesn't meet rows of its own id; ties go to the smaller id, null ids last; fewer than k candidates give
all; a null id is never a query; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors in a shard, queries in a block, vectors in a leaf.
SHARD, BLOCK, LEAF = 8192, 512, 128
NO_ID = np.iinfo(np.int64).max
#: What a score beyond a long is carried as; an error if it is among the results.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


class Tree:
    """KD-tree over whole-numbered vectors (rows of doubles ``x``) with ids; nodes are arrays, children of node i are at ``child[i]``."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.low, self.high, self.child, self.range, self.least = [], [], [], [], []
        self.order = np.arange(len(x))
        self._grow(x, ids, 0, len(x), leaf)
        self.x, self.ids = x[self.order], ids[self.order]
        self.low, self.high = np.array(self.low, np.float64).reshape(-1, x.shape[1]), np.array(self.high, np.float64).reshape(-1, x.shape[1])

    def _grow(self, x: np.ndarray, ids: np.ndarray, a: int, b: int, leaf: int) -> int:
        own = self.order[a:b]
        rows = x[own]
        low, high = rows.min(axis=0), rows.max(axis=0)
        at = len(self.child)
        for to, value in ((self.low, low), (self.high, high), (self.child, None), (self.range, (a, b)), (self.least, int(ids[own].min()))):
            to.append(value)
        if b - a > leaf and x.shape[1]:
            axis, middle = int(np.argmax(high - low)), (b - a) // 2
            self.order[a:b] = own[np.argpartition(rows[:, axis], middle)]
            self.child[at] = (self._grow(x, ids, a, a + middle, leaf), self._grow(x, ids, a + middle, b, leaf))
        return at

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor_score: np.ndarray, floor_id: np.ndarray):
        """For each query its best (score, id) pairs that beat the floor, at most ``k``; ``own`` is the id it must not meet."""
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        # sums of integers below 2**53 are exact in doubles; beyond, whole numbers are multiplied and bounds get slack
        size = np.abs(self.x).max(initial=0) * np.abs(queries).max(axis=1, initial=0) * max(1, self.x.shape[1])
        bounds[size >= 2.0**53] += np.abs(bounds[size >= 2.0**53]) * 1e-9 + 1
        forms = {np.float64: self.x}
        for i, q in enumerate(queries):
            form = np.float64 if size[i] < 2.0**53 else np.int64 if size[i] < 2.0**62 else object
            if form not in forms:
                forms[form] = _whole(self.x) if form is object else self.x.astype(form)
            x, q = forms[form], _whole(q) if form is object else q.astype(form)
            best = [(int(floor_score[i]), -int(floor_id[i]))] * k if floor_id[i] >= 0 else []  # heap of (score, -id), worst first
            kept: list[tuple[int, int]] = []
            row = bounds[i].tolist()
            open_ = [(-row[0], 0)]
            while open_:
                bound, node = heapq.heappop(open_)
                if len(best) == k and (-bound, -self.least[node]) < best[0]:
                    if -bound < best[0][0]:
                        break
                    continue
                if self.child[node]:
                    for c in self.child[node]:
                        heapq.heappush(open_, (-row[c], c))
                    continue
                a, b = self.range[node]
                scores = x[a:b] @ q
                near = np.flatnonzero((scores >= best[0][0]) if len(best) == k else np.ones(b - a, bool))
                near = near[self.ids[a:b][near] != own[i]]
                if len(near) > k:
                    ids = self.ids[a:b]
                    near = near[np.lexsort((ids[near], -scores[near]))[:k]] if form is not object else np.array(sorted(near, key=lambda j: (-scores[j], ids[j]))[:k])
                for s, v in zip(scores[near].tolist(), self.ids[a:b][near].tolist()):
                    item = (int(s), -v)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                    else:
                        continue
                    kept.append(item)
            live = set(best)
            yield i, [x_ for x_ in kept if x_ in live]


def scaled(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, a whole number in a double; null if the vector takes no part."""
    usable = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))

    def whole(x: Column) -> Column:
        y = x.cast("double") * F.lit(scale)
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # beyond, doubles are whole

    return F.when(usable, F.transform(vector, whole))


def _whole(x: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers."""
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _search(k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            width = max(max(map(len, queries["v"])), max(map(len, vectors["c"])))
            tree = Tree(_matrix(vectors["c"], width), vectors["vec_id"].to_numpy(np.int64))
            own = queries["query_id"].to_numpy(np.int64)
            for i, found in tree.search(_matrix(queries["v"], width), own, k, queries["floor_score"].to_numpy(np.int64), queries["floor_id"].to_numpy(np.int64)):
                out += [(own[i], queries["tie"].iat[i], -v, min(max(s, LOWEST), HIGHEST)) for s, v in found]
        return pd.DataFrame(out, columns=["query_id", "tie", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for every row of (vec_id, embedding) that ``is_query`` picks, against all other rows."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v"), is_query.alias("asks")).filter("v is not null")
    usable = usable.select(F.coalesce("vec_id", F.lit(int(NO_ID))).alias("vec_id"), "v", (F.coalesce("asks", F.lit(False)) & F.col("vec_id").isNotNull()).alias("asks"), F.xxhash64("v").alias("tie")).dropDuplicates(["vec_id", "v"])
    rows = stored(usable, "vectors")
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, math.ceil(n / shard)), max(1, math.ceil(asked / block))
    place = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "vec_id", "tie"), F.lit(shards)).cast("int"))
    queries = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "tie", "v", F.pmod(F.xxhash64(F.lit(5), "vec_id", "tie"), F.lit(blocks)).cast("int").alias("block"))
    all_blocks, all_shards = F.sequence(F.lit(0), F.lit(blocks - 1)), F.sequence(F.lit(0), F.lit(shards - 1))

    def searched(asking: DataFrame, first: bool) -> DataFrame:
        meet = (lambda b, s: b % shards == s) if first else (lambda b, s: b % shards != s)
        left = asking.withColumn("shard", F.explode(F.filter(all_shards, lambda s: meet(F.col("block"), s))))
        right = place.select("vec_id", F.col("v").alias("c"), "shard", F.explode(F.filter(all_blocks, lambda b: meet(b, F.col("shard")))).alias("block"))
        return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(_search(k), "query_id long, tie long, vec_id long, score long")

    none = queries.withColumn("floor_score", F.lit(0).cast("long")).withColumn("floor_id", F.lit(-1).cast("long"))
    home = stored(searched(none, True), "home")
    best = Window.partitionBy("query_id", "tie").orderBy(F.desc("score"), "vec_id")
    if shards > 1:
        kth = home.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("tie").alias("t"), F.col("score").alias("s"), F.col("vec_id").alias("i"))
        with_floor = queries.join(kth, (F.col("query_id") == F.col("q")) & (F.col("tie") == F.col("t")), "left")
        # an id below zero can't stand for "no floor", so such ids search without one
        floor_id = F.when(F.col("i") >= 0, F.col("i")).otherwise(F.lit(-1)).cast("long")
        with_floor = with_floor.select("query_id", "tie", "v", "block", F.coalesce("s", F.lit(0)).cast("long").alias("floor_score"), F.coalesce(floor_id, F.lit(-1)).cast("long").alias("floor_id"))
        home = home.unionByName(searched(with_floor, False))
    ranked = home.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != int(NO_ID), F.col("vec_id")).alias("vec_id"), F.when(F.col("score").isin(LOWEST, HIGHEST), F.raise_error(F.lit("a score leaves a long")).cast("long")).otherwise(F.col("score")).alias("score"))
