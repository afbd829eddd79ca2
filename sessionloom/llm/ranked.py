"""Ranked lexical search of all documents for a set of query texts, by tries of frequency-ordered term vectors.

Documents are restricted to the terms of the queries, and each task cuts its documents into shards. A shard's vectors, ordered from the
term that most documents have to the rarest, share the paths of a trie; paths without branches are one edge. Every
subtree knows the largest tf of each of its terms and its smallest m, so the score that these would give bounds
all of its documents. A depth-first search enters a subtree only for the queries whose bound reaches their k-th
score, which is carried from shard to shard; the documents of small subtrees are scored exactly. The best of each task are merged.

Queries are handled in blocks of about ``BLOCK`` (query, term) rows, each against all documents, so what a task holds doesn't grow with their number.

Defined cases: null texts have no terms, and documents without terms count nowhere; repeated documents are ranked one by one; a
null doc_id comes after all others; rows of one item_id (null is one too) are one query with the terms of all of them; a
query without terms or hits gives no rows; very long texts are counted whole; empty tables give no rows; other columns are
left alone.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

#: Results of a query, the scale of weights, and the constants of the score.
TOP, SCALE, FLAT, LONG, UNIT, TF, M = 50, 1000, 50, 50, 1_000_000_000, 1000, 20
#: Query terms of a block, documents of a shard, documents that are scored without looking at a bound for each.
BLOCK, SHARD, SMALL = 200_000, 8192, 16
#: Bytes of a UTF-8 text to spaces, or A-Z to a-z, so that what is left between spaces are its terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order: runs of letters, digits and characters beyond ASCII, only A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term, block: the different terms of each query."""
    split = F.udf(lambda text: sorted({t.decode("utf-8", "surrogatepass") for t in terms(text)}), "array<string>")
    rows = stored(items.select("item_id", F.explode(split("text")).alias("term")).distinct(), "query-terms")
    blocks = max(1, -(-rows.count() // BLOCK))
    return rows.withColumn("block", F.pmod(F.xxhash64(F.lit(13), "item_id"), F.lit(blocks)).cast("int"))


def _restricted(number: dict[bytes, int]):
    """Length of each text and the counts of the numbered terms in it; texts without terms give no row."""

    def run(batches):
        for batch in slices(batches):
            ids, n, found, tfs = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = terms(text)
                if words:
                    counts = Counter(words)
                    here = sorted((number[t], counts[t]) for t in counts.keys() & number.keys())
                    ids.append(doc_id), n.append(len(words)), found.append([t for t, _ in here]), tfs.append([c for _, c in here])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return run


class Trie:
    """Shard of documents as nested ranges over vectors sorted by term rank; ``docs`` are (ranks, tfs, m, ids)."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray, int, list[int]]]):
        self.docs = sorted(docs, key=lambda d: d[0].astype(">u4").tobytes())
        self.root = self._tree(self._shared())

    def _shared(self) -> list[int]:
        """Length of the path that each vector shares with the one before it."""
        out = [0]
        for (a, *_), (b, *_) in itertools.pairwise(self.docs):
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            out.append(int(differ[0]) if len(differ) else k)
        return out

    def _tree(self, shared: list[int]):
        """The root; ``open_`` holds the branches that a following vector may still join, as [path length, children]."""
        if not self.docs:
            return None
        open_, last = [[0, []]], self._leaf(0)
        for i in range(1, len(self.docs)):
            while open_[-1][0] > shared[i]:
                kids = open_.pop()[1]
                last = self._branch([*kids, last])
            if open_[-1][0] == shared[i]:
                open_[-1][1].append(last)
            else:
                open_.append([shared[i], [last]])
            last = self._leaf(i)
        while open_:
            last = self._branch([*open_.pop()[1], last])
        return last

    def _leaf(self, i: int):
        ranks, tfs, m, ids = self.docs[i]
        return (ranks, tfs, m, ids[0], i, i + 1, None)

    def _branch(self, kids):
        """(ranks, largest tfs, smallest m, smallest id, first doc, end, children) of a subtree."""
        if len(kids) == 1:
            return kids[0]
        lo, hi = kids[0][4], kids[-1][5]
        ranks, tfs = np.concatenate([k[0] for k in kids]), np.concatenate([k[1] for k in kids])
        order = np.argsort(ranks, kind="stable")
        ranks, tfs = ranks[order], tfs[order]
        starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(tfs, starts) if len(starts) else tfs
        return (ranks[starts], most, min(k[2] for k in kids), min(k[3] for k in kids), lo, hi, kids if hi - lo > SMALL else None)


class Queries:
    """The queries of a block as lists of items per term rank, with their k best documents so far."""

    def __init__(self, weights: np.ndarray, offsets: np.ndarray, items: np.ndarray, n_items: int, top: int):
        self.weights, self.offsets, self.items, self.n_items, self.top = weights, offsets, items, n_items, top
        self.best: list[list[tuple[int, int]]] = [[] for _ in range(n_items)]
        self.kth, self.last = np.zeros(n_items, np.int64), np.full(n_items, -1, object)  # score and id that a document has to beat
        self.entered = 0

    def scores(self, ranks: np.ndarray, tfs: np.ndarray, m: np.ndarray | int, row: np.ndarray | None = None, rows: int = 1) -> np.ndarray:
        """Score of each query for each of ``rows`` vectors; entry i belongs to vector row[i]."""
        gain = self.weights[ranks] * ((UNIT * tfs) // (TF * tfs + M * m))
        size = self.offsets[ranks + 1] - self.offsets[ranks]
        at = np.arange(size.sum()) + np.repeat(self.offsets[ranks] - (np.cumsum(size) - size), size)
        cell = self.items[at] if row is None else self.items[at] + np.repeat(row, size) * self.n_items
        out = np.zeros(rows * self.n_items, np.int64)
        np.add.at(out, cell, np.repeat(gain, size))
        return out if row is None else out.reshape(rows, self.n_items)

    def _hopeful(self, bound: np.ndarray, least_id: int) -> np.ndarray:
        tied = np.flatnonzero(bound == self.kth)
        hope = bound > self.kth
        hope[tied] = [least_id < self.last[i] for i in tied]
        return hope

    def search(self, trie: Trie) -> None:
        """Depth first, the more promising child first."""
        stack = [(trie.root, np.ones(self.n_items, bool))]
        while stack:
            (ranks, tfs, m, least, lo, hi, kids), asked = stack.pop()
            asked = asked & self._hopeful(self.scores(ranks, tfs, m), least)
            if not asked.any():
                continue
            self.entered += hi - lo
            if kids is None:
                self._score(trie.docs[lo:hi], asked)
            else:
                stack.extend((k, asked) for k in sorted(kids, key=lambda k: k[2], reverse=True))

    def _score(self, docs, asked: np.ndarray) -> None:
        row = np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])
        m = np.repeat(np.array([d[2] for d in docs], np.int64), [len(d[0]) for d in docs])
        found = self.scores(np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs]), m, row, len(docs))
        for j, i in zip(*np.nonzero((found > 0) & (found >= self.kth) & asked)):
            best = self.best[i]
            for doc_id in docs[j][3]:
                entry = (int(found[j, i]), -doc_id)
                if len(best) < self.top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                else:
                    break
            if len(best) == self.top:
                self.kth[i], self.last[i] = best[0][0], -best[0][1]


def _shards(batches, rank: np.ndarray, top: int, size: int = SHARD):
    """Tries over ``size`` different vectors at a time. Of documents with equal vectors and m, which score alike, the ``top`` smallest ids are held."""
    same: dict[tuple, tuple] = {}
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            found, tfs = batch.column("terms"), batch.column("tfs")
            at = found.offsets.to_numpy()
            ranks, counts = rank[found.values.to_numpy()], tfs.values.to_numpy()
            for i, (doc_id, m) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("m").to_pylist())):
                r = ranks[at[i] : at[i + 1]]
                order = np.argsort(r)
                r, c = r[order], counts[at[i] : at[i + 1]][order]
                ids = same.setdefault((r.tobytes(), c.tobytes(), m), (r, c, m, []))[3]
                ids.append(1 << 63 if doc_id is None else doc_id)
                if len(ids) > 4 * top:
                    ids[:] = sorted(ids)[:top]
        if same and (batch is None or len(same) >= size):
            yield Trie([(r, c, m, sorted(ids)[:top]) for r, c, m, ids in same.values()])
            same = {}


def _best(weights, rank, offsets, items, n_items, top):
    def run(batches):
        queries = Queries(weights, offsets, items, n_items, top)
        for trie in _shards(batches, rank, top):
            queries.search(trie)
        rows = [(i, None if -k == 1 << 63 else -k, s) for i, best in enumerate(queries.best) for s, k in best]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["item", "doc_id", "score"])

    return run


def _block(docs: DataFrame, rows: list, top: int) -> DataFrame:
    """Results of the queries of one block; ``rows`` are its (item_id, term)."""
    names = sorted({r["item_id"] for r in rows}, key=lambda x: (x is None, x or 0))
    place = {name: i for i, name in enumerate(names)}
    vocabulary = sorted({r["term"] for r in rows})
    number = {t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(vocabulary)}
    vectors = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_restricted(number), "doc_id long, n long, terms array<int>, tfs array<long>"), "vectors")
    n_docs, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, d in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect():  # one row for each term of the block
        df[term] = d
    order = np.argsort(-df, kind="stable")
    rank = np.empty(len(vocabulary), np.int64)
    rank[order] = np.arange(len(vocabulary))
    weights = np.array([math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df[order]], np.int64)
    listed: list[list[int]] = [[] for _ in vocabulary]
    for r in rows:
        listed[rank[number[r["term"].encode("utf-8", "surrogatepass")]]].append(place[r["item_id"]])
    offsets, items = np.cumsum([0, *map(len, listed)]), np.array([i for x in listed for i in x], np.int64)
    m = F.lit(100 - FLAT) + F.call_function("div", F.lit(LONG).cast("decimal(3,0)") * F.col("n").cast("decimal(16,0)") * F.lit(n_docs).cast("decimal(18,0)"), F.lit(max(1, length)).cast("decimal(19,0)"))
    found = vectors.filter(F.size("terms") > 0).select("doc_id", m.cast("long").alias("m"), "terms", "tfs")
    found = found.mapInArrow(_best(weights, rank, offsets, items, len(names), top), "item int, doc_id long, score long")
    ids = docs.sparkSession.createDataFrame(list(enumerate(names)), "item int, item_id long")  # the queries of the block
    return found.join(F.broadcast(ids), "item").select("item_id", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each query, equal scores by ascending doc_id."""
    queries = query_terms(items)
    out = None
    for block in [r["block"] for r in queries.select("block").distinct().collect()]:
        part = _block(docs, queries.filter(F.col("block") == block).select("item_id", "term").collect(), top)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top).select(F.col("item_id").cast("long").alias("item_id"), "rank", "doc_id", "score")
