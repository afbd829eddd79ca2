"""Source divergence, exact duplicates and ranked search against brute force, with nulls, empties, ties, repeats and clashing names."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import divergence, exact, ranked

DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, hash string, n long, p0 int, rank int, m int, item string, copies int"
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def frame(spark, rows):
    """Documents (doc_id, text, lang, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "t", "h", 2, 3, 4, 5, "i", 6) for r in rows], DOCS)


def low(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    words = [a + b for a in "River stone GREEN light Ärger éte 日本 x1 y2 İz".split() for b in ["", "s", "ed", "ß", "xy"]]
    prose = lambda n: " ".join(words[int(rnd.paretovariate(0.7)) % len(words)] for _ in range(n))
    out = [(i, prose(rnd.choice([2, 9, 30])), rnd.choice(["en", "en", "de", None, ""]), rnd.choice(["a", "a", "b", "ç", None, ""])) for i in range(150)]
    out += [(200 + i, out[4][1], "en", "a") for i in range(60)] + [(7, out[7][1], "en", "b")] * 3
    out += [(None, out[4][1], "en", "a"), (None, None, None, None), (300, None, "en", "zz"), (301, "", "en", "b"), (302, " \n\t ", "xx", "b"), (303, "1 2 3 !!", "xx", "c"), (304, prose(20000), "en", "b"),
            (305, out[5][1].replace(" ", "\n\t "), "de", "a"), (306, out[5][1].replace(" ", " "), "de", "a"), (307, "\x00 a\x00b", "en", "a"), (308, "x" * 200000, "de", "a")]
    return out


# divergence


def brute_audit(rows):
    docs = [(lang or "", source or "", [low(t) for t in LETTERS.findall(text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = collections.Counter(t for g, _, ts in docs if g == lang for t in set(ts))
        kept = {t for t, n in df.items() if n >= 3}
        counts = {s: collections.Counter(t for g, x, ts in docs if g == lang and x == s for t in ts if t in kept) for s in {d[1] for d in docs if d[0] == lang}}
        whole = sum(counts.values(), collections.Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        q, p = share(whole), {s: share(c) for s, c in counts.items()}
        for s in counts:
            parts = {"pair": [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in counts if o != s],
                     "term": [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]}
            for part, values in parts.items():
                ordered = sorted(values, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(ordered) if part == "pair" or i < 5]
    return collections.Counter(out)


def test_divergence(spark, rows, monkeypatch):
    df = frame(spark, rows)
    got = collections.Counter((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(df, ranks=5).collect())
    assert got == brute_audit(rows)
    assert any(r[0] == "xx" for r in got)  # a language without kept terms has its pairs
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)  # the way beyond the bound of a broadcast
    assert collections.Counter((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(df, ranks=5).collect()) == got
    assert divergence.audit(df.limit(0)).count() == 0


def test_terms_split_over_batches_and_blocks(monkeypatch):
    import pyarrow as pa

    rnd = random.Random(1)
    data = [("en", f"t{i:03}", f"s{j}", rnd.randint(1, 10**9), 1 + j) for i in range(40) for j in range(rnd.randint(1, 9))]
    table = pa.table({c: [r[k] for r in data] for k, c in enumerate(["lang", "term", "source", "p", "p0"])})
    sums = collections.Counter()
    monkeypatch.setattr(divergence, "PAIRS", 7)
    for b in divergence._both(table.to_batches(max_chunksize=5)):
        for r in b.to_pylist():
            sums[r["source"], r["item"]] += r["value"]
    far = lambda p, q: (p - q) ** 2 // q
    want = collections.Counter()
    for _, t, s, p, p0 in data:
        for _, u, o, q, q0 in data:
            if t == u and s != o:
                want[s, o] += far(p, q) - far(p, q0) - far(p0, q) + far(p0, q0)
    assert sums == want


def test_sums_handed_on_early():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 9, "source": ["a"] * 9, "text": ["a b c", "b c", "c d", "", "a", "e f", "c c", "g", "a"]})
    sums = collections.Counter()
    parts = list(divergence._sums([batch, batch], 2))
    for b in parts:
        for r in b.to_pylist():
            sums[r["term"], "c"] += r["c"]
            sums[r["term"], "d"] += r["d"]
    assert len(parts) > 3 and sums["c", "c"] == 10 and sums["c", "d"] == 8 and sums["", "d"] == 0 and sums["a", "d"] == 6


def test_vectors_agree_with_sums(spark, rows):
    df = frame(spark, rows)
    rows_of = lambda: {(r.lang, r.source, r.term): (r.c, r.d) for r in divergence.group_sums(df).collect()}
    whole = rows_of()
    kept = divergence.vocabulary(divergence.group_sums(df))
    by_doc = divergence.document_vectors(df, kept).groupBy("lang", "term").agg(F.sum("c").alias("c"))
    assert {(r.lang, r.term): r.c for r in by_doc.collect()} == {(r.lang, r.term): r.in_lang for r in kept.collect()}
    text = rows[0][1]
    assert divergence.terms(text) == [low(t) for t in LETTERS.findall(text)]
    assert all(c >= d for c, d in whole.values()) and (("en", "zz", "") in whole)


# exact duplicates


def brute_classes(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows]
    groups = collections.defaultdict(list)
    for i, t in enumerate(norm):
        groups[t].append(rows[i][0])
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        out += [(d, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, d in enumerate(ids)]
    return collections.Counter(out)


@pytest.mark.parametrize("bits", [128, 8, 0])
def test_exact_duplicates(spark, rows, bits):
    digest = {128: exact.content_hash, 8: lambda t: F.substring(F.md5(t), 1, 2), 0: lambda t: F.lit("same")}[bits]
    got = exact.exact_classes(frame(spark, rows), digest)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == brute_classes(rows)
    assert exact.exact_classes(frame(spark, []), digest).count() == 0


def test_exact_duplicates_of_many_copies(spark, rows, monkeypatch):
    monkeypatch.setattr(exact, "CHUNK", 2)
    df = frame(spark, rows)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_classes(df).collect()) == brute_classes(rows)
    stay = exact.deduplicated(df)
    assert stay.columns == df.columns
    want = collections.Counter(k[0] for k, n in brute_classes(rows).items() if k[3] for _ in range(n))
    assert collections.Counter(r.doc_id for r in stay.collect()) == want


# ranked search

ITEMS = [(1, "river Stones x1 日本", 9), (2, "green lighted", 9), (2, "RIVERS y2ed", 9), (None, "éte ärger Ärger", 9), (3, None, 9), (4, "", 9), (5, "nowhere", 9), (6, " ".join(["river"] * 50), 9), (7, "river " * 3 + "stone green light x1 y2 x1s y2s lights greens", 9)]


def brute_search(rows, items, top):
    docs = [(d, collections.Counter(low(t) for t in ALNUM.findall(text or ""))) for d, text, *_ in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n, length = len(docs), sum(x for *_, x in docs)
    queries = collections.defaultdict(set)
    for i, text, *_ in items:
        queries[i] |= {low(t) for t in ALNUM.findall(text or "")}
    out = []
    for i, ts in queries.items():
        scored = []
        for d, c, k in docs:
            s = 0
            for t in ts & set(c):
                df = sum(t in x for _, x, _ in docs)
                s += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * (50 + 50 * k * n // length)))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return collections.Counter(out)


@pytest.mark.parametrize("top,block", [(50, 200_000), (3, 4)])
def test_ranked_search(spark, rows, monkeypatch, top, block):
    monkeypatch.setattr(ranked, "BLOCK", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string, score int")
    got = collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked.search(frame(spark, rows), items, top).collect())
    assert got == brute_search(rows, ITEMS, top)


def test_ranked_search_of_nothing(spark, rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string, score int")
    assert ranked.search(frame(spark, []), items).count() == 0
    assert ranked.search(frame(spark, rows), items.limit(0)).count() == 0


def test_results_are_carried_from_shard_to_shard():
    import pyarrow as pa

    rnd = np.random.default_rng(2)
    found = [sorted(rnd.choice(12, rnd.integers(0, 9), replace=False).tolist()) for _ in range(400)]
    docs = [(None if i == 9 else i, int(rnd.integers(50, 60)), f, rnd.integers(1, 3, len(f)).tolist()) for i, f in enumerate(found)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*docs), (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))], ["doc_id", "m", "terms", "tfs"])
    weights, rank = np.arange(12) * 10, np.arange(12)[::-1].copy()
    results = []
    for size in (7, 50, 10_000):
        queries = ranked.Queries(weights, np.arange(0, 25, 2), np.tile([0, 1], 12), 2, 20)
        for trie in ranked._shards([batch.slice(0, 150), batch.slice(150)], rank, 20, size):
            queries.search(trie)
        results.append([sorted(b, reverse=True) for b in queries.best])
    scores = sorted(((sum(int(weights[rank[t]]) * (10**9 * c // (1000 * c + 20 * m)) for t, c in zip(f, x)), -(1 << 63 if d is None else d)) for d, m, f, x in docs), reverse=True)
    assert results[0] == results[1] == results[2] == [[s for s in scores if s[0]][:20]] * 2


def test_trie_bounds_and_pruning(monkeypatch):
    rnd = np.random.default_rng(5)
    monkeypatch.setattr(ranked, "SMALL", 2)
    docs = []
    for i in range(600):
        ranks = np.flatnonzero(rnd.random(40) < 1 / (1 + np.arange(40) / 2))
        docs.append((ranks, rnd.integers(1, 9, len(ranks)), int(rnd.integers(50, 400)), [i]))
    trie = ranked.Trie(docs)

    def check(node):
        ranks, tfs, m, least, lo, hi, kids = node
        inside = trie.docs[lo:hi]
        most = collections.defaultdict(int)
        for r, c, *_ in inside:
            for a, b in zip(r, c):
                most[a] = max(most[a], b)
        assert dict(zip(ranks, tfs)) == most and m == min(d[2] for d in inside) and least == min(d[3][0] for d in inside)
        if kids:
            assert [k[4] for k in kids] == [lo, *[k[5] for k in kids[:-1]]] and kids[-1][5] == hi
            for k in kids:
                check(k)

    check(trie.root)
    weights = np.arange(1, 41) * 50
    one = ranked.Queries(weights, np.r_[np.zeros(31, int), np.arange(1, 11)], np.zeros(10, int), 1, 5)
    one.search(trie)
    scores = sorted(((int(one.scores(r, c, m)[0]), -i[0]) for r, c, m, i in docs), reverse=True)
    assert sorted(one.best[0], reverse=True) == [s for s in scores if s[0]][:5]
    assert one.entered < 600 * 6  # far fewer than each document at each depth
