"""Text operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import ctph, language, lines, mixing, pieces, probminhash, quality, tokens, topk, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, row int, kept string, `class` int, language string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents (doc_id, text, lang, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "k", 2, "x", 3, "y") for r in rows], DOCS)


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice("the of and with river stone green light walks under over many small houses near old trees".split()) + rnd.choice(["", "s", "ed", "x", "yy", "zo"]) for _ in range(n))


@pytest.fixture(scope="module")
def edge(spark):
    """Hard cases: nulls in any column, empty and long texts, repeated rows, equal texts, odd characters."""
    same = prose(1, 80)
    rows = [
        (1, same, "en", "a"), (2, same, "en", "a"), (2, same, "en", "a"), (3, None, "en", "a"), (4, "", None, "b"), (5, prose(2, 20000), "en", None), (None, prose(3, 90), "en", "b"),
        (None, None, None, None), (6, "x" * 50000, "de", "c"), (7, "日本語 テキスト \U0001F600 é\n\n\n" * 30, "fr", "c"), (8, "one", "es", "c"), (9, "...\n!!!\n---", "es", ""), (10, same + "\n" + prose(4, 60), "xx", "a"),
        (11, " \n\t \n", "en", "a"), (12, "\u2581 odd \u2581\u2581 marks  with   spaces ", "en", "d.example.com"),
    ]
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# urls


def test_url_rules(spark):
    given = [
        (1, "http://WWW.Example.NET/en/x?y#z"), (2, "https://a.net"), (3, "https://a.net/"), (4, None), (5, "no scheme"), (6, "ftp://example.com/de/1"), (7, "http://xexample.com/de/1"), (8, "http://b.org/fr/"), (9, "http://b.org/FR/"),
        (10, "http://net:80/"), (11, "http://example.net/english"), (11, "http://example.net/english"), (12, "http://#x"), (13, "http://" + "a." * 3000 + "net/"), (14, "x://y://z.net/"), (15, "http://net/" + "p" * 50000),
    ]
    df = spark.createDataFrame([(*g, "h", "r") for g in given], "page_id long, url string, host string, rule string")
    got = collections.Counter((r.page_id, r.host[:40], r.path[:40], r.rule, r.verdict) for r in urls.judge_urls(df).collect())
    want = collections.Counter()
    for i, u in given:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, None, "allow")
        want[(i, host[:40], path[:40], best[1], best[2])] += 1
    assert got == want
    joined = urls.judge_urls(df, max_bytes=0)
    assert collections.Counter((r.page_id, r.host[:40], r.path[:40], r.rule, r.verdict) for r in joined.collect()) == want
    assert urls.judge_urls(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        urls.judge_urls(df, rules=(("net", "/", "block"), ("net", "/", "allow")))


def test_cascade_is_exact(spark):
    universe = spark.range(30000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("hash(key) % 40 = 0").union(spark.createDataFrame([("outside",), (None,)], "key string"))
    cascade = urls.build_cascade(listed, universe)
    assert len(cascade.levels) > 2
    rows = universe.select("key", *urls.key_hashes(F.col("key")), F.expr("hash(key) % 40 = 0").alias("is")).toPandas()
    assert (cascade.listed(rows["a"].to_numpy(), rows["b"].to_numpy()) == rows["is"].to_numpy()).all()


# lines


def deleted_lines(docs, words):
    """Brute force: (doc_id, text) -> lines that lie in a window with an earlier place."""
    found = collections.defaultdict(list)
    for d, t in set(docs):
        if not t:
            continue
        raw = t.split("\n")
        at = [(i, x) for i, x in enumerate(raw) if WORD.search(x)]
        for s in range(len(at)):
            total = 0
            for e in range(s, len(at)):
                total += len(WORD.findall(at[e][1]))
                if total >= words:
                    key = tuple(x.strip(" \t\n\r\x0b\x0c") for _, x in at[s : e + 1])
                    found[key].append(((d is None, d or 0), at[s][0], at[e][0], (d, t)))
                    break
    gone = collections.defaultdict(set)
    for places in found.values():
        first = min(p[:2] for p in places)
        for d, a, b, doc in places:
            if (d, a) > first:
                gone[doc].update(range(a, b + 1))
    return gone


def test_line_runs(spark):
    rnd = random.Random(5)
    pool = [prose(i, rnd.choice([1, 3, 9, 14])) for i in range(12)] + ["", "  "]
    docs = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 25)))) for i in range(60)]
    docs += [(100, docs[3][1]), (100, docs[3][1]), (None, docs[5][1]), (101, None), (102, ""), (103, "\n".join([pool[0]] * 400))]
    df = frame(spark, [(*d, "en", "s") for d in docs])
    gone = deleted_lines(docs, 20)
    want = collections.Counter()
    for d, t in docs:
        drop = gone[(d, t)]
        want[(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop) if t and drop else t, len(drop))] += 1
    got = collections.Counter((r.doc_id, r.text, r.deleted) for r in lines.without_repeats(df, 20).collect())
    assert got == want
    assert sum(len(x) for x in gone.values()) > 50


def lines_of_runs(docs, words):
    """Brute force: lines of maximal runs of ``words`` words or more that two places have in common, at the later place."""
    texts = [(d, t, [(i, x.strip(" \t\n\r\x0b\x0c")) for i, x in enumerate(t.split("\n")) if WORD.search(x)]) for d, t in set(docs) if t]
    gone = collections.defaultdict(set)
    for d, t, mine in texts:
        for e, u, other in texts:
            for p in range(len(mine)):
                for q in range(len(other)):
                    if ((e is None, e or 0), other[q][0]) >= ((d is None, d or 0), mine[p][0]) or (p and q and mine[p - 1][1] == other[q - 1][1]):
                        continue
                    n = 0
                    while p + n < len(mine) and q + n < len(other) and mine[p + n][1] == other[q + n][1]:
                        n += 1
                    if sum(len(WORD.findall(x)) for _, x in mine[p : p + n]) >= words:
                        gone[(d, t)].update(range(mine[p][0], mine[p + n - 1][0] + 1))
    return gone


def test_whole_runs(spark):
    """A run goes up to its last line, whatever the sizes of its lines."""
    rnd = random.Random(15)
    pool = [prose(i, rnd.choice([1, 3, 9, 14, 22])) for i in range(12)] + ["", "  "]
    docs = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 25)))) for i in range(40)]
    docs += [(100, docs[3][1]), (100, docs[3][1]), (None, docs[5][1]), (101, None), (102, ""), (103, "\n".join([pool[0]] * 40))]
    for n, sizes in enumerate(([60, 40], [45, 10, 10], [20, 60, 45], [15, 10])):
        run = "\n".join(prose(500 + 10 * n + i, size) for i, size in enumerate(sizes))
        docs += [(200 + 2 * n + i, "\n".join([prose(600 + 2 * n + i, 30), run, prose(700 + 2 * n + i, 30)])) for i in range(2)]
    gone = lines_of_runs(docs, 20)
    got = collections.Counter((r.doc_id, r.text, r.deleted) for r in lines.without_repeats(frame(spark, [(*d, "en", "s") for d in docs]), 20, whole=True).collect())
    assert got == collections.Counter((d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[(d, t)]) if t else t, len(gone[(d, t)])) for d, t in docs)
    kept = {r.doc_id: r.text for r in lines.deduplicated(frame(spark, [(*d, "en", "s") for d in docs[-8:]])).collect()}
    for n in range(3):  # 50 words: the first three runs go as a whole, the last one stays
        assert kept[201 + 2 * n] == prose(601 + 2 * n, 30) + "\n" + prose(701 + 2 * n, 30)
    assert kept[207] == docs[-1][1]


def test_winnowing_guarantee():
    """Equal windows choose the same line."""
    rnd = random.Random(2)
    run = "\n".join(prose(i, 7) for i in range(8))
    chosen = []
    for i in range(30):
        text = "\n".join([prose(100 + i, rnd.randint(1, 9)), run, prose(200 + i, rnd.randint(1, 9))])
        chosen.append({mark for mark, w in lines.windows(text, 50) if any(a >= 1 and b <= 8 for a, b, _ in w)})
    assert set.intersection(*chosen)


# language


def test_language(spark, edge, none):
    rnd = random.Random(3)
    vocab = {"en": "the and of with house river what".split(), "fr": "le la été où français garçon leçon".split(), "de": "der die das straße über können grün".split(), "es": "el niño año qué señor corazón los".split()}
    rows = []
    for i in range(200):
        lang = rnd.choice(list(vocab))
        declared = lang if i % 10 else rnd.choice(["en", None, "xx"])
        rows.append((i, " ".join(rnd.choice(vocab[lang]) for _ in range(30)), declared, f"host{i % 5}.example.{lang}", lang))
    rows += [(900, None, "en", "h", "?"), (901, "", None, None, "?"), (902, "123 456 !!", "fr", "h.fr", "?")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, truth string")
    got = {r.doc_id: r for r in language.document_languages(df).collect()}
    assert all(got[i].language == truth and got[i].keep for i, *_, truth in rows if truth != "?")
    assert not any(got[i].keep for i in (900, 901, 902))
    out = language.accepted(edge)
    assert out.columns == edge.columns and {r.doc_id for r in out.collect()} >= {1, 2, 5, 10}
    assert language.accepted(none).count() == 0


def test_language_of_pages(spark):
    df = spark.createDataFrame([(1, "http://a.example.de/x", '<html lang="de"><script>the the</script><p>der die das</p>'), (2, None, None), (3, "x", "<b>"), (4, "http://b.example.fr/", "<HTML LANG='fr-CA'>le la été")], "page_id long, url string, html string")
    got = {r.page_id: r for r in language.page_languages(df).collect()}
    assert got[1].language == "de" and got[4].language == "fr" and not got[2].keep and not got[3].keep


# search


def test_top_k(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rnd.integers(-3, 4, 6) / 64]) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 520)] + [(20, rows[20][1]), (600, None), (601, [None] * 6), (602, [math.nan] + [0.0] * 5), (603, [math.inf] * 6), (604, [0.5, 0.25]), (605, []), (606, [9e6] + [0.0] * 5), (650, [1e7, -2e7] + [0.25] * 4), (651, [-3e6, 0.0, 0.5] + [0.0] * 3), (700, [2e4] * 6), (None, rows[7][1])]
    df = spark.createDataFrame([(*r, 0, "t") for r in rows], "vec_id long, embedding array<float>, score int, tie string")
    valid = {}
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            valid[(i, tuple(v))] = [math.floor(256 * float(np.float32(x))) for x in v]
    for k, shard, block in ((5, 64, 3), (5, 8192, 512), (600, 100, 4)):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k, shard=shard, block=block).collect()}
        want = {}
        for (q, _), a in valid.items():
            if q is not None and q % 50 == 0:
                scores = sorted((-sum(x * y for x, y in zip(a, b)), c if c is not None else 1 << 62, c) for (c, _), b in valid.items() if c != q)
                want |= {(q, n): (c, -s) for n, (s, _, c) in enumerate(scores[:k], 1)}
        assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    beyond = spark.createDataFrame([(50, [1e10]), (1, [1e10]), (2, [-1e10])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="leaves a long"):
        topk.top_k(beyond, F.col("vec_id") % 50 == 0).collect()
    assert [(r.vec_id, r.score) for r in topk.top_k(beyond.filter("vec_id <> 1").unionByName(spark.createDataFrame([(3, [1.0])], beyond.schema)), F.col("vec_id") % 50 == 0, k=1).collect()] == [(3, 65536 * 10**10)]


# pieces


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.MODEL, "rb") as f:
        return f.read()


def ids_of(p, text):
    return np.frombuffer(p.encode(text), np.int32).tolist()


def test_pieces_equal_the_public_library(vocabulary):
    import sentencepiece

    sp, p = sentencepiece.SentencePieceProcessor(model_proto=vocabulary), pieces.Pieces(vocabulary)
    rnd = random.Random(4)
    texts = ["", " ", "a  b", "x" * 3000, "ab" * 500, "漢字かな" * 60, prose(1, 300), "tab\there\r\nline\n\n"] + ["".join(rnd.choice("abcdeth  \n éß漢т😀.,") for _ in range(rnd.randint(1, 150))) for _ in range(150)]
    for text in texts:
        assert ids_of(p, text) == sp.encode(text)
        assert p.decode(ids_of(p, text)) == text
    assert p.decode(ids_of(p, "\u2581a\u2581 b")) == "\u2581a\u2581 b"


def test_sorted_spans_equal_the_stream(vocabulary, monkeypatch):
    """Shared prefixes, small blocks and a small table give the ids of the stream search."""
    rnd = random.Random(11)
    words = ["".join(rnd.choice("theroan") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    texts = ["", "\u2581", " "] + [" ".join(rnd.choices(words, k=rnd.randint(1, 80))) for _ in range(60)]
    monkeypatch.setattr(pieces, "TABLE", 64)
    for kind in ("bpe", "unigram"):
        p = pieces.Pieces(vocabulary, kind)
        spans = words + [w[: len(w) // 2 + 1] for w in words]
        assert dict(p.search_sorted(spans)) == {w: [x for part in p.search(w) for x in part] for w in spans}
        whole = list(p.encode_all(texts))
        monkeypatch.setattr(pieces, "BLOCK", 500)
        assert list(p.encode_all(texts)) == whole == [pieces.Pieces.encode(p, t) for t in texts]
        monkeypatch.undo()
        monkeypatch.setattr(pieces, "TABLE", 64)


def test_unigram_search_is_optimal(vocabulary):
    p = pieces.Pieces(vocabulary, "unigram")
    rnd = random.Random(6)
    for _ in range(60):
        text = "".join(rnd.choice("theraon") for _ in range(rnd.randint(1, 200)))
        best = [0.0] + [-math.inf] * len(text)
        for n in range(1, len(text) + 1):
            for j in range(max(0, n - p.longest), n):
                piece = text[j:n]
                if piece in p.id_of or j == n - 1:
                    best[n] = max(best[n], best[j] + p.score.get(piece, p.unknown_score))
        found = [p.text_of[x] for part in p.search(iter(text)) for x in part]
        assert "".join(found) == text and sum(p.score.get(x, p.unknown_score) for x in found) == best[-1]


def test_search_commits_early(vocabulary):
    p, seen = pieces.Pieces(vocabulary), []

    def stream():
        for i in range(5000):
            seen.append(i)
            yield "abcde"[i % 5]

    next(p.search(stream()))
    assert len(seen) < 10 * p.longest


def test_encode_documents(spark, edge, none):
    out = pieces.encode_documents(edge)
    assert out.count() == edge.count()
    assert all(r.round_trip for r in out.collect() if r.ids is not None)
    assert all((r.n_tokens is None) == (r.ids is None) for r in out.collect())
    back = collections.Counter((r.doc_id, r.text) for r in pieces.decode_documents(out).collect())
    assert back == collections.Counter((r.doc_id, r.text) for r in edge.collect())
    assert pieces.encode_documents(none).count() == 0


# quality


def test_quality_finds_marked_words(spark, edge, none):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        grade = rnd.choice([0, 1, 2, 2])
        text = prose(i, 60) + (" vile scum" if grade == 0 else " BUY!! BUY!! BUY!! NOW!! " * 10 if grade == 1 else "")
        rows.append((i, text, "en", "s"))
        if i < 600:
            labels.append((i, int(grade == 2), int(grade == 0)))
        rows[-1] += (grade,)
    labels += [(5, labels[5][1], labels[5][2]), (None, 1, 0), (7000, 1, 0), (3, None, None)]
    docs = frame(spark, [r[:4] for r in rows]).unionByName(edge.withColumn("doc_id", F.col("doc_id") + 5000))
    got = {r.doc_id: r for r in quality.graded(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [(got[r[0]], r[4]) for r in rows[600:]]
    assert np.mean([g.keep == (y == 2) for g, y in held]) > 0.95
    assert np.mean([g.toxic > 0.5 for g, y in held if y == 0]) > 0.9
    assert not got[5003].keep and not got[5004].keep
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.tail, 6) for r in quality.graded(edge, no_labels).collect()} == {round(1 / 3, 6)}
    assert quality.graded(none, no_labels).count() == 0


def test_ordinal_fit_orders_thresholds():
    rnd = np.random.default_rng(2)
    grades = rnd.integers(0, 3, 500)
    found = [np.array([g, 10 + rnd.integers(0, 50)]) for g in grades]
    model = quality.fit(found, grades)
    assert model.thresholds[0] < model.thresholds[1]
    p = np.array([model.probabilities(model.score(x)) for x in found])
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == grades).mean() > 0.95


# piecewise hashes


def test_fingerprints(spark, edge, none):
    rows = [(i, prose(i, 5 + 40 * (i % 7)), "en", "s") for i in range(60)]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in ctph.fingerprints(df).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for r, following in zip(order, order[1:] + order[:1]):
        half = len(r[1]) // 2
        new = r[1][: len(r[1]) - half] + following[1][:half]
        g = got[r[0]]
        assert (g.n_chars, g.edited_sha256, g.fingerprint, g.edited_fingerprint) == (len(r[1]), hashlib.sha256(new.encode()).hexdigest(), ctph.fingerprint(r[1]), ctph.fingerprint(new))
        assert g.near_edited == ctph.likeness(g.fingerprint, g.edited_fingerprint) and g.near_next == ctph.likeness(g.fingerprint, ctph.fingerprint(following[1]))
    assert np.mean([g.near_edited for g in got.values()]) > 0.4
    odd = ctph.fingerprints(edge).collect()
    assert len(odd) == edge.count() and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in odd)
    assert len({r.fingerprint for r in odd if r.doc_id in (1, 2)}) == 1
    assert ctph.fingerprints(edge.filter("doc_id = 1")).first().near_next == 1.0
    assert ctph.fingerprints(none).count() == 0


def test_fingerprints_of_one_repeated_id(spark):
    """A third of the rows share an id, another third have none; every row still has one successor."""
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, prose(i, 30), "en", "s") for i in range(90)]
    out = ctph.fingerprints(frame(spark, rows)).collect()
    assert sorted(r.fingerprint for r in out) == sorted(ctph.fingerprint(r[1]) for r in rows)


def test_edit_distance():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else 2))
        assert ctph.edit_distance(a, b) == d[-1][-1]


# mixing


def water_fill(sizes, weights, epochs):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        share = (total - sum(epochs * sizes[s] for s in capped)) / max(1, sum(w[s] for s in rest))
        over = {s for s in rest if w[s] * share > epochs * sizes[s]}
        if not over:
            return {s: float(epochs * sizes[s]) if s in capped else w[s] * share for s in names}
        capped |= over


def test_mix(spark, edge, none):
    rnd = random.Random(9)
    rows = [(i, prose(i, rnd.choice([3, 30, 200])), "en", rnd.choice(["a", "a", "a", "b", "c", "Z", "é", None])) for i in range(300)] + [(300, prose(1, 2), "en", "tiny"), (301, None, "en", "void"), (302, "", "en", "void")]
    for df in (frame(spark, rows), edge):
        given = [(r.doc_id, r.text, r.source) for r in df.collect()]
        got = mixing.mix(df).collect()
        assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((d, len(WORD.findall(t or ""))) for d, t, _ in given)
        sizes = collections.Counter()
        for _, t, s in given:
            sizes[s] += len(WORD.findall(t or ""))
        targets = water_fill(sizes, mixing.WEIGHTS, mixing.EPOCHS)
        assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(sizes[s], round(t, 6)) for s, t in targets.items()})
        assert all(0 <= r.taken <= 3 * r.size for r in got)
        assert abs(sum(r.taken for r in got) - sum(math.floor(t + 1e-6) for t in targets.values())) <= len(targets)
        assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(none).count() == 0


def test_mixed_documents(spark, edge, none):
    taken, text = collections.Counter(), {r.doc_id: r.text for r in edge.collect()}
    for r in mixing.mix(edge).collect():
        taken[r.doc_id] += r.taken
    out = mixing.mixed_documents(edge)
    assert out.columns == edge.columns and dict(out.dtypes) == dict(edge.dtypes)
    words = collections.Counter()
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.text == text[r.doc_id] or r.doc_id is None or WORD.findall(text[r.doc_id])[: len(WORD.findall(r.text))] == WORD.findall(r.text)
    assert +words == +taken
    assert mixing.mixed_documents(none).count() == 0


# near-duplicates


def true_classes(docs, least=0.8):
    sets = []
    for _, t in docs:
        w = probminhash.words_of(t)
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or (both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(docs))]


def near(text, rnd, edits):
    w = text.split()
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"edit{rnd.random():.5f}"
    return " ".join(w)


def test_near_classes(spark, edge, none):
    rnd = random.Random(11)
    docs = [(i, " ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([3, 8, 60, 200])))) for i in range(60)]
    n = 60
    for i in range(0, 60, 3):
        for _ in range(rnd.randint(1, 6)):
            docs.append((n, near(docs[i][1], rnd, rnd.choice([0, 1, 2, 5]))))
            n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, "??"), (n + 3, "!!"), (n + 4, "word word word word word word word word " * 9)]
    df = frame(spark, [(*d, "en", "s") for d in docs])
    got = {r.doc_id: r["class"] for r in probminhash.near_classes(df).collect()}
    want = true_classes(docs)
    assert [got[d] for d, _ in docs] == [docs[c][0] for c in want]
    kept = probminhash.first_of_classes(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({docs[c][0] for c in want}) and kept.columns == df.columns


def test_near_classes_edges(edge, none):
    rows = probminhash.near_classes(edge).collect()
    assert len(rows) == edge.count()
    by_id = {r.doc_id: r["class"] for r in rows if r.doc_id is not None}
    assert by_id[1] == by_id[2] and by_id[3] == by_id[4] and by_id[5] != by_id[1]
    kept = [r.doc_id for r in probminhash.first_of_classes(edge).collect()]
    assert kept.count(1) == 1 and kept.count(2) == 0 and kept.count(None) == 1
    assert probminhash.near_classes(none).count() == 0 and probminhash.first_of_classes(none).count() == 0


def test_sketch_estimates_probability_jaccard():
    rnd = np.random.default_rng(3)
    keys = probminhash.mixed(np.arange(1, 401, dtype=np.uint64))
    a, b = slice(0, 300), slice(100, 400)
    wa, wb = rnd.uniform(0.5, 3, 400), rnd.uniform(0.5, 3, 400)
    common = range(100, 300)
    want = sum(1 / (sum(max(wa[j] * (j < 300) / wa[i], wb[j] * (j >= 100) / wb[i]) for j in range(400))) for i in common)
    one, two = probminhash.sketch(keys[a], wa[a], 4096), probminhash.sketch(keys[b], wb[b], 4096)
    assert abs((one == two).mean() - want) < 0.035
    assert (probminhash.sketch(keys[:1], np.ones(1), 80) == keys[0]).all()


def test_large_bucket_of_near_copies(spark):
    """Copies of one text that differ from each other by more than they differ from it stay in one class."""
    rnd = random.Random(12)
    base = " ".join(f"w{rnd.randrange(9999)}" for _ in range(300))
    docs = [(1000, base)] + [(i, near(base, rnd, 6)) for i in range(150)]
    got = {r["class"] for r in probminhash.near_classes(frame(spark, [(*d, "en", "s") for d in docs])).collect()}
    assert got == {0}


def test_near_classes_repeated_passages(spark):
    """A passage that one text repeats doesn't hide a pair whose sets are alike."""
    rnd = random.Random(21)
    docs = []
    for i in range(0, 80, 2):
        size, extra, times = ((124, 16, 200), (104, 20, 500))[i // 2 % 2]
        base = " ".join(f"w{rnd.randrange(90000)}" for _ in range(size))
        line = " ".join(f"v{rnd.randrange(90000)}" for _ in range(extra))
        docs += [(i, base), (i + 1, base + (" " + line) * (1 + times))]
    want = true_classes(docs)
    assert want == [i - i % 2 for i in range(80)]
    got = {r.doc_id: r["class"] for r in probminhash.near_classes(frame(spark, [(*d, "en", "s") for d in docs])).collect()}
    assert [got[i] for i in range(80)] == want


def test_links_of_members_that_fail_all_leaders(spark):
    """Members of two classes are linked though neither is like the other's leader, and chains of edits are followed in a bucket of 200."""
    base, rnd = [f"c{i}" for i in range(400)], random.Random(23)
    kinds = {}
    for i in range(230):  # each content differs from the one before by a few words of its own
        words = kinds[i - 1][:] if i else base[:]
        for j in range(3):
            words[(i * 3 + j) * 5 % 400] = f"e{i}x{j}"
        kinds[i] = words
    docs = [(i, " ".join(words)) for i, words in kinds.items()]
    rnd.shuffle(docs)
    sets = {i: set(probminhash.shingles(probminhash.word_hashes(t, probminhash.Words())).tolist()) for i, t in docs}
    members = spark.createDataFrame([(1, i, len(s), 0) for i, s in sets.items()], "h long, key long, n long, own long")
    classes = spark.createDataFrame([(i, i - i % 2) for i in sets], "key long, `class` long")
    signed = lambda x: int(np.uint64(x).astype(np.int64))
    held = spark.createDataFrame([(i, sorted(map(signed, s))) for i, s in sets.items()], "key long, set array<long>")
    signs = spark.createDataFrame([(i, [0] * 80) for i in sets], "key long, signs array<tinyint>")
    found = {tuple(r) for r in probminhash._across(members, classes, held, signs).collect()}
    alike = {(i, j) for i in sets for j in sets if i < j and i // 2 != j // 2 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(alike) > 200 and alike <= found
    got = {r.doc_id: r["class"] for r in probminhash.near_classes(frame(spark, [(*d, "en", "s") for d in docs])).collect()}
    want = true_classes(docs)
    assert [got[d] for d, _ in docs] == [min(docs[j][0] for j in range(len(docs)) if want[j] == c) for c in want]


def hot_group(rnd, size, edits):
    """Copies of one text with a few words replaced from a small vocabulary."""
    base = [f"w{rnd.randrange(9999)}" for _ in range(150)]
    out = {}
    for i in range(size):
        words = base[:]
        for at in rnd.sample(range(150), rnd.choice(edits)):
            words[at] = f"v{rnd.randrange(30)}"
        out[i] = words
    return out


def compared(spark, kinds, classes):
    """Pairs that _across gives for contents of one bucket with equal sketches, and those of different classes that are alike."""
    sets = {i: set(probminhash.shingles(probminhash.word_hashes(" ".join(w), probminhash.Words())).view(np.int64).tolist()) for i, w in kinds.items()}
    members = spark.createDataFrame([(1, i, len(s), 0) for i, s in sets.items()], "h long, key long, n long, own long")
    held = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "key long, set array<long>")
    signs = spark.createDataFrame([(i, [0] * 80) for i in sets], "key long, signs array<tinyint>")
    found = [tuple(r) for r in probminhash._across(members, spark.createDataFrame(list(classes.items()), "key long, `class` long"), held, signs).collect()]
    assert len(found) == len(set(found))
    return set(found), {(i, j) for i in sets for j in sets if i < j and classes[i] != classes[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}


def test_pairs_of_a_hot_group_grow_with_its_size(spark):
    """Copies that are too far from each other are not listed pair by pair, and no link between classes is left out."""
    rnd = random.Random(31)
    listed = []
    for size in (150, 600):
        kinds = hot_group(rnd, size, [4, 5, 6])
        for i in range(0, size, 10):  # a copy of a copy, which only that one is like
            kinds[i + 1] = kinds[i][:-1] + ["end"]
        found, alike = compared(spark, kinds, {i: i for i in kinds})
        assert alike <= found and len(alike) >= size // 10
        listed.append(len(found))
    assert listed[1] < 600 * 599 // 2 // 10


@pytest.mark.parametrize("small", [2, 6])
def test_groups_fall_apart_without_loss(spark, monkeypatch, small):
    """Groups within groups: every link between given classes is found, at any size from which groups are split."""
    monkeypatch.setattr(probminhash, "SMALL", small)
    rnd = random.Random(small)
    kinds = hot_group(rnd, 60, [0, 1, 2, 3, 4, 8])
    base = kinds[0]
    for i in range(60, 80):  # cut at the end
        kinds[i] = base[: 150 - 6 * (i - 60)]
    for i in range(80, 90):  # same shingles, and some of other texts
        kinds[i] = kinds[i - 50] + [f"x{rnd.randrange(4)}" for _ in range(rnd.randrange(12))]
    found, alike = compared(spark, kinds, {i: rnd.choice([i, i - i % 7]) for i in kinds})
    assert len(alike) > 300 and alike <= found


# token counts


@pytest.mark.parametrize("rule", tokens.RULES)
def test_section_tokens(spark, edge, none, rule):
    with open(tokens.VOCABULARY, "rb") as f:
        t = tokens.Tokenizer(f.read())
    given = [r for r in edge.select("doc_id", "text").distinct().collect() if r.doc_id is not None]
    got = collections.defaultdict(dict)
    for r in tokens.section_tokens(edge.dropDuplicates(["doc_id"]), rule=rule).collect():
        got[r.doc_id][r.section] = r
    for doc_id, text in given:
        if not text:
            assert doc_id not in got
            continue
        starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)]
        assert [got[doc_id][i].first_char for i in range(len(starts))] == starts
        assert abs(sum(r.tokens for r in got[doc_id].values()) - len(t.encode(text))) < 1e-6
        if len(text) < 3000:
            want, bounds = [0.0] * len(starts), starts + [len(text)]
            for a, b in zip(*t.spans(text)):
                held = [max(0, min(bounds[i + 1], b + 1) - max(bounds[i], a)) for i in range(len(starts))]
                inside = [i for i, h in enumerate(held) if h]
                if rule == "split":
                    for i in inside:
                        want[i] += held[i] / sum(held)
                else:
                    want[inside[0] if rule == "start" else inside[-1] if rule == "end" else held.index(max(held))] += 1
            assert np.allclose([got[doc_id][i].tokens for i in range(len(starts))], want)
    assert tokens.section_tokens(none, rule=rule).count() == 0


def test_given_sections(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma", [6, 11, 11, 99, None, -3]), (2, "x", None)], "doc_id long, text string, cuts array<int>")
    got = [(r.doc_id, r.section, r.first_char, r.chars) for r in tokens.section_tokens(df, starts="cuts").collect()]
    assert got == [(1, 0, 0, 6), (1, 1, 6, 5), (1, 2, 11, 5), (2, 0, 0, 1)]
