"""Document quality by ordinal cumulative-link regression on hashed text.

Labels give grades: 0 for a toxic text, 1 for another one of low quality, 2 for a good one. One weight per hashed feature is
shared by all grades and gives a score s(text); ordered thresholds t0 < t1 cut it, P(grade <= k) = logistic(tk - s).
The fit gives an expected grade and the tail probability P(grade >= 2), which selects.

Features are the distinct lower-cased words of the whole text and a few shapes (shares of words in capitals, of repeated words, of words
without letters), each in one of DIMENSIONS classes.

The weights are fitted on a bounded sample of labelled rows: the SAMPLE rows with the smallest hash of their doc_id. All
documents are scored.

Defined cases: several labels of a doc_id count as toxic if one is, and as good if all are; labels that are null or without a
document are left out; null and empty texts have the score 0 of no feature and are not kept; without labels all grades are
equally probable; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Labelled rows to fit on, feature classes, grades, steps of the fit, pull of weights to zero, texts
#: of the sample that a feature must be in, least tail probability.
SAMPLE, DIMENSIONS, GRADES, STEPS, PULL, COMMON, LEAST = 8192, 1 << 18, 3, 150, 5e-4, 5, 0.5


_WORD = re.compile(r"\w+").findall


class Classes(dict):
    """Feature class of a word; starts anew when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        c = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % DIMENSIONS
        return c


def features(text: str | None, classes: Classes) -> np.ndarray:
    """Feature classes of a whole text, each once."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64)
    low = _WORD(text.lower())
    n = len(words)
    shares = {
        "capitals": sum(map(str.isupper, words)),
        "repeats": sum(a == b for a, b in zip(low, low[1:])),
        "marks": sum(not any(map(str.isalpha, w)) for w in words if not w.isalpha()),
        "distinct": len(set(low)),
    }
    out = {classes[w] for w in set(low)}
    out.update(classes[f"\n{name} {int(min(1, value / n) * 10)}"] for name, value in shares.items())
    return np.fromiter(out, np.int64, len(out))


@dataclass
class Model:
    """Weights by feature class, and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum()) if len(found) else 0.0

    def probabilities(self, score: float) -> np.ndarray:
        """Of each grade."""
        below = 1 / (1 + np.exp(-(self.thresholds - score)))
        return np.diff(np.concatenate([[0.0], below, [1.0]]))


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = STEPS, pull: float = PULL) -> Model:
    """Maximum likelihood with a pull to zero, by adaptive steps on the whole sample that shrink weights
    to exactly zero where the evidence is weak; features of fewer than COMMON texts weigh nothing."""
    n = len(rows)
    if not n:
        return Model(np.zeros(DIMENSIONS), np.log([0.5, 2.0]))
    texts = np.bincount(np.concatenate(rows), minlength=DIMENSIONS) if any(map(len, rows)) else np.zeros(DIMENSIONS, int)
    rows = [r[texts[r] >= min(COMMON, 1 + n // 50)] for r in rows]
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if sizes.sum() else np.zeros(0, np.int64)
    used, at = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(len(used)), [start[0], np.log(max(start[1] - start[0], 1e-2))]])
    v = np.zeros_like(p)
    for _ in range(steps):
        w, t = p[:-2], np.array([-np.inf, p[-2], p[-2] + np.exp(p[-1]), np.inf])
        s = np.bincount(row, w[at], minlength=n)
        up, low = 1 / (1 + np.exp(np.clip(s - t[grades + 1], -50, 50))), 1 / (1 + np.exp(np.clip(s - t[grades], -50, 50)))
        mass = np.maximum(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / mass, low * (1 - low) / mass
        g_s = (d_up - d_low) / n  # gradient of minus log likelihood
        g_t = [-(d_up[grades == k].sum() - d_low[grades == k + 1].sum()) / n for k in range(2)]
        g = np.concatenate([np.bincount(at, g_s[row], minlength=len(used)), [g_t[0] + g_t[1], g_t[1] * np.exp(p[-1])]])
        v += g * g
        rate = 0.3 / (np.sqrt(v) + 1e-9)
        p -= rate * g
        p[:-2] = np.sign(p[:-2]) * np.maximum(np.abs(p[:-2]) - rate[:-2] * pull, 0)
    weights = np.zeros(DIMENSIONS)
    weights[used] = p[:-2]
    return Model(weights, np.array([p[-2], p[-2] + np.exp(p[-1])]))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of the sample. The sample has ``sample`` rows at most, so its ids are broadcast and its features collected."""
    per = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    chosen = per.select("doc_id", grade.alias("grade"), F.xxhash64(F.lit(11), "doc_id").alias("h")).orderBy("h", "doc_id").limit(sample).select("doc_id", "grade")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")

    def run(batches):
        classes = Classes()
        for batch in slices(batches):
            found = [features(t, classes) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "grade", "found"])

    got = texts.mapInArrow(run, "doc_id long, grade int, found array<int>").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    found = got["found"].combine_chunks()
    ends = np.concatenate([[0], np.cumsum(np.diff(found.offsets.to_numpy()))])
    flat = found.flatten().to_numpy().astype(np.int64)
    return [flat[a:b] for a, b in zip(ends, ends[1:])], got["grade"].to_numpy().astype(np.int64)


def scored(docs: DataFrame, model: Model, least: float = LEAST, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``carry`` with expected_grade, tail (P(grade >= 2)), toxic (P(grade = 0)) and keep."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    extra = [T.StructField(n, T.DoubleType()) for n in ("expected_grade", "tail", "toxic")] + [T.StructField("keep", T.BooleanType())]
    rows = docs.select(*carry, F.col("text").cast("string").alias("__text"))
    schema = T.StructType([*rows.select(*carry).schema.fields, *extra])

    def run(batches):
        classes = Classes()
        for batch in slices(batches):
            chances, some = [], []
            for text in batch.column("__text").to_pylist():
                found = features(text, classes)
                chances.append(sent.value.probabilities(sent.value.score(found)))
                some.append(len(found) > 0)
            p = np.array(chances).reshape(-1, GRADES)
            keep = (p[:, 2] >= least) & np.array(some, bool)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(p @ np.arange(GRADES)), pa.array(p[:, 2]), pa.array(p[:, 0]), pa.array(keep)], schema.names)

    return rows.mapInArrow(run, schema)


def graded(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, expected_grade, tail, toxic, keep of all documents by a model of the labels."""
    return scored(docs, fit(*labelled(docs, labels, sample)))
