"""Token counts of sections from one encoding of the whole document.

A document is encoded once, as a whole. The lengths of the token bytes give each token's byte span, and the starts of characters
turn it into a character span. Sections are character ranges too, so tokens meet sections in an interval join on two
sorted lists. A token that crosses a boundary is allocated by a rule: "start" (the section of its first
character), "end" (of its last), "most" (the one that holds most of its characters, the earlier of equals), or "split" (to
each section its share of the token's characters).

Sections are the lines of the text (a line break belongs to the line it ends) unless a column of section starts is named.

Defined cases: a null or empty text has no sections and gives no rows; section starts are sorted, repeated and
out-of-range ones are dropped, and the text before the first one is section 0; repeated rows give their rows again; an
empty table gives no rows.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Vocabulary of the production query: byte-level pieces, base64 and rank in each line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary splits a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "end", "most", "split")


class Tokenizer:
    """Encoder with the byte length of each token."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encode = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            self.sizes[rank] = len(piece)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and last character of each token of a whole text; a character that tokens share counts for each of them."""
        ends = np.cumsum(self.sizes[self.encode(text)])
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        if len(ends) and ends[-1] != len(text):
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            char = np.cumsum((data & 0xC0) != 0x80) - 1
            return char[starts], char[ends - 1]
        return starts, ends - 1


def line_starts(text: str) -> np.ndarray:
    """Starts of the lines of a text; none for the empty line after a last break."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(codes == 10) + 1
    return np.concatenate([[0], at[at < len(codes)]])


def attributed(first: np.ndarray, final: np.ndarray, starts: np.ndarray, length: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of its tokens cross a boundary."""
    if rule not in RULES:
        raise ValueError(f"no rule {rule!r}")
    n = len(starts)
    a, b = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, final, "right") - 1
    crossing = np.flatnonzero(a != b)
    to = a.copy() if rule != "end" else b.copy()
    counts = np.zeros(n)
    stops = np.append(starts[1:], length)
    if rule in ("most", "split"):
        for t in crossing:
            inside = np.arange(a[t], b[t] + 1)
            held = np.minimum(stops[inside], final[t] + 1) - np.maximum(starts[inside], first[t])
            if rule == "most":
                to[t] = inside[np.argmax(held)]
            else:
                counts[inside] += held / held.sum()
    cross = np.bincount(to[crossing], minlength=n)
    counts += np.bincount(to, minlength=n) - (cross if rule == "split" else 0)
    return counts, cross


def section_tokens(docs: DataFrame, starts: str | None = None, rule: str = "start", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, section, first_char, chars, tokens, crossing for every section of every text.

    ``starts`` names an array<int> column of section starts in code points; else sections are lines.
    """
    if rule not in RULES:
        raise ValueError(f"no rule {rule!r}")
    with open(vocabulary, "rb") as f:  # one file of a megabyte, read by the driver and sent along
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    made: dict[str, Tokenizer] = {}

    def run(batches):
        if "it" not in made:
            made["it"] = Tokenizer(sent.value)
        tokenizer = made["it"]
        for batch in slices(batches):
            out = []
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("starts").to_pylist())
            for doc_id, text, given in rows:
                if not text:
                    continue
                begin = line_starts(text) if starts is None else np.unique([0, *(x for x in given or () if x is not None and 0 < x < len(text))])
                counts, cross = attributed(*tokenizer.spans(text), begin, len(text), rule)
                size = len(begin)
                out.append((np.full(size, doc_id if doc_id is not None else 0, np.int64), np.full(size, doc_id is None), np.arange(size, dtype=np.int32), begin.astype(np.int64), np.diff(np.append(begin, len(text))).astype(np.int64), counts, cross.astype(np.int64)))
            if out:
                ids, none, *rest = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=none), *map(pa.array, rest)], ["doc_id", "section", "first_char", "chars", "tokens", "crossing"])

    given = F.col(starts).cast("array<int>") if starts else F.lit(None).cast("array<int>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), given.alias("starts"))
    return rows.mapInArrow(run, "doc_id long, section int, first_char long, chars long, tokens double, crossing long")
