"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text is read once. For every boundary the search keeps one backpointer: the piece that ends there on the best path.
No piece is longer than the longest one of the vocabulary, so only that many boundaries can be continued; as soon as the
paths of all of them meet in one boundary, the ids before it are committed and forgotten. "Best" depends on the model:

* unigram: the highest sum of piece scores (the longer last piece among equals);
* bpe: the path that the merge rules make. Merges are local, so a sequence is the merged one exactly if each piece
  merges to itself and each adjacent pair stays a pair. Every boundary then has exactly one such last piece.

A boundary that no piece of the vocabulary spans (before a space mark, at a line break that no piece holds) is
always such a meeting point, so what lies between two of them is looked up in a bounded table first. The spans of a block
of texts that the table lacks are searched in sorted order: a span keeps the backpointers of the prefix that it shares with
the one before it.

Decoding joins the bytes of the pieces and drops the first space, which encoding adds. The space mark U+2581 itself is
spelled in byte pieces, so that decoding gives back every text.

Defined cases: null text gives null ids and a null count; an empty text gives no ids; repeated rows are encoded alike; an empty
table gives no rows; characters without a piece become byte pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Model file of the production query; a public vocabulary with byte fallback.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Spans in each half of their lookup table, pairs in theirs, characters of the longest span: some 200 MB in all.
TABLE, PAIRS, LONG = 1 << 18, 1 << 18, 48
#: Characters of the texts whose spans are searched together (a longer text is a block of its own).
BLOCK = 1 << 22


class Pieces:
    """Vocabulary with its search. ``kind`` is "bpe" or "unigram"."""

    def __init__(self, model: bytes, kind: str = "bpe"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        self.kind, self.unknown = kind, sp.unk_id()
        special = {i for i in ids if sp.is_unknown(i) or sp.is_control(i)}
        self.bytes_of = [b"" if i in special else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i in ids for p in (sp.id_to_piece(i),)]
        self.byte_ids = {self.bytes_of[i][0]: i for i in ids if sp.is_byte(i)}
        self.id_of = {sp.id_to_piece(i): i for i in ids if i not in special and not sp.is_byte(i)}
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        self.unknown_score = min(self.score.values()) - 10
        self.longest = max(map(len, self.id_of))
        spans = {c for p in self.id_of if len(p) > 1 for c in p}
        loose = "" if any(SPACE in p.lstrip(SPACE) for p in self.id_of) else SPACE
        breaks = "" if "\n" in spans else "\n"
        # spans between boundaries that no piece crosses
        self.split = re.compile(f"{loose}*[^{loose}{breaks}]+|{loose}+|\n" if loose and breaks else f"{loose}*[^{loose}]+|{loose}+" if loose else "(?s:.+)").findall
        self.found: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.text_of = {i: p for p, i in self.id_of.items()}
        self.ending = self._ending()

    def merged(self, text: str) -> list[str]:
        """Merge rules on a short text: of all adjacent pairs that make a piece, the best (first) one, until none is left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stays(self, a: int, b: int) -> bool:
        """Whether two pieces (ids, or -1 - code point for a character without a piece) are still two after merging."""
        key = (a, b)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            pair = [self.text_of[x] if x >= 0 else chr(-1 - x) for x in key]
            known = self.pairs[key] = self.merged(pair[0] + pair[1]) == pair
        return known

    def _ending(self) -> dict:
        """Pieces as a tree from the last character to the first; the id stands under 0. Under bpe, only pieces that merge to themselves."""
        root: dict = {}
        for piece, i in self.id_of.items():
            if self.kind != "bpe" or self.merged(piece) == [piece]:
                node = root
                for c in reversed(piece):
                    node = node.setdefault(c, {})
                node[0] = i
        return root

    def _step(self, window: str, n: int, back: list, last: list, score: list) -> None:
        """The best last piece of the boundary after ``window[n]``, from those of the boundaries up to ``n``."""
        char, bpe, pairs = window[n], self.kind == "bpe", self.pairs.get
        node = self.ending.get(char)
        ends = [(n, node[0])] if node is not None and 0 in node else [(n, -1 - ord(char))]
        j = n
        while node is not None and j:
            j -= 1
            node = node.get(window[j])
            if node is not None and 0 in node:
                ends.append((j, node[0]))
        best = None
        for j, piece in reversed(ends):
            if bpe:
                before = last[j]
                if before is None or (known := pairs((before, piece))) or known is None and self._stays(before, piece):
                    choice, kept = j, piece
                    break
            else:
                s = score[j] + (self.score[self.text_of[piece]] if piece >= 0 else self.unknown_score)
                if best is None or s > best:
                    choice, kept, best = j, piece, s
        back.append(choice)
        last.append(kept)
        score.append(best or 0.0)

    def search(self, text: Iterable[str]) -> Iterator[list[int]]:
        """Pieces of a stream of characters, in lists, each as soon as it is certain."""
        window = ""  # characters since the last committed boundary, and for each boundary between them:
        back, last, score = [0], [None], [0.0]  # where its last piece begins, that piece, and the sum of scores
        limit, n = 4 * self.longest, 0
        for char in text:
            window += char
            self._step(window, n, back, last, score)
            n += 1
            if n >= limit:
                if meet := self._meeting(back, n):
                    yield self._path(last, back, meet)
                    window = window[meet:]
                    n -= meet
                    back = [0] + [b - meet for b in back[meet + 1 :]]
                    last = last[meet:]  # the piece before the window still decides what may follow it
                    score = [s - score[meet] for s in score[meet:]]
                limit = n + 2 * self.longest
        if n:
            yield self._path(last, back, n)

    def search_sorted(self, spans: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Each span with its pieces; what a span shares with the one before it isn't searched again."""
        before, back, last, score = "", [0], [None], [0.0]
        for span in sorted(spans):
            k, end = 0, min(len(before), len(span))
            while k < end and before[k] == span[k]:
                k += 1
            del back[k + 1 :], last[k + 1 :], score[k + 1 :]
            for n in range(k, len(span)):
                self._step(span, n, back, last, score)
            before = span
            yield span, self._path(last, back, len(span))

    def _meeting(self, back: list[int], n: int) -> int:
        """The last boundary that the paths of all boundaries which can be continued have in common."""
        paths = None
        for b in range(max(0, n - self.longest + 1), n + 1):
            path, at = {b}, b
            while at:
                at = back[at]
                path.add(at)
            paths = path if paths is None else paths & path
        return max(paths)

    @staticmethod
    def _path(last: list, back: list[int], end: int) -> list[int]:
        """Pieces on the path to a boundary: ids, and -1 - code point for characters without a piece."""
        out = []
        while end:
            out.append(last[end])
            end = back[end]
        return out[::-1]

    def _ids(self, piece: int) -> list[int]:
        return [piece] if piece >= 0 else [self.byte_ids.get(b, self.unknown) for b in chr(-1 - piece).encode("utf-8", "surrogatepass")]

    def _packed(self, found: list[int]) -> bytes:
        return array("i", found if min(found) >= 0 else [i for p in found for i in self._ids(p)]).tobytes()

    def _blocks(self, texts: Iterable[str]) -> Iterator[list[list[list[str]]]]:
        """Spans of each part of each text, a part being what lies between two space marks; some BLOCK characters at a time."""
        block, size = [], 0
        for text in texts:
            if block and size + len(text) > BLOCK:
                yield block
                block, size = [], 0
            parts = [part.replace(" ", SPACE) for part in text.split(SPACE)]
            if text:
                parts[0] = SPACE + parts[0]
            block.append([self.split(part) for part in parts])
            size += len(text)
        if block:
            yield block

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of whole texts, four bytes each."""
        mark = array("i", self._ids_of_mark()).tobytes()
        for block in self._blocks(texts):
            missing = {span for parts in block for part in parts for span in part}.difference(self.found)
            if len(self.found) + len(missing) > TABLE:
                self.older, self.found = self.found, {}
            known = {span: ids for span in missing if (ids := self.older.get(span))}
            known.update((span, self._packed(found)) for span, found in self.search_sorted([span for span in missing if span not in known and len(span) <= LONG]))
            once = {span: self._packed([p for part in self.search(span) for p in part]) for span in missing if len(span) > LONG}
            for parts in block:
                out = bytearray()
                for n, part in enumerate(parts):
                    if n:
                        out += mark
                    for span in part:
                        out += self.found.get(span) or known.get(span) or self.older.get(span) or once[span]
                yield bytes(out)
            if len(self.found) + len(known) <= TABLE:
                self.found.update(known)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, four bytes each."""
        return next(self.encode_all([text]))

    def _ids_of_mark(self) -> list[int]:
        return [self.byte_ids.get(b, self.unknown) for b in SPACE.encode()]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that form no character become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


_loaded: dict[tuple[int, str], Pieces] = {}


def loaded(model: bytes, kind: str) -> Pieces:
    """One vocabulary per worker process."""
    key = (hash(model), kind)
    if key not in _loaded:
        _loaded[key] = Pieces(model, kind)
    return _loaded[key]


def encode_documents(docs: DataFrame, model: str = MODEL, kind: str = "bpe", check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (whether decoding the ids gives the text) of whole texts.

    The model file is read once by the driver (a vocabulary, half a megabyte) and sent along.
    """
    with open(model, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        pieces = loaded(sent.value, kind)
        for batch in slices(batches, 1024):
            flat, ends, same = bytearray(), [0], []
            texts = batch.column("text").to_pylist()
            for text, ids in zip(texts, pieces.encode_all(t or "" for t in texts)):
                same.append(None if text is None else pieces.decode(np.frombuffer(ids, np.int32).tolist()) == text if check else None)
                flat += ids
                ends.append(len(flat) // 4)
            none = np.array([t is None for t in texts], bool)
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32)), mask=pa.array(none))
            sizes = pa.array(np.diff(ends).astype(np.int64), mask=none)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, lists, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    with open(model, "rb") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        pieces = loaded(sent.value, "bpe")
        for batch in slices(batches):
            texts = [None if ids is None else pieces.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
