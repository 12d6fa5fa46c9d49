"""SentencePiece encoding and decoding by merges: a score-ordered agenda of adjacent symbol pairs.

A text gets a space in front, its spaces become the mark U+2581, and its characters are the first symbols. The agenda holds
every adjacent pair of symbols that together are a piece; the pair of the highest score, the leftmost of equal ones, is
merged, and the pairs with its new neighbours join the agenda, until none is left. Symbols that are no piece go as bytes.

No piece has the mark behind another character, so no merge crosses from a character to a following mark, and a text's
ids are those of its segments (marks and what follows them up to the next), one after the other. A task remembers the
segments it has met. New segments of an Arrow batch are merged together: short ones as rows of a matrix whose agendas are
searched for their best pair at once, long ones each with a heap. The sentencepiece library then encodes and decodes
the same new segments, and an unlike result ends the task with an error, so that no other ids can leave it.

Supported are merge-type models with byte fallback, a space in front, spaces kept, and no other normalisation, user-defined or
unused pieces; another model raises ValueError.

Edge cases: null and empty texts have no ids and decode to an empty text; a mark in a text reads as a space, as in the
library; very long texts without spaces are one segment of n log n steps; copies give their rows each; an empty table gives
no rows; other columns pass `encoded` as they are (its own columns win over theirs), and the report reads none.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

MARK = "▁"
#: Segments after which a worker begins a new memory, beside the last full one. Longer segments aren't remembered.
CACHE, LONGEST_CACHED = 300_000, 64
#: Symbols up to which segments are merged as rows of a matrix, symbols of such a matrix, and texts whose segments are learnt together.
SHORT, TOGETHER, STEP = 24, 400_000, 128

_SEGMENT = re.compile("(?:^| )( *[^ ]*)")


class Merger:
    """Ids of segments by a merge-type vocabulary, and texts of ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.pieces = {sp.id_to_piece(i): i for i in ids if i not in special and i not in self.of_byte}
        self.texts = {i: p.replace(MARK, " ") for p, i in self.pieces.items()}
        across = [p for p in self.pieces if re.search(f"[^{MARK}]{MARK}", p)]
        if across or len(self.bytes) < 256 or any(sp.is_unused(i) for i in ids) or sp.decode(sp.encode("  Aﬁ  b ")) != "  Aﬁ  b ":
            raise ValueError("the model is not of the supported kind")
        # first symbols: a character's id, or a number of its own that no pair has
        self.chars = {p: i for p, i in self.pieces.items() if len(p) == 1}
        score = np.array([sp.get_score(i) for i in ids])
        pairs = {}
        for p, i in self.pieces.items():
            for k in range(1, len(p)):
                a, b = self.pieces.get(p[:k]), self.pieces.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pairs = pairs
        self.worst = len(score)
        self.rank = np.append(np.searchsorted(np.unique(-score), -score), self.worst).astype(np.int32)  # the higher the score, the lower; the last is no piece's
        # the pairs as an open table: each key stands at its slot or in the next places that were free; free places hold -1
        self.mask = (1 << (4 * max(len(pairs), 16)).bit_length()) - 1
        self.keys, self.into = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        for (key, i), at in zip(pairs.items(), self._slot(np.array([*pairs], np.int64)).tolist()):
            while self.keys[at] != -1:
                at = (at + 1) & self.mask
            self.keys[at], self.into[at] = key, i
        #: Number of ids, ids as text and decoded text of segments without their first mark.
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & self.mask

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols make; -1 if none, as for symbols below 0."""
        key = a.astype(np.int64) << 32 | b
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.into[at], np.int32(-1))
        on = np.flatnonzero((found != key) & (found != -1) & (key >= 0))
        while len(on):
            at = (at if len(at) == len(on) else at[on]) + 1 & self.mask
            key, found = key if len(key) == len(on) else key[on], self.keys[at]
            hit = found == key
            out[on[hit]] = self.into[at[hit]]
            go = ~hit & (found != -1)
            on, at, key = on[go], at[go], key[go]
        return out

    def together(self, segments: list[str]) -> list[list[int]]:
        """Ids of short segments: rows of a matrix, each with its agenda of pairs, whose best are merged in all rows at once.

        A pair stands at the place of its left symbol. A column without symbols at both sides saves asking for ends.
        """
        width = max(map(len, segments))
        wide, n = width + 2, len(segments)
        size = np.array([len(s) for s in segments])
        points = np.frombuffer("".join(["\0" + s.ljust(width + 1, "\0") for s in segments]).encode("utf-32-le"), np.uint32)
        chars, back = np.unique(points, return_inverse=True)
        column = np.tile(np.arange(wide, dtype=np.int32), n)
        inside = (column > 0) & (column <= np.repeat(size, wide))
        # -1: taken up by the symbol to its left, or beyond an end; -2: a character that is no piece
        sym = np.where(inside, np.array([self.chars.get(chr(c), -2) for c in chars], np.int32)[back], np.int32(-1))
        after, before = np.arange(1, n * wide + 1, dtype=np.int32), np.arange(-1, n * wide - 1, dtype=np.int32)
        pair = np.append(self.merged(sym[:-1], sym[1:]), np.int32(-1))
        agenda = self.rank[pair]
        rows = agenda.reshape(n, wide)
        on = np.arange(n)
        while len(on):
            at = on * wide + rows[on].argmin(1)
            has = agenda[at] < self.worst
            on, at = on[has], at[has]
            gone, new, left = after[at], pair[at], before[at]
            right = after[gone]
            sym[at], sym[gone], agenda[gone] = new, -1, self.worst
            after[at], before[right] = right, at
            made = self.merged(np.concatenate([new, sym[left]]), np.concatenate([sym[right], new]))
            place = np.concatenate([at, left])
            pair[place], agenda[place] = made, self.rank[made]
        left = np.flatnonzero(sym != -1)
        ids, row = sym[left].tolist(), np.searchsorted(left // wide, np.arange(n + 1)).tolist()
        out = [ids[a:b] for a, b in zip(row[:-1], row[1:])]
        for k in np.unique(left[sym[left] == -2] // wide).tolist():
            chars_of = zip(segments[k], sym[k * wide + 1 : (k + 1) * wide].tolist())
            out[k] = [i for c, y in chars_of if y != -1 for i in ((y,) if y >= 0 else self.as_bytes(c))]
        return out

    def alone(self, segment: str) -> list[int]:
        """Symbols of one segment, by a heap of (rank, place) entries; entries whose symbols have changed are passed over."""
        n, worst = len(segment), -1
        sym = [self.chars.get(c, -2) for c in segment]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def add(a: int) -> None:
            b = after[a]
            if b < n and sym[a] >= 0 and sym[b] >= 0 and (i := self.pairs.get(sym[a] << 32 | sym[b])) is not None:
                heapq.heappush(agenda, (int(self.rank[i]), a, sym[a], sym[b], i))

        for a in range(n - 1):
            add(a)
        while agenda:
            _, a, x, y, i = heapq.heappop(agenda)
            b = after[a]
            if sym[a] != x or b >= n or sym[b] != y:
                continue
            sym[a], sym[b] = i, worst
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            add(a)
            if before[a] >= 0:
                add(before[a])
        return [i for c, y in zip(segment, sym) if y != -1 for i in ((y,) if y >= 0 else self.as_bytes(c))]

    def as_bytes(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]

    def text_of(self, ids: list[int]) -> str:
        """The ids' pieces in a row, marks as spaces, runs of byte pieces as UTF-8; the space in front of all is still there."""
        try:
            return "".join(map(self.texts.__getitem__, ids))
        except KeyError:
            out, raw = [], bytearray()
        for i in ids:
            if i in self.of_byte:
                raw.append(self.of_byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.texts[i])
        return "".join(out) + raw.decode("utf-8", "replace")

    def learn(self, keys: list[str]) -> None:
        """Ids and texts of new segments, held against the library's; a key is a segment's text without its first space."""
        marked = {k: MARK + k.replace(" ", MARK) for k in keys}
        short = sorted((k for k in keys if len(k) < SHORT), key=len)
        ids: dict[str, list[int]] = {k: self.alone(marked[k]) for k in keys if len(k) >= SHORT}
        for a in range(0, len(short), step := TOGETHER // SHORT):
            part = short[a : a + step]
            ids.update(zip(part, self.together([marked[k] for k in part])))
        theirs = self.library.encode([*ids], num_threads=1)
        back = self.library.decode(theirs, num_threads=1)
        for (k, own), their, text in zip(ids.items(), theirs, back):
            if k and (own != their or text != k):  # the library has no mark in front of an empty text
                raise ValueError(f"the library encodes {k[:100]!r} as {their[:50]}, not as {own[:50]}")
        self.known.update((k, (len(own), ",".join(map(str, own)), self.text_of(own))) for k, own in ids.items())

    def batch(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text its number of ids, its ids as text, and these decoded."""
        for a in range(0, len(texts), STEP):
            split = [segments(t or "") for t in texts[a : a + STEP]]
            if len(self.known) > CACHE:
                self.known, self.older = {}, self.known
            new = {k for each in split for k in each}.difference(self.known)
            self.known.update((k, x) for k in new if (x := self.older.get(k)))
            if new := new.difference(self.known):
                self.learn([*new])
            for each in split:
                sizes, ids, parts = zip(*map(self.known.__getitem__, each)) if each else ((), (), ())
                yield sum(sizes), ",".join(ids), "".join(parts)[1:]
            for k in new:
                if len(k) > LONGEST_CACHED:
                    del self.known[k]


def segments(text: str) -> list[str]:
    """The segments of a text, each without its first mark, other marks as spaces."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    return _SEGMENT.findall(text) if "  " in text or text[0] == " " else text.split(" ")


_MERGERS: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    """A worker reads a model once."""
    if path not in _MERGERS:
        _MERGERS[path] = Merger(path)
    return _MERGERS[path]


def encoded(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The rows with `ids`, their text's ids, and `decoded`, the text of these."""
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    schema = StructType([*kept, StructField("ids", ArrayType(LongType())), StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(path)
        for batch in batches:
            rows = list(own.batch(batch[text_col].to_pylist()))
            ids = pa.array([[int(i) for i in x.split(",")] if n else [] for n, x, _ in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in kept), ids, pa.array([t for *_, t in rows], pa.string())], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def piece_report(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's number of ids and the digests of its ids and of its decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(path)
        for batch in batches:
            n, ids, texts = [], [], []
            for size, x, text in own.batch(batch["text"].to_pylist()):
                n.append(size)
                ids.append(hashlib.sha256(x.encode()).hexdigest())
                texts.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, StructType([StructField("id", docs.schema[id_col].dataType), *StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string").fields]))
    return rows.withColumnRenamed("id", id_col)
