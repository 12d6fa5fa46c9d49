"""Packing token sequences: documents are tokenised, cut into pieces, and pieces packed into near-equal windows.

Each document becomes its token ids and a closing id. Whole windows of `capacity` ids are cut off as they are; the
rest is cut into pieces of at most `piece` ids. A document's pieces are dealt to one batch of bounded size by a hash of
its id and ids (rows without an id by their place, as they may be copies), its whole windows each by itself, and each batch
is split by Karmarkar-Karp multiway differencing: every piece starts as a partial partition with one filled slot,
the two partial partitions of largest imbalance are merged slot by slot, the fullest slot of one with the emptiest of
the other, until one is left. If a slot exceeds the capacity, the number of windows rises and the batch is split anew.

Edge cases: null and empty texts give the closing id alone; very long texts give many pieces and are tokenised in
bounded strips of memory; repeated rows give their pieces each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import _seq

CAPACITY, PIECE, CLOSING = 2048, 512, 1
#: Text bytes whose pieces make a batch, about; some hundreds of windows.
BATCH_BYTES = 1_000_000
#: Words that a worker remembers with their ids; beyond it starts anew.
CACHE_WORDS = 1_000_000
STRIP_BYTES = 1_500_000

# The pre-tokeniser's fixed pattern, for lower-case text of ASCII and Latin letters; a line end parts two words.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|\n|(?:[^\w\s]|_)+")

# The normaliser and pre-tokeniser of a tokenizer file that can be read word by word.
KNOWN_PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordTokenizer:
    """Ids of whole texts by a word-end BPE tokenizer file, with each distinct word encoded once.

    No token crosses white space, so a text's ids are its words' ids. Words of ASCII and Latin letters go through the
    same vocabulary in bulk; any other word goes through the tokenizer itself. That holds for files whose normaliser and
    pre-tokeniser are KNOWN_PARTS; texts for any other file go through its tokenizer whole, one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.by_words = {k: spec.get(k) for k in KNOWN_PARTS} == KNOWN_PARTS and spec["model"].get("type") == "BPE" and bool(spec["model"].get("end_of_word_suffix"))
        if not self.by_words:
            return
        spec["normalizer"], spec["added_tokens"] = None, []
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.bulk = Tokenizer.from_str(json.dumps(spec))
        self.mark = self.bulk.encode("\x01", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _bulk_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these words one after the other, and how many each word has."""
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            text = " ".join(_PARTS.findall(b"\n".join(part).decode().lower())).replace("\n", "\x01") + " \x01"
            ids = np.array(self.bulk.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            marks = ids == self.mark[0]
            ends = np.flatnonzero(marks)
            if len(self.mark) != 1 or len(ends) != len(part):
                raise ValueError("words and ids don't line up")
            flat.append(ids[~marks])
            sizes.append(np.diff(ends, prepend=-1) - 1)
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, plain: np.ndarray) -> None:
        raw = data.tobytes()
        order = np.argsort(~plain, kind="stable")
        words = [raw[s:e] for s, e in zip(starts[order].tolist(), ends[order].tolist())]
        flat, size = self._bulk_ids(words[: int(plain.sum())])
        odd = [np.array(self.full.encode(w.decode(), add_special_tokens=False).ids, dtype=np.uint32) for w in words[len(size) :]]
        size = np.concatenate([size, np.array([len(x) for x in odd], np.int64)])
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, flat, *odd])
        keys = keys[order]
        order = np.argsort(keys)
        to = np.searchsorted(self.keys, keys[order])
        self.keys, self.at, self.size = np.insert(self.keys, to, keys[order]), np.insert(self.at, to, at[order]), np.insert(self.size, to, size[order])

    @staticmethod
    def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The spans whose ids stand alone, with their texts, a buffer in ASCII lower case to tell them by, and which are plain.

        A plain word has only ASCII without controls, apostrophe and bar, and Latin letters of two bytes; it is cut where
        letters, digits and other signs meet, which no token crosses. Other words stay whole.
        """
        starts, ends, doc = _seq.word_spans(data, off)
        low = _seq.lower_ascii(data)
        bad = (data < 32) | (data == 127) | (data == 39) | (data == 124) | (data == 0xC2) | (data >= 0xCA)
        times = (data[1:] == 0x97) | (data[1:] == 0xB7)
        bad[:-1] |= (data[:-1] == 0xC3) & times
        bad = np.concatenate([[0], np.cumsum(bad, dtype=np.int32)])
        plain = bad[ends] == bad[starts]
        letter = ((low >= 97) & (low <= 122)) | (data >= 128)
        kind = letter.astype(np.int8) + 2 * ((data >= 48) & (data <= 57)).astype(np.int8)
        change = np.concatenate([[False], kind[1:] != kind[:-1]])
        edge = np.zeros(len(data) + 1, np.int8)
        p = starts[plain]
        edge[p] += 1
        edge[ends[plain]] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
        begin = change & inside
        begin[starts] = True
        at = np.flatnonzero(begin)
        word = np.searchsorted(starts, at, "right") - 1
        to = np.minimum(np.concatenate([at[1:], [len(data)]]), ends[word]) if len(at) else at
        return at, to, doc[word], low, plain[word]

    def encode(self, data: np.ndarray, off: np.ndarray, closing: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, the closing id after each, and the offsets of the texts; in strips of some MB."""
        if not self.by_words:
            whole = data.tobytes()
            own = [[*self.full.encode(whole[a:b].decode(), add_special_tokens=False).ids, closing] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            return np.array([i for x in own for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        texts, a, ids, bounds = len(off) - 1, 0, [], [np.zeros(1, np.int64)]
        while a < texts:
            b = max(a + 1, int(np.searchsorted(off, off[a] + STRIP_BYTES, "right")) - 1)
            own, at = self._encode(data[off[a] : off[b]], off[a : b + 1] - off[a], closing)
            ids.append(own)
            bounds.append(at[1:] + bounds[-1][-1])
            a = b
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(bounds)

    def _encode(self, data: np.ndarray, off: np.ndarray, closing: int) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, doc, low, plain = self.units(data, off)
        h = _seq.hash_spans(low, starts, ends) ^ np.where(plain, np.uint64(0), np.uint64(1))
        if not plain.all():
            odd = np.flatnonzero(~plain)  # their case counts, by the tokenizer's own rules
            h[odd] = _seq.hash_spans(data, starts[odd], ends[odd]) ^ np.uint64(1)
        own, first, back = np.unique(h, return_index=True, return_inverse=True)
        new = own if not len(self.keys) else own[self.keys[np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)] != own]
        if len(new):
            if len(self.keys) + len(new) > CACHE_WORDS:
                self.clear()
                new = own
            f = first[np.searchsorted(own, new)]
            self._learn(data, starts[f], ends[f], new, plain[f])
        place = np.searchsorted(self.keys, own)[back] if len(own) else np.zeros(0, np.int64)
        size = self.size[place]
        texts = len(off) - 1
        per_doc = np.bincount(doc, weights=size, minlength=texts).astype(np.int64) + 1
        bounds = np.concatenate([[0], np.cumsum(per_doc)])
        out = np.full(bounds[-1], closing, np.uint32)
        # a word's ids stand behind all ids of earlier words and one closing id for each earlier text
        to = _seq.ragged(np.cumsum(size) - size + doc, size)
        out[to] = self.flat[_seq.ragged(self.at[place], size)]
        return out, bounds


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker and path."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def piece_bounds(tokens: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length): whole windows first, then pieces."""
    whole = tokens // capacity * capacity
    return [(s, capacity) for s in range(0, whole, capacity)] + [(s, min(piece, tokens - s)) for s in range(whole, tokens, piece)]


PIECES = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("doc_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]
DDL = {"doc_id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long", "doc_crc32": "long", "ids": "array<int>"}


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, piece: int = PIECE, closing: int = CLOSING, ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, doc_crc32 (of all ids) for every piece of every document; with `ids` the ids too."""
    fields = PIECES if ids else PIECES[:-1]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            data, off = _seq.text_bytes(batch["text"])
            first, texts = 0, len(off) - 1
            while first < texts:  # a strip's pieces leave before the next is read
                last = max(first + 1, int(np.searchsorted(off, off[first] + STRIP_BYTES, "right")) - 1)
                codes, bounds = coder.encode(data[off[first] : off[last]], off[first : last + 1] - off[first], closing)
                rows, sums = [], []
                for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), first):
                    whole = zlib.crc32(codes[a:b])
                    for s, n in piece_bounds(b - a, capacity, piece):
                        rows.append((d, s, n, b - a, whole))
                        sums.append(zlib.crc32(codes[a + s : a + s + n]))
                d, s, n, t, whole = np.array(rows, np.int64).reshape(-1, 5).T
                columns = [batch["doc_id"].take(pa.array(d)), *[pa.array(np.ascontiguousarray(x)) for x in (s, n, np.array(sums, np.int64), t, whole)]]
                if ids:  # pieces follow each other as the ids do
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(codes.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[x for x, _ in fields])
                first = last

    ddl = ", ".join(f"{x} {DDL[x]}" for x, _ in fields)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, ddl)


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each piece after Karmarkar-Karp multiway differencing.

    A partial partition is its slots' sums in ascending order, less the smallest, and a node for each slot; a node is
    a piece or two joined nodes. Sums need no common base: a base added to all slots leaves imbalances as they are.
    """
    n = len(sizes)
    if windows == 1:
        return np.zeros(n, np.int64)
    left, right, made = [], [], n
    heap = []
    # a piece alone: one filled slot, the last; slots of -1 are empty
    base = np.zeros(windows, np.int64)
    nobody = np.full(windows, -1, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        heap.append((-int(sizes[i]), len(heap), i))
    heapq.heapify(heap)
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    tick = n

    def take(item: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
        if item[2] >= 0:
            sums, nodes = base.copy(), nobody.copy()
            sums[-1], nodes[-1] = -item[0], item[2]
            return sums, nodes
        return parts.pop(item[1])

    while len(heap) > 1:
        (s1, n1), (s2, n2) = take(heapq.heappop(heap)), take(heapq.heappop(heap))
        sums, other = s1 + s2[::-1], n2[::-1]
        both = (n1 >= 0) & (other >= 0)
        nodes = np.where(n1 >= 0, n1, other)
        k = int(both.sum())
        if k:
            left += n1[both].tolist()
            right += other[both].tolist()
            nodes[both] = np.arange(made, made + k)
            made += k
        order = np.argsort(sums, kind="stable")
        sums = sums[order] - sums[order[0]]
        parts[tick] = (sums, nodes[order])
        heapq.heappush(heap, (-int(sums[-1]), tick, -1))
        tick += 1
    nodes = take(heap[0])[1]
    window = np.full(made, -1, np.int64)
    window[nodes[nodes >= 0]] = np.flatnonzero(nodes >= 0)
    for j in range(made - 1, n - 1, -1):  # a joined node is made after its parts
        window[left[j - n]] = window[right[j - n]] = window[j]
    return window[:n]


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; no window exceeds the capacity, and pieces of full capacity stand alone."""
    window, offset = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes), np.int64)
    whole = np.flatnonzero(sizes >= capacity)
    window[whole] = np.arange(len(whole))
    rest = np.flatnonzero(sizes < capacity)
    if len(rest):
        m = max(1, -(-int(sizes[rest].sum()) // capacity))
        while True:
            got = differencing(sizes[rest], m)
            if np.bincount(got, weights=sizes[rest]).max() <= capacity:
                break
            m += max(1, m // 400)
        order = np.lexsort((rest, got))
        size, got = sizes[rest][order], got[order]
        begin = np.cumsum(size) - size
        first = np.concatenate([[True], got[1:] != got[:-1]])
        number = np.cumsum(first) - 1
        window[rest[order]] = len(whole) + number
        offset[rest[order]] = begin - begin[first][number]
    return window, offset


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, piece: int = PIECE, closing: int = CLOSING, ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of every document.

    With `ids` each piece brings its token ids along, from which the sequences can be read in order of offset.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-total // BATCH_BYTES))
    pieces = token_pieces(docs, path, capacity, piece, closing, ids)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def batch(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        window, offset = pack(table["length"].to_numpy(), capacity)
        sequence = table["_batch"].to_numpy() * (1 << 24) + window
        return pa.table([*[table[c] for c in names], pa.array(sequence), pa.array(offset), *([table["ids"]] if ids else [])], names=[*names, "sequence_id", "offset", *(["ids"] if ids else [])])

    whole = F.when(F.col("length") == capacity, F.col("start")).otherwise(-1)
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0)
    dealt = pieces.withColumn("_batch", F.pmod(F.xxhash64("doc_id", "doc_crc32", whole, place), F.lit(batches)).cast("long")).drop("doc_crc32")
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if ids else "")
    return dealt.groupBy("_batch").applyInArrow(batch, ddl)
