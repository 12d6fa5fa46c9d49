"""Windows that repeat: from texts to segments in shards, an index in each shard, and back to spans of each text.

A window is a run of `window` units (bytes or words) of one document. Its key is the least hash among its `gram`-unit
pieces, so equal windows have equal keys, and neighbours mostly share one. In one plan:

1. rows are dealt by a hash of the id into groups of bounded size; documents whose whole text a smaller id has are
   told apart by a grouped minimum over text digests and take part no further;
2. each group sends its distinct keys once, to buckets, and gets back those that occur twice or more anywhere;
3. of keys that occur more than HOT times (those of a very common passage, whose edges differ in every document) the
   windows' own hashes go the same way, and only windows that occur twice or more stay;
4. runs of windows that are left become segments; each group sends a segment's content once, to the key's shard;
5. the shard's index judges every window of every distinct segment on exact content, and returns spans;
6. each group unites the spans of each of its documents.

Steps 2 and 3 only spare windows that can't repeat the way to a shard; what repeats is found in the shard's index. A
common passage is one key and one segment a group however many documents hold it; no pairs are made; texts are shuffled
once and that exchange is reused; nothing goes through the driver but a count. A doc_id of -2^63 stands for null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import _seq, _shuffle

U64 = np.uint64
NULL_ID = -(1 << 63)
#: Window keys are made for so many units at a time, and words are parted by one space for so many bytes of them.
STRIP = 100_000
#: Segments of one key from which on its windows are looked at one by one.
HOT = 1024


@dataclass(frozen=True)
class Unit:
    """What a text is made of: bytes or words, the length of a window and of the pieces that make its key."""

    words: bool
    window: int
    gram: int


@dataclass
class Texts:
    """The texts of a group: a buffer, and where each unit of it begins and ends; words are followed by one space."""

    ids: np.ndarray
    tags: np.ndarray  # of the texts, which tell rows that share an id apart
    data: np.ndarray
    begin: np.ndarray | None  # None: every byte is a unit
    end: np.ndarray | None
    off: np.ndarray  # of documents, in units

    def content(self, at: int, units: int) -> bytes:
        if self.begin is None:
            return self.data[at : at + units].tobytes()
        return self.data[self.begin[at] : self.end[at + units - 1]].tobytes()


def load(unit: Unit, table: pa.Table) -> Texts:
    ids = table["doc_id"].to_numpy()
    data, off = _seq.text_bytes(table["text"])
    tags = np.frombuffer(b"".join([hashlib.md5(data[a:b]).digest()[:8] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]), np.int64)
    if not unit.words:
        return Texts(ids, tags, data, None, None, off)
    even, first, last, words, a, to = np.empty(len(data) + len(ids), np.uint8), [off[:0]], [off[:0]], [off[:0]], 0, 0
    while a < len(ids):  # spans and indexes take many times the bytes of their texts
        b = max(a + 1, int(np.searchsorted(off, off[a] + STRIP, "right")) - 1)
        starts, ends, own = _seq.word_spans(data[off[a] : off[b]], off[a : b + 1] - off[a])
        size = ends - starts
        last.append(to + np.cumsum(size + 1) - 1)
        first.append(last[-1] - size)
        words.append(np.bincount(own, minlength=b - a))
        for i in range(0, len(size), STRIP):
            put, take, n = first[-1][i : i + STRIP], starts[i : i + STRIP] + off[a], size[i : i + STRIP]
            even[_seq.ragged(put, n)] = data[_seq.ragged(take, n)]
        even[last[-1]] = 32
        to += int((size + 1).sum())
        a = b
    return Texts(ids, tags, even[:to], np.concatenate(first), np.concatenate(last), np.concatenate([[0], np.cumsum(np.concatenate(words))]))


def gram_hashes(unit: Unit, t: Texts, a: int, b: int) -> np.ndarray:
    """Hashes of the pieces that begin at units a to b - gram."""
    if unit.words:
        h = _seq.hash_spans(t.data[t.begin[a] : t.end[b - 1]], t.begin[a:b] - t.begin[a], t.end[a:b] - t.begin[a])
        return join_hashes(h, unit.gram)
    u = _seq.lanes(t.data[a:b])
    n = b - a - unit.gram + 1
    g = _seq.mix(u[:n] * _seq._M1)
    for k in range(8, unit.gram, 8):
        k = min(k, unit.gram - 8)
        g = _seq.mix((g ^ u[k : k + n]) * _seq._M1)
    return g


def join_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive hashes, by doubling."""
    n, done, level, out = len(h) - k + 1, 0, h, None
    if n <= 0:
        return h[:0]
    size = 1
    while True:
        if k & size:
            part = level[done : done + n]
            out = part if out is None else _seq.mix(out * _seq._M3 + part)
            done += size
        size *= 2
        if size > k:
            return out
        level = _seq.mix(level[: -(size // 2)] * _seq._M2 + level[size // 2 :])


def strips(unit: Unit, t: Texts, skip: np.ndarray):
    """(first unit, document, key, place among the strip's pieces) of every window, and the pieces' hashes, a strip at a time."""
    w = unit.window - unit.gram + 1
    size = np.maximum(np.diff(t.off) - unit.window + 1, 0)
    size[skip] = 0
    ends = np.cumsum(size)
    a, total = 0, int(ends[-1]) if len(ends) else 0
    place = t.off[:-1] - (ends - size)  # from a window's number to its first unit
    while a < total:
        b = min(a + STRIP, total)
        d0, d1 = np.searchsorted(ends, [a, b - 1], "right")
        docs = np.arange(d0, d1 + 1)
        first = np.maximum(ends[docs] - size[docs], a)
        n = np.minimum(ends[docs], b) - first
        docs, first, n = docs[n > 0], first[n > 0], n[n > 0]
        p = _seq.ragged(first + place[docs], n)
        lo, hi = int(p[0]), int(p[-1]) + unit.window
        g = gram_hashes(unit, t, lo, hi)
        yield p, np.repeat(docs, n), _seq.sliding_min(g, w)[p - lo], p - lo, g
        a = b


def window_hashes(unit: Unit, g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows at these places, from the hashes of pieces that cover them."""
    h = np.zeros(len(at), U64)
    for k in [*range(0, unit.window - unit.gram, unit.gram), unit.window - unit.gram]:
        h = _seq.mix(h * _seq._M3 + g[at + k])
    return h


def breaks(p: np.ndarray, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where runs of neighbouring windows with one key and document begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(p)), bool), (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (p[1:] != p[:-1] + 1)]))


def key_counts(unit: Unit, t: Texts, skip: np.ndarray, occurrences: bool) -> tuple[np.ndarray, np.ndarray]:
    """The group's distinct keys and their runs; with occurrences each run counts as often as it has its least piece."""
    w, keys, counts = unit.window - unit.gram + 1, [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for p, doc, key, at, g in strips(unit, t, skip):
        new = breaks(p, key, doc)
        times = np.ones(len(new), np.int64)
        if occurrences:
            span = np.diff(np.append(new, len(p))) + w - 1
            same = g[_seq.ragged(at[new], span)] == np.repeat(key[new], span)
            times = np.add.reduceat(same.astype(np.int64), np.cumsum(span) - span)
        keys.append(key[new])
        counts.append(times)
    return summed_by_key(np.concatenate(keys), np.concatenate(counts))


def summed_by_key(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return key[at], (np.add.reduceat(count, at) if len(at) else count)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ones."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def shared_pieces(hashes: np.ndarray, owner: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of windows, neighbours in one content, whose hash several owners have; all others match nothing."""
    order = np.argsort(hashes, kind="stable")
    h, who = hashes[order], owner[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
    keep = np.zeros(len(h), bool)
    if len(at):
        several = np.minimum.reduceat(who, at) < np.maximum.reduceat(who, at)
        keep[order] = np.repeat(several, np.diff(np.append(at, len(h))))
    on = np.flatnonzero(keep)
    new = breaks(on, content[on], content[on])
    return on[new], np.append(on[new[1:] - 1], on[-1:]) + 1


NOTE_DDL = "g int, kind int, a binary, b binary, c binary"
SEGMENT_SCHEMA = pa.schema([("shard", pa.int32()), ("g", pa.int32()), ("docs", pa.binary()), ("at", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])
SEGMENT_DDL = "shard int, g int, docs binary, at binary, sizes binary, data binary"
COPY, KEYS, SPANS, WINDOWS = 0, 1, 2, 3


def notes(table: pa.Table, kind: int) -> list[list[bytes]]:
    rows = table.filter(pa.compute.equal(table["kind"], kind)) if table.num_rows else table
    return [rows[c].to_pylist() for c in "abc"]


def pairs_of(ids: np.ndarray, tags: np.ndarray) -> bytes:
    return np.stack([ids, tags], 1).tobytes()


def copied(t: Texts, table: pa.Table) -> np.ndarray:
    """Numbers of the documents whose whole text a smaller id has."""
    blobs = notes(table, COPY)[0]
    if not blobs:
        return np.zeros(0, np.int64)
    told = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 2) for b in blobs])
    one = lambda ids, tags: _seq.mix(ids.astype(U64) * _seq._M1) ^ tags.astype(U64)
    return np.flatnonzero(np.isin(one(t.ids, t.tags), one(told[:, 0], told[:, 1])))


def told_keys(table: pa.Table, kind: int, above: int = 0) -> np.ndarray:
    """The sorted keys of a group's notes of this kind that occur more than `above` times."""
    keys, counts, _ = notes(table, kind)
    if not keys:
        return np.zeros(0, U64)
    key, count = np.concatenate([np.frombuffer(b, U64) for b in keys]), np.concatenate([np.frombuffer(b, np.uint32) for b in counts])
    return np.sort(key[count > above])


def hot_windows(unit: Unit, t: Texts, skip: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the group's windows whose key is among the hot ones."""
    found = [np.zeros(0, U64)]
    for _, _, key, at, g in strips(unit, t, skip):
        found.append(window_hashes(unit, g, at[find(hot, key)]))
    h = np.concatenate(found)
    return summed_by_key(h, np.ones(len(h), np.int64))


def segments(unit: Unit, t: Texts, skip: np.ndarray, keys: np.ndarray, hot: np.ndarray, repeated: np.ndarray):
    """Runs of windows whose key repeats, of a hot key those that repeat themselves, in order of (document id, start): start, windows, key, document."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))]
    for p, doc, key, at, g in strips(unit, t, skip):
        on = find(keys, key)
        if len(hot):
            close = np.flatnonzero(on)
            close = close[find(hot, key[close])]
            on[close] = find(repeated, window_hashes(unit, g, at[close]))
        p, doc, key = p[on], doc[on], key[on]
        new = breaks(p, key, doc)
        parts.append((p[new], np.diff(np.append(new, len(p))), key[new], doc[new]))
    start, count, key, doc = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((start, t.ids[doc]))
    return start[order], count[order], key[order], doc[order]


def first_of_content(unit: Unit, t: Texts, start: np.ndarray, count: np.ndarray, doc: np.ndarray, own_too: bool) -> tuple[np.ndarray, list[bytes]]:
    """Which segments are not told by an earlier one of the group with the same content, and those segments' contents."""
    seen: dict[bytes, tuple[int, int]] = {}
    keep, content = np.zeros(len(start), bool), []
    ids, at = t.ids[doc].tolist(), (start - t.off[doc]).tolist()
    for i, (s, n) in enumerate(zip(start.tolist(), (count + unit.window - 1).tolist())):
        c = t.content(s, n)
        first = seen.setdefault(c, (ids[i], at[i]))
        if first[0] == ids[i] and (not own_too or first[1] == at[i]):
            keep[i] = True
            content.append(c)
    return keep, content


def text_copies(docs: DataFrame, groups: int) -> DataFrame:
    """Notes of the documents whose whole text a document with a smaller id has; minima are taken before the shuffle."""
    rows = docs.filter("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("_digest"))
    first = rows.groupBy("_digest").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).filter("_last > _first")
    # the rows of one digest meet a single row; joined by another form of it, both sides are exchanged and Spark may split a large digest
    found = rows.withColumn("_key", F.unhex("_digest")).join(first.select(F.unhex("_digest").alias("_key"), "_first"), "_key").filter("doc_id > _first").select(group_of(groups).alias("g"), "doc_id", F.col("_key").alias("digest"))

    def blob(batches):
        for batch in batches:
            g, ids = batch["g"].to_numpy(), batch["doc_id"].to_numpy()
            tags = np.frombuffer(b"".join([x[:8] for x in batch["digest"].to_pylist()]), np.int64)
            order = np.argsort(g, kind="stable")
            g, ids, tags = g[order], ids[order], tags[order]
            cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
            to = np.concatenate([cut[1:], [len(g)]]).astype(np.int64)
            yield note_rows(g[cut], COPY, [pairs_of(ids[a:b], tags[a:b]) for a, b in zip(cut, to)])

    return found.mapInArrow(blob, NOTE_DDL)


def note_rows(g, kind: int, a, b=None, c=None) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(np.full(n, kind, np.int32)), pa.array(a, pa.binary()), pa.array(b or [None] * n, pa.binary()), pa.array(c or [None] * n, pa.binary())], names=["g", "kind", "a", "b", "c"])


def group_of(groups: int):
    return F.expr(f"cast(pmod(xxhash64(doc_id), {groups}) as int)")


def judged(docs: DataFrame, unit: Unit, index: Callable, own_too: bool, result: Callable, ddl: str) -> DataFrame:
    """Rows of `result(texts, removed)` for every document, with removed units as found by the shards' `index`.

    index(contents, members) gets a shard's distinct contents and for each the (document id, start) that have it, and
    returns (member number, first unit, last unit) of the spans to remove. own_too: earlier places in the same document count.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    groups = _shuffle.group_count(docs)
    texts = docs.select(group_of(groups).alias("g"), "doc_id", "text")
    copies = text_copies(docs, groups)

    def keys(own: pa.Table, told: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _shuffle.KEYS_SCHEMA.empty_table()
        t = load(unit, own)
        return _shuffle.key_rows(own["g"][0].as_py(), *key_counts(unit, t, copied(t, told), own_too), groups)

    sent = texts.groupBy("g").cogroup(copies.groupBy("g")).applyInArrow(keys, _shuffle.KEYS_DDL)
    back = lambda rows, kind: _shuffle.repeated_keys(rows).select("g", F.lit(kind).alias("kind"), F.col("keys").alias("a"), F.col("counts").alias("b"), F.lit(None).cast("binary").alias("c"))
    repeated = copies.unionByName(back(sent, KEYS))

    def closely(own: pa.Table, told: pa.Table) -> pa.Table:
        hot = told_keys(told, KEYS, HOT) if own.num_rows else np.zeros(0, U64)
        if not len(hot):
            return _shuffle.KEYS_SCHEMA.empty_table()
        t = load(unit, own)
        return _shuffle.key_rows(own["g"][0].as_py(), *hot_windows(unit, t, copied(t, told), hot), groups)

    again = texts.groupBy("g").cogroup(repeated.groupBy("g")).applyInArrow(closely, _shuffle.KEYS_DDL)
    known = repeated.unionByName(back(again, WINDOWS))

    def local(own: pa.Table, told: pa.Table):
        t = load(unit, own)
        skip = copied(t, told)
        start, count, key, doc = segments(unit, t, skip, told_keys(told, KEYS), told_keys(told, KEYS, HOT), told_keys(told, WINDOWS))
        keep, content = first_of_content(unit, t, start, count, doc, own_too)
        return t, skip, start, count, key, doc, keep, content

    def send(own: pa.Table, told: pa.Table) -> pa.Table:
        if not own.num_rows or not told.num_rows:
            return SEGMENT_SCHEMA.empty_table()
        t, _, start, count, key, doc, keep, content = local(own, told)
        shard = _shuffle.bucket_of(key[keep], groups)
        ids, tags, at = t.ids[doc[keep]], t.tags[doc[keep]], (start - t.off[doc])[keep]
        sizes = np.array([len(c) for c in content], np.int32)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(groups + 1))
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        rows = [order[bounds[s] : bounds[s + 1]] for s in full]
        return pa.table([pa.array(full, pa.int32()), pa.array(np.full(len(full), own["g"][0].as_py(), np.int32)), pa.array([pairs_of(ids[r], tags[r]) for r in rows], pa.binary()), pa.array([at[r].tobytes() for r in rows], pa.binary()), pa.array([sizes[r].tobytes() for r in rows], pa.binary()), pa.array([b"".join([content[i] for i in r.tolist()]) for r in rows], pa.binary())], schema=SEGMENT_SCHEMA)

    def judge(table: pa.Table) -> pa.Table:
        members: list[tuple[int, int, int, int]] = []
        by_content: dict[bytes, list[int]] = {}
        for g, docs_, at, sizes, data in zip(*[table[c].to_pylist() for c in ("g", "docs", "at", "sizes", "data")]):
            to = 0
            for (d, tag), p, n in zip(np.frombuffer(docs_, np.int64).reshape(-1, 2).tolist(), np.frombuffer(at, np.int64).tolist(), np.frombuffer(sizes, np.int32).tolist()):
                by_content.setdefault(data[to : to + n], []).append(len(members))
                members.append((d, p, g, tag))
                to += n
        place = np.array(members, np.int64).reshape(-1, 4)
        who, first, last = index(list(by_content), list(by_content.values()), place[:, 0], place[:, 1])
        g = place[who, 2]
        order = np.argsort(g, kind="stable")
        g, who, first, last = g[order], who[order], first[order], last[order]
        cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        to = np.concatenate([cut[1:], [len(g)]]).astype(np.int64)
        parts = list(zip(cut.tolist(), to.tolist()))
        a = [pairs_of(place[who[i:j], 0], place[who[i:j], 3]) for i, j in parts]
        return pa.Table.from_batches([note_rows(g[cut], SPANS, a, [(place[who[i:j], 1] + first[i:j]).tobytes() for i, j in parts], [(place[who[i:j], 1] + last[i:j]).tobytes() for i, j in parts])])

    segs = texts.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(send, SEGMENT_DDL)
    spans = segs.groupBy("shard").applyInArrow(judge, NOTE_DDL)

    def finish(own: pa.Table, told: pa.Table) -> pa.Table:
        if not own.num_rows:
            return result(load(unit, own), None)
        t, skip, start, count, key, doc, keep, _ = local(own, told)
        change = np.zeros((int(t.off[-1]) if len(t.off) else 0) + 1, np.int32)
        n = t.off[skip + 1] - t.off[skip]
        skip = skip[n >= unit.window]
        np.add.at(change, t.off[skip], 1)
        np.add.at(change, t.off[skip + 1], -1)
        np.add.at(change, start[~keep], 1)  # the group holds their content at an earlier place
        np.add.at(change, (start + count + unit.window - 1)[~keep], -1)
        a, b, c = notes(told, SPANS)
        if a:
            pair, first, last = (np.concatenate([np.frombuffer(x, np.int64) for x in y]) for y in (a, b, c))
            ids, tags = pair.reshape(-1, 2).T
            order = np.argsort(t.ids, kind="stable")
            lo, hi = np.searchsorted(t.ids[order], ids, "left"), np.searchsorted(t.ids[order], ids, "right")
            for i in range(int((hi - lo).max())):  # more than once only for rows that share an id
                ok = hi - lo > i
                d = order[lo[ok] + i]
                own = t.tags[d] == tags[ok]
                d = d[own]
                np.add.at(change, first[ok][own] + t.off[d], 1)
                np.add.at(change, last[ok][own] + t.off[d], -1)
        return result(t, np.cumsum(change[:-1]) > 0)

    every = known.unionByName(spans)
    return texts.groupBy("g").cogroup(every.groupBy("g")).applyInArrow(finish, ddl)


def packed_rows(docs: DataFrame) -> DataFrame:
    """(id, row): each row in one column, so that no name of it can clash."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def ids_repeat(docs: DataFrame) -> bool:
    """Whether several rows share an id; null counts as one."""
    most = docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) > 1


def digested(docs: DataFrame) -> DataFrame:
    """packed_rows with a digest of the text; id and digest tell texts of one id (or of none) apart."""
    return packed_rows(docs).withColumn("digest", F.coalesce(F.md5(F.col("row.text").cast("string").cast("binary")), F.lit("")))


def numbers(rows: DataFrame) -> DataFrame:
    """(id, digest, n): a number for each id and digest, in their order; a checkpoint holds the order."""
    ordered = _shuffle.cut(rows.select("id", "digest").distinct().orderBy("id", "digest"))
    return ordered.select("id", "digest", F.monotonically_increasing_id().alias("n"))


def true_runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open bounds of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
