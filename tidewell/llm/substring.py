"""Substring dedup: suffix automata of reference shards, documents streamed through them for matching statistics.

A word is removed if it lies in `window` consecutive words whose sequence also starts earlier (in a document of smaller
id, or earlier in the same one). `_repeats` deals passages whose windows may repeat to shards; texts and passages equal
as a whole are told by digest or by content before. In a shard a suffix automaton is built of its passages as they
are, all but windows that by their hash are at one place alone, whose states know their earliest place; then the passages are streamed through it for matching statistics: where
the match reaches the window's length at an earlier place, the maximal span is marked. The reference of a whole corpus
grows with it, so shards are dealt out by key, of some MB each however large the corpus, in place of one broadcast of
all automata to all tasks.

Edge cases: null and empty texts and texts of fewer words than a window lose nothing (null: no words, the hash of the
empty string). Very long texts are read in strips. Rows that share an id are one document's: neither is earlier than
the other by its row. A null id (or -2^63) counts as the smallest. Empty tables give no rows; other columns are ignored by
`substring_report` and handed on by `without_repeats`, which takes the texts of a shared or null id for documents of
their own, in order of their digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import _seq, _shuffle
from tidewell.llm._repeats import NULL_ID, Texts, Unit, digested, ids_repeat, join_hashes, judged, numbers, packed_rows, shared_pieces, true_runs

WINDOW = 20


class SuffixAutomaton:
    """A suffix automaton of several passages; a state's `first` is the end of its earliest place.

    Most states have one edge, which stands in two lists; only states of several edges have a dictionary.
    """

    def __init__(self) -> None:
        self.unit, self.to = [-1], [0]
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length, self.first = [-1], [0], [-1]

    def step(self, state: int, unit: int) -> int:
        """The state after one more unit, or -1."""
        if self.unit[state] == unit:
            return self.to[state]
        edges = self.more.get(state)
        return -1 if edges is None else edges.get(unit, -1)

    def _point(self, state: int, unit: int, to: int) -> None:
        if self.unit[state] in (-1, unit):
            self.unit[state], self.to[state] = unit, to
        else:
            self.more.setdefault(state, {})[unit] = to

    def _state(self, link: int, length: int, first: int) -> int:
        self.unit.append(-1)
        self.to.append(0)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of exactly the strings that p reaches by c, taken out of q if q also has longer ones."""
        link, length = self.link, self.length
        if length[p] + 1 == length[q]:
            return q
        copy = self._state(link[q], length[p] + 1, self.first[q])
        self.unit[copy], self.to[copy] = self.unit[q], self.to[q]
        if q in self.more:
            self.more[copy] = self.more[q].copy()
        link[q] = copy
        while p >= 0 and self.step(p, c) == q:
            self._point(p, c, copy)
            p = link[p]
        return copy

    def add(self, passage: list[int], places: list[int]) -> None:
        """One more passage, with the places of its units."""
        link, length, first = self.link, self.length, self.first
        last = 0
        for c, i in zip(passage, places):
            q = self.step(last, c)
            if q >= 0:  # an earlier passage has it
                last = self._split(last, q, c)
                if i < first[last]:
                    first[last] = i
                continue
            made = self._state(0, length[last] + 1, i)
            p = last
            while p >= 0 and self.step(p, c) < 0:
                self._point(p, c, made)
                p = link[p]
            if p >= 0:
                link[made] = self._split(p, self.step(p, c), c)
            last = made

    def settle(self) -> None:
        """Hands each state's earliest place on to the states of its suffixes; after all passages are added."""
        link, first = self.link, self.first
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            up = link[state]
            if up > 0 and first[state] < first[up]:
                first[up] = first[state]

    def matches(self, text: list[int], size: int) -> list[int]:
        """For each unit the end of the earliest place of the `size` units up to it, or -1 if they are nowhere."""
        link, length, first, unit, to, more = self.link, self.length, self.first, self.unit, self.to, self.more
        out, v, n = [], 0, 0
        for c in text:
            while True:
                if unit[v] == c:
                    v = to[v]
                    n += 1
                    break
                edges = more.get(v)
                if edges is not None and c in edges:
                    v = edges[c]
                    n += 1
                    break
                if v == 0:
                    n = 0
                    break
                v = link[v]
                n = length[v]
            if n >= size:
                while length[link[v]] >= size:
                    v = link[v]
                    n = length[v]
                out.append(first[v])
            else:
                out.append(-1)
        return out


def automaton_index(window: int):
    """The shard index of `_repeats.judged` for words."""

    def index(contents: list[bytes], members: list[list[int]], doc: np.ndarray, at: np.ndarray):
        who, first, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        lead, sizes = np.empty(len(contents), np.int64), np.empty(len(contents), np.int64)
        passages: list[list[int]] = []
        words: dict[bytes, int] = {}
        for k, (c, m) in enumerate(zip(contents, members)):
            passages.append([words.setdefault(w, len(words)) for w in c.split(b" ")])
            sizes[k] = len(passages[k])
            lead[k] = low = min(m, key=lambda i: (doc[i], at[i]))
            later = [i for i in m if (doc[i], at[i]) != (doc[low], at[low])]
            if later:  # the same content at a later place: every window of it starts earlier
                who.append(np.array(later, np.int64))
                first.append(np.zeros(len(later), np.int64))
                last.append(np.full(len(later), sizes[k]))
                m[:] = [i for i in m if (doc[i], at[i]) == (doc[low], at[low])]
        # contents are laid out by their earliest places, so that a unit's number tells its place
        order = np.lexsort((at[lead], doc[lead]))
        begin = np.empty(len(contents), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        unit_doc = np.repeat(doc[lead[order]], sizes[order])
        unit_at = np.repeat(at[lead[order]] - begin[order], sizes[order]) + np.arange(len(unit_doc))
        # only rows that share an id can have places in another order, or places that are one
        rank = unit_doc.astype(np.int64)
        later_place = (unit_doc[1:] > unit_doc[:-1]) | (unit_at[1:] > unit_at[:-1])
        if later_place.all():
            rank = np.arange(len(unit_doc))
        else:
            by_place = np.lexsort((unit_at, unit_doc))
            fresh = np.concatenate([[True], (unit_doc[by_place[1:]] != unit_doc[by_place[:-1]]) | (unit_at[by_place[1:]] != unit_at[by_place[:-1]])])
            rank[by_place] = np.cumsum(fresh) - 1
        # windows that by their hash are at one place alone match nothing; all others stand in the automaton
        flat = np.array([w for k in order.tolist() for w in passages[k]], np.uint64)
        content = np.repeat(order, sizes[order])
        hashes = join_hashes(_seq.mix((flat + np.uint64(1)) * _seq._M1), window)
        valid = np.flatnonzero(content[: len(hashes)] == content[window - 1 :])
        piece, to = shared_pieces(hashes[valid], rank[valid], content[valid])
        piece, to, units = valid[piece].tolist(), (valid[to - 1] + window).tolist(), flat.tolist()
        automaton = SuffixAutomaton()
        for a, b in zip(piece, to):
            automaton.add(units[a:b], rank[a:b].tolist())
        automaton.settle()
        for a, b in zip(piece, to):
            k = content[a]
            found = np.array(automaton.matches(units[a:b], window)[window - 1 :], np.int64)
            ahead = a - begin[k]
            for x, y in zip(*true_runs((found >= 0) & (found < rank[a + window - 1 : b]))):
                for i in members[k]:
                    who.append(np.array([i]))
                    first.append(np.array([ahead + x]))
                    last.append(np.array([ahead + y + window - 1]))
        return np.concatenate(who), np.concatenate(first), np.concatenate(last)

    return index


REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _kept(t: Texts, removed: np.ndarray | None, docs: np.ndarray | None = None):
    """The kept words of each document, or of these, joined by one space, with the numbers of words and of removed words."""
    for d in range(len(t.ids)) if docs is None else docs.tolist():
        a, b = int(t.off[d]), int(t.off[d + 1])
        if a == b:
            yield b"", 0, 0
            continue
        gone = removed[a:b] if removed is not None else np.zeros(b - a, bool)
        if not gone.any():
            yield t.data[t.begin[a] : t.end[b - 1]].tobytes(), b - a, 0
            continue
        yield b" ".join([t.data[t.begin[a + i] : t.end[a + j - 1]].tobytes() for i, j in zip(*true_runs(~gone))]), b - a, int(gone.sum())


def _ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def _report(t: Texts, removed: np.ndarray | None) -> pa.Table:
    rows = [(n, m, hashlib.sha256(text).hexdigest()) for text, n, m in _kept(t, removed)]
    return pa.table([_ids(t.ids), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _text(t: Texts, removed: np.ndarray | None) -> pa.Table:
    """The kept text of each document that loses words; others need not leave the task."""
    gone = np.concatenate([[0], np.cumsum(removed)]) if removed is not None else np.zeros(int(t.off[-1]) + 1, np.int64)
    docs = np.flatnonzero(gone[t.off[1:]] > gone[t.off[:-1]])
    return pa.table([_ids(t.ids[docs]), pa.array([text.decode() for text, _, _ in _kept(t, removed, docs)], pa.string())], names=["doc_id", "kept"])


def substring_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    return judged(docs, Unit(True, window, max(1, min(6, window))), automaton_index(window), True, _report, REPORT)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated words taken out of `text`; texts without any stay as they are, and a text of which nothing is left goes."""
    rows = packed_rows(docs)
    if repeat := ids_repeat(docs):
        rows = digested(docs)
        rows = _shuffle.cut(rows.join(numbers(rows), ["id", "digest"]).select(F.col("n").alias("id"), "row"))
    texts = rows.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text"))
    kept = judged(texts, Unit(True, window, max(1, min(6, window))), automaton_index(window), True, _text, "doc_id long, kept string")
    kept = kept.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.col("kept"))
    kept = kept.dropDuplicates(["id"]) if repeat else kept
    rows = rows.join(kept, "id", "left").filter("kept is null or kept <> ''")
    return rows.select(F.col("row").withField("text", F.coalesce("kept", F.col("row.text"))).alias("row")).select("row.*")
