"""Suffix-array dedup: a run-compressed Burrows-Wheeler index of repetitive passages, with matching statistics against it.

A byte is removed if it lies in `window` bytes that also start in a document of smaller id. `_repeats` deals passages
whose windows may repeat to shards; texts equal as a whole, and passages equal as a whole, are told by digest or by
content before. A shard's index is built of its passages as they are, all but windows that by their hash no other
document of the shard has. Of the suffix array, which is needed to build
it only, stay the runs of the Burrows-Wheeler transform, the suffix array's values at both ends of each run, and of each
interval of suffixes that begin with one window in several documents its place and its smallest document. So what stays
beside the text's own bytes grows with the runs and the distinct windows that repeat. The passages are then read from
right to left, many side by side: a step inside a run follows the last-to-first mapping; at another character it jumps
to the nearer run end of that character, whose sampled place tells how much of the match stays. Where the match reaches
the window's length, its interval tells whether a smaller document has it.

Edge cases: null and empty texts have no bytes; texts shorter than a window lose nothing; very long texts are read in
strips; rows that share an id are one document's, which never takes bytes from itself; a null id (or -2^63) counts as
the smallest; spans are of bytes and may cut a character; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm import _seq
from tidewell.llm._repeats import NULL_ID, Texts, Unit, judged, shared_pieces, true_runs

WINDOW, GRAM = 50, 16
#: Windows of a passage that one lane reads at most.
LANE = 256
SEPARATOR, END = 255, -1
#: Common prefixes are measured up to this many bytes; matches of a window's length or more need no more.
FAR = 64
NOBODY = np.iinfo(np.int32).max


def eights(text: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there as a number, without a copy of them; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(FAR + 8, np.uint8)])
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of bytes, by prefix doubling from eight bytes on; a suffix that ends is the smaller one."""
    n = len(text)
    ending = np.arange(n - 1, max(n - 8, -1), -1)  # suffixes of less than eight bytes, the shortest first
    places = np.concatenate([ending, np.arange(n - len(ending))])
    first = eights(text)[places].byteswap()
    by = np.argsort(first, kind="stable")
    order, first = places[by], first[by]
    new = np.ones(n, np.int64)
    new[1:] = (first[1:] != first[:-1]) | (order[1:] > n - 8) | (order[:-1] > n - 8)
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    del first, by, places
    k = 8
    while rank[order[-1]] < n if n else False:
        key = rank * (n + 2)
        key[: max(n - k, 0)] += rank[k:]
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.cumsum(np.concatenate([[1], (key[1:] != key[:-1]).astype(np.int64)]))
        k *= 2
    return order


class RunIndex:
    """The run-compressed transform of a text of bytes, with suffix array samples at run ends.

    owner: for each place the number of the document that has a window there, or NOBODY. Intervals of one window and
    several owners keep their smallest.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray | None = None, window: int = WINDOW):
        text = text.astype(np.uint8)
        n = len(text)
        self.size, self.eights = n, eights(text)
        sa = np.concatenate([[n], suffix_array(text)])  # the end comes first
        before = np.where(sa > 0, text[sa - 1].astype(np.int16), np.int16(END))
        start = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        last = np.concatenate([start[1:] - 1, [n]])
        self.start, self.char, self.last = start, before[start], last
        self.sa_first, self.sa_last = sa[start], sa[last]
        self.runs = len(start)
        size = last - start + 1
        # runs by character, then place: where each character's runs begin, and how many of it come before each run
        self.by_char = np.argsort(self.char, kind="stable")
        ordered = self.char[self.by_char]
        whole = np.cumsum(size[self.by_char]) - size[self.by_char]
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        group = np.cumsum(fresh) - 1
        self.mapped = np.empty(self.runs, np.int64)  # last-to-first image of each run's start: characters below, plus equal ones before
        self.mapped[self.by_char] = whole
        self.symbols, self.symbol_at = ordered[fresh], np.append(np.flatnonzero(fresh), self.runs)
        self.key = group * self.runs + self.by_char
        self.from_row, self.to_row, self.smallest = self._intervals(sa, owner, window) if owner is not None else (np.zeros(0, np.int64),) * 3

    def _intervals(self, sa: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        same = np.ones(len(sa) - 1, bool)
        for k in [*range(0, window - 8, 8), window - 8] if window >= 8 else [0]:
            x = self.eights[np.minimum(sa + k, self.size)]
            if window < 8:
                x = x & _seq._LANE_MASK[window]
            same &= x[1:] == x[:-1]
        row = np.flatnonzero(np.concatenate([[True], ~same]))
        who = np.append(owner, NOBODY)[sa]
        low = np.minimum.reduceat(who, row)
        high = np.maximum.reduceat(np.where(who == NOBODY, -1, who), row)
        several = (low < high) & (high >= 0)
        return row[several], np.append(row[1:], len(sa))[several], low[several].astype(np.int64)

    def smallest_owner(self, row: np.ndarray) -> np.ndarray:
        """The smallest owner of the window that the suffixes at these rows begin with, NOBODY where one owner has it."""
        if not len(self.from_row):
            return np.full(len(row), NOBODY, np.int64)
        k = np.maximum(np.searchsorted(self.from_row, row, "right") - 1, 0)
        return np.where((self.from_row[k] <= row) & (row < self.to_row[k]), self.smallest[k], NOBODY)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at x and y, up to FAR."""
        n = np.full(len(x), FAR, np.int64)
        on = np.arange(len(x))
        for k in range(0, FAR, 8):
            d = self.eights[np.minimum(x[on] + k, self.size)] ^ self.eights[np.minimum(y[on] + k, self.size)]
            differ = np.flatnonzero(d)
            low = d[differ] & (~d[differ] + np.uint64(1))  # the lowest bit that differs
            n[on[differ]] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
            on = on[d == 0]
            if not len(on):
                break
        return np.minimum(n, self.size - np.maximum(x, y))

    def matching(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, emit) -> None:
        """Calls emit(positions, lengths, rows) for the longest match of text[position:end] in the index, for every position
        of each lane; lengths of FAR or more may be stated less, but never below FAR."""
        order = np.argsort(begin - end, kind="stable")
        begin, end = begin[order], end[order]
        n = len(begin)
        j, sa, length = np.zeros(n, np.int64), np.full(n, self.sa_first[0]), np.zeros(n, np.int64)
        size = end - begin
        for t in range(int(size[0]) if n else 0):
            m = int(np.searchsorted(-size, -t, "left"))
            at = end[:m] - 1 - t
            c = text[at].astype(np.int16)
            run = np.searchsorted(self.start, j[:m], "right") - 1
            off = np.flatnonzero(self.char[run] != c)
            jump, to_sa, to_len = j[:m], sa[:m].copy(), length[:m].copy()
            if len(off):
                jump = jump.copy()
                g = np.minimum(np.searchsorted(self.symbols, c[off]), len(self.symbols) - 1)
                here = self.symbols[g] == c[off]
                near = np.searchsorted(self.key, g * self.runs + run[off])
                up_ok, down_ok = here & (near > self.symbol_at[g]), here & (near < self.symbol_at[g + 1])
                up, down = self.by_char[np.maximum(near - 1, 0)], self.by_char[np.minimum(near, self.runs - 1)]
                own = sa[:m][off]
                up_len = np.where(up_ok, self.common(own, self.sa_last[up]), -1)
                down_len = np.where(down_ok, self.common(own, self.sa_first[down]), -1)
                above = up_len >= down_len
                run[off] = np.where(above, up, down)
                jump[off] = np.where(above, self.last[up], self.start[down])
                to_sa[off] = np.where(above, self.sa_last[up], self.sa_first[down])
                to_len[off] = np.minimum(to_len[off], np.maximum(up_len, down_len))
                gone = off[~here]
                run[gone], jump[gone], to_sa[gone], to_len[gone] = 0, 0, self.sa_first[0], -1
            stays = to_len >= 0
            j[:m] = np.where(stays, self.mapped[run] + jump - self.start[run], 0)
            sa[:m] = np.where(stays, to_sa - 1, self.sa_first[0])
            length[:m] = to_len + 1
            emit(at, length[:m], j[:m])


def window_hashes(text: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Hashes of the bytes from these places."""
    u, h = eights(text), np.zeros(len(at), np.uint64)
    for k in range(0, window, 8):
        h = _seq.mix(h * _seq._M3 + (u[at + k] & _seq._LANE_MASK[min(8, window - k)]))
    return h


def run_index(window: int):
    """The shard index of `_repeats.judged` for bytes."""

    def index(contents: list[bytes], members: list[list[int]], doc: np.ndarray, at: np.ndarray):
        who, first, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sizes = np.array([len(c) for c in contents], np.int64)
        lead = np.empty(len(contents), np.int64)
        for k, m in enumerate(members):
            if len(m) > 1:
                low = min(doc[i] for i in m)
                more = [i for i in m if doc[i] > low]  # a smaller id has all of it
                if more:
                    who.append(np.array(more, np.int64))
                    first.append(np.zeros(len(more), np.int64))
                    last.append(np.full(len(more), sizes[k]))
                    m[:] = [i for i in m if doc[i] == low]
            lead[k] = m[0]
        owner = np.unique(doc[lead], return_inverse=True)[1].astype(np.int32)
        if len(owner) < 2 or owner.max() == 0:
            return np.concatenate(who), np.concatenate(first), np.concatenate(last)
        whole = np.frombuffer(b"".join(contents), np.uint8)
        begin = np.cumsum(sizes) - sizes
        windows = sizes - window + 1
        content = np.repeat(np.arange(len(contents)), windows)
        place = _seq.ragged(begin, windows)
        # windows that one document alone has match nothing; the index holds all others, as often as they are there
        piece, to = shared_pieces(window_hashes(whole, place, window), owner[content], content)
        if not len(piece):
            return np.concatenate(who), np.concatenate(first), np.concatenate(last)
        count, of = to - piece, content[piece]
        size = count + window
        start = np.cumsum(size) - size
        text = np.full(int(size.sum()), SEPARATOR, np.uint8)
        text[_seq.ragged(start, size - 1)] = whole[_seq.ragged(place[piece], size - 1)]
        at_owner = np.full(len(text), NOBODY, np.int32)
        at_owner[_seq.ragged(start, count)] = np.repeat(owner[of], count)
        built = RunIndex(text, at_owner, window)
        parts = -(-count // LANE)
        lane = np.repeat(start, parts) + LANE * _seq.ragged(np.zeros(len(start), np.int64), parts)
        end = np.minimum(lane + LANE, np.repeat(start + count, parts)) + window - 1
        mark = np.zeros(len(text), bool)

        def emit(at_: np.ndarray, length: np.ndarray, row: np.ndarray) -> None:
            hit = length >= window
            p = at_[hit]
            mark[p] |= built.smallest_owner(row[hit]) < at_owner[p]

        built.matching(text, lane, end, emit)
        # a mark is a window's start; windows of one content stand together
        mark &= at_owner != NOBODY
        for x, y in zip(*true_runs(mark)):
            k = int(np.searchsorted(start, x, "right")) - 1
            ahead = int(place[piece[k]] - begin[of[k]] - start[k])
            for i in members[of[k]]:
                who.append(np.array([i]))
                first.append(np.array([x + ahead]))
                last.append(np.array([y - 1 + ahead + window]))
        return np.concatenate(who), np.concatenate(first), np.concatenate(last)

    return index


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _report(t: Texts, removed: np.ndarray | None) -> pa.Table:
    rows = []
    for a, b in zip(t.off[:-1].tolist(), t.off[1:].tolist()):
        body = t.data[a:b]
        gone = removed[a:b] if removed is not None else np.zeros(b - a, bool)
        kept = body[~gone] if gone.any() else body
        rows.append((b - a, int(gone.sum()), len(true_runs(gone)[0]), hashlib.sha256(kept.tobytes()).hexdigest()))
    return pa.table([pa.array(t.ids, pa.int64(), mask=t.ids == NULL_ID), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array([r[3] for r in rows], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def run_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    return judged(docs, Unit(False, window, max(8, min(GRAM, window))), run_index(window), False, _report, REPORT)
