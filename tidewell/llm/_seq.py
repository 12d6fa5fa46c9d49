"""Numpy helpers on UTF-8 byte buffers: words, fingerprints, minimizers, ragged arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_LANE_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)
#: Words longer than this many bytes are fingerprinted one by one.
LONG_WORD = 512


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one buffer, and its n + 1 offsets. Null counts as empty."""
    arr = pc.fill_null(col, "").cast(pa.large_string())
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64, count=len(arr) + 1, offset=arr.offset * 8)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def portions(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with up to `most` bytes of text, or one longer text."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(size), 0
        while start < batch.num_rows:
            told = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, told + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> U64(30))) * _M2
    h = (h ^ (h >> U64(27))) * _M3
    return h ^ (h >> U64(31))


def lanes(data: np.ndarray) -> np.ndarray:
    """For each byte position the eight bytes from there, little-endian, zeros past the end."""
    u = np.concatenate([data, np.zeros(7, np.uint8)]).astype(U64)
    u = u[:-1] | (u[1:] << U64(8))
    u = u[:-2] | (u[2:] << U64(16))
    return u[:-4] | (u[4:] << U64(32))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words [^\\x20\\x09-\\x0D]+; no word crosses two texts."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begin[cut] = word[cut]
    end[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of byte spans, eight bytes a step for all spans that still have bytes."""
    h = mix((ends - starts).astype(U64) * _M1)
    if len(starts) == 0:
        return h
    u = lanes(data)
    size = ends - starts
    long = np.flatnonzero(size > LONG_WORD)
    on = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    pos, left = starts[on].copy(), size[on].copy()
    while len(on):
        h[on] = mix((h[on] ^ (u[pos] & _LANE_MASK[np.minimum(left, 8)])) * _M1)
        more = left > 8
        on, pos, left = on[more], pos[more] + 8, left[more] - 8
    for i in long:
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of each piece, one piece after the other."""
    total = int(sizes.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values; len(h) - w + 1 of them."""
    if len(h) < w:
        return h[:0]
    m, s = h, 1
    while 2 * s <= w:
        m, s = np.minimum(m[:-s], m[s:]), 2 * s
    return np.minimum(m[: len(m) - (w - s)], m[w - s :]) if s < w else m

