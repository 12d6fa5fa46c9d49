"""Hashed character n-grams of byte buffers."""

from __future__ import annotations

import numpy as np

from tidewell.llm import _seq

U64 = np.uint64


def gram_slots(u: np.ndarray, n: int, slots: int) -> np.ndarray:
    """The slot of the n bytes from each place, from the eight bytes there; `slots` is a power of two."""
    return (_seq.mix(((u & _seq._LANE_MASK[n]) + U64(n)) * _seq._M1) & U64(slots - 1)).astype(np.int32)


def within(off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For pieces with these offsets the number of n-grams in each, and the places where they start."""
    size = np.maximum(np.diff(off) - n + 1, 0)
    return size, _seq.ragged(off[:-1], size)


#: A-Z in lower case; ASCII signs other than * @ $ become spaces.
WORD_BYTES = np.arange(256, dtype=np.uint8)
WORD_BYTES[65:91] += 32
WORD_BYTES[[b for b in range(128) if not (48 <= b < 58 or 97 <= b < 123 or 65 <= b < 91 or b in (36, 42, 64))]] = 32
