"""Word shingles of whole texts as 64-bit hashes, by numpy over the bytes of an Arrow array.

Words are runs of bytes outside [\\x20\\x09-\\x0D], A-Z lower-cased. A word's hash is a polynomial of its bytes modulo
2**64, all words of a slice at once from one running sum, then mixed; a shingle's hash combines those of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from equireach.llm.common import mix64
from equireach.llm.tokens import slices

WIDTH = 5
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_LETTERS = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
#: Slices have half a million bytes; only a single text can be longer.
MOST_POWERS = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; the first MOST_POWERS are kept, those of a longer slice made anew."""
    held = _POWERS.get(base)
    if held is None or len(held) <= n:
        held = np.full(max(n, MOST_POWERS) + 1, base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if n <= MOST_POWERS:
            _POWERS[base] = held
    return held[: n + 1]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, where each text's words begin, the total at the end) of a string array without nulls."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    ends -= ends[0]
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[_LOWER[data]] * _powers(_BASE, len(data))[:-1], out=total[1:])
    hashes = mix64((total[stops] - total[starts]) * _powers(_BACK, len(data))[starts] ^ (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, ends)


def shingle_hashes(hashes: np.ndarray, width: int = WIDTH, salt: int = 0) -> np.ndarray:
    """The hash of the `width` words from each position on; positions too near the end are missing."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for k in range(width):
        out += hashes[k : n + k] * np.uint64((2 * k + 3) * _BASE % (1 << 64) | 1)
    return mix64(out)


def ordered(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, shingle hashes in order) of each text. Fewer words than width, but one: the whole sequence is one shingle."""
    for part in slices(texts):
        found, at = words(part)
        whole = shingle_hashes(found, width)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = found[a:b]
            if b - a >= width:
                yield own, whole[a : b - width + 1]
            else:
                yield own, shingle_hashes(own, b - a, b - a) if b > a else own


def sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    for _, h in ordered(texts, width):
        h = np.sort(h)
        yield h[np.append(True, h[1:] != h[:-1])] if len(h) else h
