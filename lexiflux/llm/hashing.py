"""Vectorised 64-bit hashes of words and shingles, the same on every machine."""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xC2B2AE3D27D4EB4F
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WORD_BYTE = np.array([c >= 128 or chr(c).isalnum() or c == 95 for c in range(256)])
#: Bytes of a text that are hashed at once; a longer text is cut between words.
SPAN = 1 << 18
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit; changes a copy."""
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each; those of a span are kept."""
    if len(_powers[0]) < n:
        tables = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            p = np.full(max(n, SPAN + 1), base, np.uint64)
            p[0] = 1
            tables.append(np.cumprod(p))
        if n > SPAN + 1:  # a word longer than a span
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def word_hashes(text: str) -> np.ndarray:
    """One hash for each word of a text, in order: runs of letters, digits and characters beyond ASCII, in lower case."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    np.take(_WORD_BYTE, raw, out=inside[1:-1])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    out = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SPAN, side="right")))
        s, e = starts[first:last] - starts[first], ends[first:last] - starts[first]
        part = raw[starts[first] : ends[last - 1]].astype(np.uint64)
        up, down = _powers_to(len(part) + 1)
        part += np.uint64(1)
        part *= up[: len(part)]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
        out[first:last] = mix64((total[e] - total[s]) * down[s])
        first = last
    return out


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of size words; a shorter text is one run, an empty one none."""
    size = min(size, len(words))
    if not size:
        return words
    h = np.zeros(len(words) - size + 1, np.uint64)
    for j in range(size):
        h = h * np.uint64(_Q) + words[j : len(words) - size + 1 + j]
    return mix64(h)
