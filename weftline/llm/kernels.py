"""Vectorised text kernels shared by the free-style operators.

All of them work on whole texts.  A batch is cut into runs of whole texts of
about ``CHUNK`` bytes, so memory follows the largest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CHUNK = 1 << 20
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = np.array(x, dtype=_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random value for each byte, and an odd base with its inverse modulo 2**64.
_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK + 4096), base, dtype=_U)
        out[0] = 1
        out = np.cumprod(out, dtype=_U)
        if n <= 4 * CHUNK:  # one giant text must not leave a giant table behind
            _powers[base] = out
        return out[:n]
    return have[:n]


def runs_of_texts(sizes: Sequence[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``limit`` bytes each; a longer text stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def spaced_words(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text.

    Returns the joined bytes, start and end of each word in them, a 64-bit hash
    of each word, and for text i the range first[i]..first[i + 1] of its words.
    """
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    total = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), dtype=_U, out=total[1:])
    value = (total[ends] - total[starts]) * powers(_INVERSE, len(data))[starts]
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    return data, starts, ends, mix64(value ^ (ends - starts).astype(_U)), first


def shingle_sets(texts: Sequence[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``width``-word shingles.

    A text of fewer words has one shingle, the whole sequence; one without words has none.
    """
    for a, b in runs_of_texts([len(t) for t in texts]):
        _, _, _, words, first = spaced_words(texts[a:b])
        n = max(0, len(words) - width + 1)
        grams = np.full(n, width, dtype=_U)
        for k in range(width):
            grams = grams * _U(_BASE) + words[k : k + n]
        grams = mix64(grams)
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= width:
                yield np.unique(grams[lo : hi - width + 1])
            elif hi > lo:
                short = np.full(1, hi - lo, dtype=_U)
                for k in range(lo, hi):
                    short = short * _U(_BASE) + words[k : k + 1]
                yield mix64(short)
            else:
                yield np.empty(0, dtype=_U)
