"""Content-defined blocks: where a passage stands does not change how it is cut.

Every window of W units (words or bytes) picks one anchor inside it: the k-gram with the smallest fingerprint, the
leftmost on ties. Equal windows pick the same anchor at the same place, so only windows of the same anchor need
comparing. Neighbouring windows with the same anchor make one block.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.common import U64, signed, sliding_min, span, sums

#: Longer texts are cut in overlapping pieces, so that memory stays bounded and a position fits in 20 bits.
PIECE = 1 << 20
_LOW = U64(PIECE - 1)


def pieces(n: int, window: int):
    """(from, to) of pieces that overlap by a window less one: each window lies in just one."""
    start = 0
    while n - start >= window:
        yield start, min(n, start + PIECE)
        start += PIECE - window + 1


def blocks(v: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """First and last window, anchor position, anchor fingerprint and block fingerprint of each block of ``v``."""
    n, c = len(v), sums(v)
    at = np.arange(n - k + 1)
    g = span(c, at, at + k)
    least = sliding_min((g & ~_LOW) | at.astype(U64), window - k + 1)
    a = (least & _LOW).astype(np.int64)
    cut = np.flatnonzero(a[1:] != a[:-1]) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut - 1, [n - window]])
    a = a[first]
    block = span(c, first, last + window) ^ (((a - first).astype(U64) << U64(32)) + (last - first).astype(U64))
    return first, last, a, g[a], block


def rows(v: np.ndarray, window: int, k: int) -> dict[str, np.ndarray] | None:
    """The blocks of a whole text as columns; None if it is shorter than a window."""
    found = []
    for lo, hi in pieces(len(v), window):
        first, last, a, anchor, block = blocks(v[lo:hi], window, k)
        found.append((signed(anchor), signed(block), first + lo, last - first + 1, a - first))
    if not found:
        return None
    return dict(zip(("anchor", "block", "start", "n", "rel"), (np.concatenate(x) for x in zip(*found)), strict=True))


def covered(n: int, starts, lengths) -> np.ndarray:
    """Which of n units lie in any of the spans."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, np.minimum(starts, n), 1)
    np.add.at(d, np.minimum(np.asarray(starts) + np.asarray(lengths), n), -1)
    return np.cumsum(d[:-1]) > 0
