"""Golomb-Rice code of sorted whole numbers, in numpy."""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray) -> tuple[int, bytes]:
    """(k, code) of ascending uint64 ``values``: of each gap the low k bits, the rest in unary.

    The unary part comes first, then the k-bit remainders; each is padded to whole bytes.
    """
    n = len(values)
    if n == 0:
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, 0.69 * float(values[-1]) / n))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.ones(int(ends[-1]), np.uint8)
    unary[ends - 1] = 0
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    low = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def decode(n: int, k: int, code: bytes) -> np.ndarray:
    """The ``n`` values that ``encode`` got."""
    if n == 0:
        return np.zeros(0, np.uint64)
    tail = (n * k + 7) // 8
    unary = np.unpackbits(np.frombuffer(code, np.uint8, len(code) - tail))
    ends = np.flatnonzero(unary == 0)[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        low = np.unpackbits(np.frombuffer(code, np.uint8, tail, len(code) - tail))[: n * k].reshape(n, k)
        for j in range(k):
            gaps |= low[:, j].astype(np.uint64) << np.uint64(k - 1 - j)
    return np.cumsum(gaps, dtype=np.uint64)
