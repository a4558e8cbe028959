"""Signatures of minima under universal hash functions, and their bands."""

from __future__ import annotations

import numpy as np

from spanforge.llm.bytetext import mix

_PIECE = 1 << 17
_rng = np.random.Generator(np.random.PCG64(7919))
_A = _rng.integers(0, 2**31, 1024, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, 1024, dtype=np.uint32)


def minima(doc: np.ndarray, code: np.ndarray, n: int, hashes: int) -> np.ndarray:
    """(n, hashes) minima of a * x + b mod 2**32; texts without codes get the largest value.

    doc must be sorted.
    """
    out = np.full((n, hashes), 0xFFFFFFFF, np.uint32)
    if not len(doc):
        return out
    x = (code >> np.uint64(32)).astype(np.uint32)
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    rows = doc[begin]
    stop = np.append(begin[1:], len(x))
    at = 0
    while at < len(begin):  # in pieces that stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(stop, begin[at] + _PIECE, "right")))
        part, inner = x[begin[at] : stop[to - 1]], begin[at:to] - begin[at]
        buf = np.empty_like(part)
        got = np.empty((hashes, to - at), np.uint32)
        for k in range(hashes):
            np.multiply(part, _A[k], out=buf)
            buf += _B[k]
            np.minimum.reduceat(buf, inner, out=got[k])
        out[rows[at:to]] = got.T
        at = to
    return out


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """(n, hashes / rows) signed 64-bit keys; the number of the band is part of the key."""
    n, hashes = sig.shape
    per = sig.reshape(n, hashes // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, hashes // rows + 1, dtype=np.uint64) << np.uint64(40), per.shape[:2]).copy()
    for k in range(rows):
        key = mix(key + per[:, :, k])
    return key.view(np.int64)
