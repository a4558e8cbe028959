"""Words, lines and shingles of many texts at once, as 64-bit hashes over Arrow's own bytes.

White space is the six ASCII characters space and 0x09-0x0D; a word is a longest run of
anything else.  Nothing here loops over words: a prefix sum of ``table[byte] * p**i`` modulo
2**64 gives the hash of any span in constant time.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_power: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def tidy(run: Callable) -> Callable:
    """A batch function that gives a task's memory back when it ends, as workers live on."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Returns freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _power[name] = np.multiply.accumulate(x)
    return _power["up"], _power["down"]


@dataclass
class Spans:
    """start, end: byte positions; doc: index of the text; code: 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    code: np.ndarray

    def per_doc(self, n: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=n)


class Bytes:
    """The bytes of a slice of texts laid end to end; bounds[k]:bounds[k + 1] is text k."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
        _, offsets, data = texts.buffers()
        n = len(texts)
        at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and n else np.zeros(0, np.uint8)
        self.n, self.bounds = n, at - at[0]
        self.raw = raw
        self.data = _LOWER[raw] if lower else raw
        self._sum: np.ndarray | None = None
        self._first = np.zeros(len(raw), bool)
        begins = self.bounds[:-1][self.bounds[1:] > self.bounds[:-1]]
        self._first[begins] = True

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, "right") - 1

    def codes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = _powers(len(self.data) + 1)
        if self._sum is None:
            self._sum = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_TABLE[self.data] * up[: len(self.data)], out=self._sum[1:])
        return mix((self._sum[end] - self._sum[start]) * down[start] + (end - start).astype(np.uint64))

    def _spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest runs of marked bytes; a run ends with its text."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | self._first[1:]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | self._first[1:]
        return np.flatnonzero(begin), np.flatnonzero(stop) + 1

    def words(self) -> Spans:
        start, end = self._spans(~_BLANK[self.raw])
        return Spans(start, end, self.doc_of(start), self.codes(start, end))

    def lines(self) -> Spans:
        """Lines between newlines, empty ones too; an empty text has one empty line."""
        cut = np.flatnonzero(self.raw == 10)
        start = np.concatenate([self.bounds[:-1], cut + 1])
        doc = np.concatenate([np.arange(self.n), self.doc_of(cut)])
        order = np.lexsort((start, doc))
        start, doc = start[order], doc[order]
        end = np.empty(len(start), np.int64)
        same = np.append(doc[1:] == doc[:-1], False)
        end[:-1] = np.where(same[:-1], start[1:] - 1, self.bounds[doc[:-1] + 1]) if len(start) else 0
        if len(start):
            end[-1] = self.bounds[doc[-1] + 1]
        return Spans(start, end, doc, self.codes(start, end))

    def blank(self) -> np.ndarray:
        return _BLANK[self.raw]


def slices(batches: Iterator[pa.RecordBatch], col: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about so many bytes of text (a longer text comes alone)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < b.num_rows:
            base = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, base + limit, "right")))
            yield b.slice(begin, end - begin)
            begin = end


def windows(words: Spans, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of all runs of so many words inside one text."""
    n = len(words.code)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(words.doc[width - 1 :] == words.doc[: n - width + 1])
    code = np.zeros(len(first), np.uint64)
    for k in range(width):
        code = code * np.uint64(0xD6E8FEB86659FD93) + words.code[first + k]
    return first, mix(code)


def by_text(doc: np.ndarray, code: np.ndarray) -> np.ndarray:
    """An order by text, then code: a fast sort of the codes, then a radix sort of small numbers."""
    if not len(doc) or doc.max() >= 1 << 16:
        return np.lexsort((code, doc))
    order = np.argsort(code)
    return order[np.argsort(doc[order].astype(np.uint16), kind="stable")]


def shingles(words: Spans, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, sorted by both; a shorter text is one shingle."""
    first, code = windows(words, width)
    doc = words.doc[first]
    short = np.flatnonzero(np.isin(np.arange(n_docs), words.doc) & (words.per_doc(n_docs) < width))
    if len(short):
        per = words.per_doc(n_docs)
        begin = np.cumsum(per) - per
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = per[short] > k
            extra[has] = extra[has] * np.uint64(0xD6E8FEB86659FD93) + words.code[begin[short[has]] + k]
        doc, code = np.concatenate([doc, short]), np.concatenate([code, mix(extra + per[short].astype(np.uint64))])
    order = by_text(doc, code)
    doc, code = doc[order], code[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    return doc[keep], code[keep]


def char_shingles(b: Bytes, lines: Spans, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of all runs of so many characters; a shorter line is one shingle."""
    at = np.flatnonzero((b.raw & 0xC0) != 0x80)
    lo, hi = np.searchsorted(at, lines.start), np.searchsorted(at, lines.end)
    at = np.append(at, len(b.raw))
    count = np.where(hi > lo, np.maximum(hi - lo - width + 1, 1), 0)
    owner = np.repeat(np.arange(len(lo)), count)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + lo[owner]
    last = np.minimum(first + width, hi[owner])
    # The line's own end, as the next character may begin behind a newline.
    end = np.where(last == hi[owner], lines.end[owner], at[last])
    return owner, b.codes(at[first], end)
