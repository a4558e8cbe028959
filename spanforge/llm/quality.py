"""Document quality: base rules and a calibrated n-gram classifier (operator 4).

The classifier is a logistic regression over hashed n-grams (words: 1 and 2; characters: 3
and 5), each kind averaged over the text, fitted on at most ``TRAIN_ROWS`` labelled rows of
at most ``TRAIN_BYTES`` each, chosen by a hash of their id.  Decision values are turned into
probabilities by Platt's method on every fifth row, which the weights have not seen.  All
texts are then scored whole, in Arrow batches, with fixed weights and a fixed threshold.

Defined results: a null or blank text has 0 words and fails the base rules; without
labelled rows of both classes the classifier accepts everything; repeated rows are judged
each on their own; columns beside id and text are ignored unless kept, and a kept one with the
name of a result column gets an underscore; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm.bytetext import Bytes, Spans, give_back, slices, tidy, windows
from spanforge.llm.columns import beside, unused

TRAIN_ROWS = 3000
TRAIN_BYTES = 20_000
THRESHOLD = 0.25
BITS = 17
CHARS = (3, 5)
MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _twins(doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that equal the next and the one before, in an order by text and code."""
    order = np.lexsort((code, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (code[order][1:] == code[order][:-1])
    return order[:-1][same], order[1:][same]


def base_counts(b: Bytes, words: Spans) -> dict[str, np.ndarray]:
    """The counts of the base rules, per text."""
    n = b.n
    inner = ~b.blank() & ((b.raw & 0xC0) != 0x80)
    upto = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[b.bounds])
    lines = b.lines()
    solid = np.concatenate([[0], np.cumsum(~b.blank())])
    used = solid[lines.end] > solid[lines.start]
    doc, code = lines.doc[used], lines.code[used]
    dup_lines = doc[_twins(doc, code)[1]]
    first, code = windows(words)
    wdoc = words.doc[first]
    twice = np.zeros(len(first), bool)
    for side in _twins(wdoc, code):
        twice[side] = True
    step = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(step, first[twice], 1)
    np.add.at(step, first[twice] + 5, -1)
    covered = np.cumsum(step)[:-1] > 0
    return {
        "n_words": words.per_doc(n),
        "word_chars": upto(inner),
        "n_symbols": upto(_SYMBOL[b.raw]),
        "n_dup_lines": np.bincount(dup_lines, minlength=n),
        "n_repeat_words": np.bincount(words.doc[covered], minlength=n),
    }


def features(b: Bytes, words: Spans) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every n-gram, one pair of arrays a kind; kinds use tables of their own."""
    shift = np.uint64(64 - BITS)
    yield words.doc, (words.code >> shift).astype(np.int64)
    first, code = windows(words, 2)
    yield words.doc[first], (code >> shift).astype(np.int64)
    # Characters: the bytes of UTF-8 from one first byte to the next, folded into one number each.
    raw = b.raw
    head = np.flatnonzero((raw & 0xC0) != 0x80)
    char = raw[head].astype(np.uint32)
    length = np.diff(np.append(head, len(raw)))
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        if not len(more):
            break
        char[more] = char[more] * np.uint32(0x101) + raw[head[more] + k]
    owner = b.doc_of(head) if len(head) < len(raw) else np.repeat(np.arange(b.n), np.diff(b.bounds))
    for k in CHARS:
        if len(char) < k:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        h = np.zeros(len(char) - k + 1, np.uint32)
        for j in range(k):
            h = h * np.uint32(0x01000193) + char[j : len(char) - k + 1 + j]
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        whole = owner[k - 1 :] == owner[: len(h)]
        yield owner[: len(h)][whole], h[whole].astype(np.int64)


def decision(b: Bytes, words: Spans, weights: np.ndarray, bias: float) -> np.ndarray:
    """Sum over the kinds of the mean weight of a text's n-grams."""
    out = np.full(b.n, bias)
    for kind, (doc, bucket) in enumerate(features(b, words)):
        total = np.bincount(doc, weights[kind][bucket], minlength=b.n)
        out += total / np.maximum(np.bincount(doc, minlength=b.n), 1)
    return out


class Entries:
    """(row, bucket, value) of the sample, kept in fixed blocks: no list is ever joined."""

    BLOCK = 1 << 19
    KINDS = (np.int32, np.int32, np.float32)

    def __init__(self):
        self.blocks: list[tuple[np.ndarray, ...]] = []
        self.used = self.BLOCK

    def add(self, part: tuple[np.ndarray, ...]) -> None:
        at, n = 0, len(part[0])
        while at < n:
            if self.used == self.BLOCK:
                self.blocks.append(tuple(np.empty(self.BLOCK, t) for t in self.KINDS))
                self.used = 0
            m = min(n - at, self.BLOCK - self.used)
            for to, x in zip(self.blocks[-1], part, strict=True):
                to[self.used : self.used + m] = x[at : at + m]
            self.used, at = self.used + m, at + m

    def __iter__(self) -> Iterator[tuple[np.ndarray, ...]]:
        for k, block in enumerate(self.blocks):
            end = self.used if k + 1 == len(self.blocks) else self.BLOCK
            yield tuple(x[:end] for x in block)

    def products(self, w: np.ndarray, n: int) -> np.ndarray:
        """The sum of weight times value, per row."""
        z = np.zeros(n)
        for r, c, v in self:
            z += np.bincount(r, w[c] * v, minlength=n)
        return z


def fit(texts: list[str], good: list[int], epochs: int = 60, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias and the calibration's slope and offset."""
    y = np.asarray(good, float)
    n = len(y)
    weights = np.zeros((4, 1 << BITS))
    if n < 10 or y.min() == y.max():
        return weights.astype(np.float32), 0.0, 0.0, 10.0
    held = np.arange(n) % 5 == 4
    seen, hidden = Entries(), Entries()
    for at in range(0, n, 8):
        b = Bytes(pa.array(texts[at : at + 8], pa.string()))
        for kind, (doc, bucket) in enumerate(features(b, b.words())):
            key, count = np.unique((doc << BITS) | bucket, return_counts=True)
            d = key >> BITS
            part = d + at, (key & ((1 << BITS) - 1)) + (kind << BITS), count / np.bincount(doc, minlength=b.n)[d]
            out = held[part[0]]
            hidden.add(tuple(x[out] for x in part))
            seen.add(tuple(x[~out] for x in part))
    # Each bucket's step is scaled by its weight in the sample, as rare n-grams have tiny means.
    scale = np.full(weights.size, 1e-3)
    for _, c, v in seen:
        scale += np.bincount(c, v * v, minlength=weights.size)
    scale = np.minimum(1.0, np.sqrt(scale))
    w, bias = weights.ravel(), 0.0
    share = np.where(y > 0, 0.5 / max(y[~held].sum(), 1), 0.5 / max((1 - y[~held]).sum(), 1)) * ~held
    grad2 = np.full(w.size, 1e-8)
    for _ in range(epochs):
        z = seen.products(w, n) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        g = decay * w
        for r, c, v in seen:
            g += np.bincount(c, err[r] * v, minlength=w.size)
        grad2 += g * g
        w -= rate * g / np.sqrt(grad2) * scale
        bias -= rate * err.sum()
    z = hidden.products(w, n) + bias
    slope, offset = _platt(z[held], y[held])
    return w.reshape(weights.shape).astype(np.float32), float(bias), slope, offset


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps on the smoothed targets of Platt's method."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, s = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * z * z).sum() + 1e-6, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        da, db = np.linalg.solve(h, [(d * z).sum() + 1e-6 * a, d.sum()])
        a, b = a - np.clip(da, -5, 5), b - np.clip(db, -5, 5)
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> tuple:
    """The bounded sample goes to the driver: at most rows * most_bytes."""
    lab = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__good")).where("__id IS NOT NULL AND __good IS NOT NULL")
    lab = lab.groupBy("__id").agg(F.max("__good").alias("__good"))
    order = F.xxhash64("__id")
    picked = lab.orderBy(order, "__id").limit(rows)
    d = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).where(F.octet_length("__text") <= most_bytes)
    got = d.join(F.broadcast(picked), "__id").orderBy(order, "__id", "__text").limit(rows).collect()
    texts, good = [x["__text"] for x in got], [int(x["__good"] > 0) for x in got]
    del got
    model = fit(texts, good)
    del texts
    give_back()
    return model


def score(docs: DataFrame, model: tuple, *, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Base counts, base_failed, probability and kept beside the kept columns; no shuffle.

    A kept column that has the name of a result column goes by that name and an underscore.
    """
    spark = docs.sparkSession
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    names = beside(keep, (*longs, "probability", "base_failed", "kept"))
    text = unused("text", names.values())
    src = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("text").cast("string").alias(text))
    schema = T.StructType([src.schema[n] for n in names.values()] + [T.StructField(c, T.LongType()) for c in longs] + [T.StructField("probability", T.DoubleType())])
    sent = spark.sparkContext.broadcast(model)  # four tables of 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, slope, offset = sent.value
        for part in slices(batches, len(names)):
            b = Bytes(part.column(len(names)))
            words = b.words()
            counts = base_counts(b, words)
            p = 1 / (1 + np.exp(-np.clip(slope * decision(b, words, weights, bias) + offset, -30, 30)))
            cols = [*part.columns[:-1], *(pa.array(counts[c].astype(np.int64)) for c in longs), pa.array(p)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names.values(), *longs, "probability"])

    out = src.mapInArrow(tidy(run), schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= threshold))


def clean(docs: DataFrame, model: tuple, *, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with all their columns."""
    names = beside(docs.columns, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "probability", "base_failed", "kept"))
    return score(docs, model, threshold=threshold, keep=tuple(docs.columns)).where("kept").select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])
