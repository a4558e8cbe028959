"""Benchmark decontamination by size-partitioned containment search (operator 7).

Items and documents are sets of shingles of five lower-cased words.  A document leaks an
item if it contains at least 80 of 100 of the item's distinct shingles.  Items are
partitioned by size class (powers of two); a class has a MinHash sketch of the m smallest
values under a random permutation, with m one more than the shingles that the largest item
of the class may lack.  So at least one value of the sketch is in any leaking document: the
search misses nothing.  Sketching the long side as well would lose short items (30
shingles in 20,000 give a similarity of 0.0015), so documents are probed with all their
shingles.  Candidates are verified by exact containment in the same task; nothing is
shuffled then, and a passage that very many documents share is no group at all.

Items of at most ``BLOCK_BYTES`` of text in all travel to the executors at once, and documents
are read once without a shuffle.  A larger benchmark is sketched where it lies: documents are
again read once, their shingles meet the sketches in a shuffle, and candidates are verified by
the same exact containment.

Defined results: a null or blank text or item has no shingles and matches nothing; an item
of fewer than five words is its whole word sequence and matches a text that is the same;
repeated rows give repeated pairs; null ids are reported as null; an empty table gives no
pairs; further columns are kept by clean() and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.bytetext import Bytes, mix, shingles, slices, tidy
from spanforge.llm.columns import unused
from spanforge.llm.storage import written

PERCENT = 80
BLOCK_BYTES = 16 << 20
_SEED = np.uint64(0x5851F42D4C957F2D)


def sketch(own: np.ndarray, percent: int) -> np.ndarray:
    """The smallest values of an item under the permutation, as many as its size class asks for."""
    upper = (1 << len(own).bit_length()) - 1  # the largest size of its class
    return own[np.argsort(mix(own ^ _SEED))[: upper * (100 - percent) // 100 + 1]]


class ItemIndex:
    """Sketches and sets of all items."""

    def __init__(self, ids: list, texts: list, percent: int):
        b = Bytes(pa.array(texts, pa.string()), lower=True)
        doc, code = shingles(b.words(), b.n)
        self.ids, self.percent = ids, percent
        size = np.bincount(doc, minlength=b.n)
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.code = code
        full = np.flatnonzero(size)
        probes = [sketch(code[self.at[i] : self.at[i + 1]], percent) for i in full]
        probe = np.concatenate([np.zeros(0, np.uint64), *probes])
        owner = np.repeat(full, [len(x) for x in probes])
        order = np.argsort(probe, kind="stable")
        self.probe, self.owner = probe[order], owner[order]
        self.mark = np.zeros(1 << 20, bool)
        self.mark[(self.probe >> np.uint64(44)).astype(np.int64)] = True

    def search(self, doc: np.ndarray, code: np.ndarray, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, size of the item, shared shingles) of the leaks; doc, code as of shingles()."""
        hit = np.flatnonzero(self.mark[(code >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(self.probe, code[hit], "left"), np.searchsorted(self.probe, code[hit], "right")
        many = hi - lo
        of = np.repeat(doc[hit], many)
        entry = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        found = np.unique(of * len(self.ids) + self.owner[entry]) if len(of) else of
        bound = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
        for key in found.tolist():
            d, i = divmod(key, len(self.ids))
            item = self.code[self.at[i] : self.at[i + 1]]
            own = code[bound[d] : bound[d + 1]]
            place = np.minimum(np.searchsorted(own, item), len(own) - 1)
            shared = int((own[place] == item).sum())
            if 100 * shared >= self.percent * len(item):
                yield d, i, len(item), shared


def _index(benchmark: DataFrame, percent: int, block_bytes: int) -> ItemIndex | None:
    """The index of a benchmark within the bound; null for a larger one."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        return None
    rows = items.collect()
    return ItemIndex([r[0] for r in rows], [r[1] for r in rows], percent)


def shuffled_leaks(docs: DataFrame, benchmark: DataFrame, percent: int) -> DataFrame:
    """(row, item_id, n_item, n_shared) against a benchmark of any size.  docs: (row, text), a row for each text."""

    def run(batches: Iterator[pa.RecordBatch], sketched: bool) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            b = Bytes(part.column(1), lower=True)
            doc, code = shingles(b.words(), b.n)
            at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.n))])
            sets = [code[at[i] : at[i + 1]] for i in range(b.n)]
            cols = [[x.view(np.int64) for x in sets]] + [[sketch(x, percent).view(np.int64) if len(x) else x.view(np.int64) for x in sets]] * sketched
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.list_(pa.int64())) for c in cols)], names=["id", "codes", "probe"][: 2 + sketched])

    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(lambda x: run(x, True)), "id long, codes array<long>, probe array<long>")
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "items")
    sets = written(docs.select(F.col("row").alias("id"), "text").mapInArrow(tidy(lambda x: run(x, False)), "id long, codes array<long>"), "sets")
    probes = items.select("item", F.explode("probe").alias("code"))
    found = sets.select("id", F.explode("codes").alias("code")).join(probes, "code").select(F.col("id").alias("row"), "item").distinct()
    both = found.join(sets.select(F.col("id").alias("row"), F.col("codes").alias("own")), "row").join(items.select("item", F.col("id").alias("item_id"), "codes"), "item")
    both = both.select("row", "item_id", F.size("codes").cast("long").alias("n_item"), F.size(F.array_intersect("own", "codes")).cast("long").alias("n_shared"))
    return written(both.where(100 * F.col("n_shared") >= percent * F.col("n_item")), "leaks")


def _row(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_item, n_shared: one row per leaking pair."""
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    index = _index(benchmark, percent, block_bytes)
    if index is None:
        keyed = src.withColumn("row", _row(src))
        leaks = shuffled_leaks(keyed.select("row", "text").where("text IS NOT NULL").dropDuplicates(["row"]), benchmark, percent)
        return keyed.select("row", "doc_id").join(leaks, "row").drop("row")
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for part in slices(batches, 1):
            b = Bytes(part.column(1), lower=True)
            doc, code = shingles(b.words(), b.n)
            got = list(index.search(doc, code, b.n))
            cols = [part.column(0).take(pa.array([x[0] for x in got], pa.int64())), pa.array([index.ids[x[1]] for x in got], pa.int64()), *(pa.array([x[k] for x in got], pa.int64()) for k in (2, 3))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "n_item", "n_shared"])

    return src.mapInArrow(tidy(run), "doc_id long, item_id long, n_item long, n_shared long")


def clean(docs: DataFrame, benchmark: DataFrame, *, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that leak no item, with all their columns; a filter without shuffle for a benchmark within the bound."""
    index = _index(benchmark, percent, block_bytes)
    if index is None:
        row = unused("row", docs.columns)
        keyed = docs.withColumn(row, _row(docs))
        leaks = shuffled_leaks(keyed.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").dropDuplicates(["row"]), benchmark, percent)
        return keyed.join(leaks.select(F.col("row").alias(row)).distinct(), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    sent = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for part in slices(batches, at):
            b = Bytes(part.column(at), lower=True)
            doc, code = shingles(b.words(), b.n)
            keep = np.ones(part.num_rows, bool)
            keep[[x[0] for x in index.search(doc, code, b.n)]] = False
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)
