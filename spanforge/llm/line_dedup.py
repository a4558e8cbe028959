"""Fuzzy line deduplication over all documents (operator 10).

A node is a distinct line that holds a word, named by a 64-bit hash.  Each has 64 minima
over its shingles of eight characters, in 16 bands of four (a pair at similarity 0.8 is
missed with probability 2e-4, at 0.85 with 8e-6).  Band keys travel to buckets as arrays,
a line's once per slice of texts.  A run of up to ten lines with one key gives its pairs,
which are verified on the exact sets, at 0.8 or more; longer runs are compared in blocks
that give a spanning forest of their links.
Components come from alternating stars, a distributed union-find, and of all lines of a
component the first by (doc_id, line_no) stays.

Defined results: lines without a word are never touched and not reported; a null text has
no lines; a null id comes last in the order; rows with the same id are one document; a line
shorter than a shingle equals only itself; an empty table gives an empty result; further
columns are kept by clean() and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.bytetext import Bytes, Spans, char_shingles, slices, tidy
from spanforge.llm.columns import unused
from spanforge.llm.components import connected_components
from spanforge.llm.minhash import bands, minima
from spanforge.llm.near_dedup import large_links
from spanforge.llm.storage import dropped, written

WIDTH = 8
HASHES, ROWS = 64, 4
PERCENT = 80
SMALL_RUN = 10
BROADCAST_ROWS = 1_000_000
BUCKET_LINES = 60_000
_SLICE = 1 << 17
BLANKS = " \t\n\x0b\x0c\r"


def _solid(b: Bytes) -> Spans:
    """The distinct lines that hold a word, named as Spark's xxhash64 names them."""
    lines = b.lines()
    ink = np.concatenate([[0], np.cumsum(~b.blank())])
    use = np.flatnonzero(ink[lines.end] > ink[lines.start])
    raw = b.raw.tobytes()
    name = np.fromiter((xxhash.xxh64_intdigest(raw[s:e], 42) for s, e in zip(lines.start[use].tolist(), lines.end[use].tolist(), strict=True)), np.uint64, len(use))
    name, pick = np.unique(name.view(np.int64), return_index=True)
    use = use[pick]
    return Spans(lines.start[use], lines.end[use], lines.doc[use], name)


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, content) of every line with a word."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "content"))
    return rows.where(F.btrim("content", F.lit(BLANKS)) != "").withColumn("line", F.xxhash64("content"))


def line_bands(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, keys, lines): the bands of many lines, dealt to buckets of keys as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            key, line = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key)
            key, line = key[order], line[order]
            at = ((key >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
            begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            ends = np.append(begin[1:], len(key))
            held, size = [], 0
            cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(begin, ends, strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(at[begin].astype(np.int64)), cut(key), cut(line)], names=["bucket", "keys", "lines"])

        seen: set[int] = set()  # spares repeated work only
        for part in slices(batches, 0, _SLICE):
            b = Bytes(part.column(0))
            lines = _solid(b)
            names = lines.code.tolist()
            new = np.array([x not in seen for x in names], bool)
            lines = Spans(lines.start[new], lines.end[new], lines.doc[new], lines.code[new])
            seen.update(names)
            if len(seen) > 200_000:
                seen.clear()
            owner, shingle = char_shingles(b, lines, WIDTH)
            keys = bands(minima(owner, shingle, len(lines.code), HASHES), ROWS).view(np.uint64)
            held.append((keys.ravel(), np.repeat(lines.code, keys.shape[1])))
            size += keys.size
            if size >= 1 << 20:
                yield flush()
        if size:
            yield flush()

    return docs.select("text").mapInArrow(tidy(run), "bucket long, keys binary, lines binary")


def candidates(dealt: DataFrame) -> DataFrame:
    """From the lines of equal keys: (False, a, b) for all pairs of at most SMALL_RUN lines,
    (True, key, line) for every line of a longer run.
    """

    def run(t: pa.Table) -> pa.Table:
        key = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("keys")])
        line = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in t.column("lines")])
        order = np.argsort(key)
        key, line = key[order], line[order]
        same = key[1:] == key[:-1]
        shared = np.append(same, False) | np.append(False, same)  # the great part of keys stands alone
        key, line = key[shared], line[shared]
        order = np.lexsort((line, key))
        key, line = key[order], line[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (line[1:] != line[:-1]))[: len(key)]
        key, line = key[fresh], line[fresh]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
        length = np.diff(np.append(begin, len(key)))
        large = np.repeat(length > SMALL_RUN, length)
        one, two = [key[large].view(np.int64)], [line[large]]
        key, line = key[~large], line[~large]
        for shift in range(1, SMALL_RUN):
            i = np.flatnonzero(key[shift:] == key[:-shift]) if shift < len(key) else np.zeros(0, np.int64)
            one.append(np.minimum(line[i], line[i + shift]))
            two.append(np.maximum(line[i], line[i + shift]))
        n = len(one[0])
        return pa.table({"large": pa.array(np.arange(sum(map(len, one))) < n), "a": pa.array(np.concatenate(one)), "b": pa.array(np.concatenate(two))})

    return dealt.groupBy("bucket").applyInArrow(run, "large boolean, a long, b long")


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, content) of the wanted lines."""
    few = wanted.count() <= BROADCAST_ROWS
    return line_rows(docs).join(F.broadcast(wanted) if few else wanted, "line", "left_semi").select("line", "content").dropDuplicates(["line"])


def _sets_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The distinct shingles of each text; a slice of texts at a time, as lines may be long."""
    out = []
    for part in slices([pa.record_batch([column.combine_chunks()], ["content"])], 0, _SLICE):
        b = Bytes(part.column(0))
        owner, code = char_shingles(b, Spans(b.bounds[:-1], b.bounds[1:], np.arange(b.n), np.zeros(b.n, np.uint64)), WIDTH)
        at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b.n))])
        for i in range(b.n):
            own = np.sort(code[at[i] : at[i + 1]])
            out.append(own[np.append(True, own[1:] != own[:-1])[: len(own)]])
    return out


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose exact shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _verified(batches, percent)

    two = pairs.join(texts.select(F.col("line").alias("a"), F.col("content").alias("ta")), "a").join(texts.select(F.col("line").alias("b"), F.col("content").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long")


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Up to 128 pairs (a, b, ta, tb) at once, fewer where their texts are long."""
    for part in slices(slices(batches, 2, _SLICE), 3, _SLICE):
        for at in range(0, part.num_rows, 128):
            yield _verify(part.slice(at, 128), percent)


def _verify(b: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    n = b.num_rows
    sides = []
    for col in (2, 3):
        t = Bytes(b.column(col))
        owner, code = char_shingles(t, Spans(t.bounds[:-1], t.bounds[1:], np.arange(n), np.zeros(n, np.uint64)), WIDTH)
        # One sort does for all pairs of the batch: the pair's number, then 54 bits of the hash.
        side = np.sort((owner.astype(np.uint64) << np.uint64(54)) | (code >> np.uint64(10)))
        sides.append(side[np.append(True, side[1:] != side[:-1])[: len(side)]])
    joint = np.concatenate(sides)
    joint.sort()
    of = (joint >> np.uint64(54)).astype(np.int64)
    both = np.bincount(of[1:][joint[1:] == joint[:-1]], minlength=n)
    total = np.bincount(of, minlength=n) - both
    return b.select([0, 1]).filter(pa.array(100 * both >= percent * total))


def fuzzy_lines(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """doc_id, line_no, first_doc_id, first_line_no, kept: one row per line with a word."""
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    lines = src.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    buckets = max(8, -(-int(lines) // BUCKET_LINES))
    found = written(candidates(line_bands(src, buckets)), "candidates")
    pairs = found.where("NOT large").select("a", "b").distinct()
    ends = F.when(F.col("large"), F.array("b")).otherwise(F.array("a", "b"))
    wanted = written(found.select(F.explode(ends).alias("line")).distinct(), "wanted")
    texts = written(line_texts(src, wanted), "linetexts")
    links = written(verified(pairs, texts, percent), "links")
    members = found.where("large").select(F.col("a").alias("key"), F.col("b").alias("node"))
    if not members.isEmpty():
        # Sizes are written first: small ones are broadcast, and a shuffled join could be split at a crowded key.
        sizes = written(members.groupBy("key").agg(F.count("*").alias("n")), "sizes")
        members = members.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "key")
        crowd = members.select(F.col("node").alias("line")).distinct()
        sets = texts.join(crowd, "line", "left_semi").select(F.col("line").alias("node"), F.col("content").alias("codes"))
        links = large_links(members, sets, links, percent, _sets_of, lambda two: verified(two, texts, percent))
    comp = connected_components(links)
    rows = written(line_rows(src).select("doc_id", "line_no", "line"), "lines")
    few = comp.count() <= BROADCAST_ROWS
    comp = comp.select(F.col("node").alias("line"), F.col("component").alias("grp"))
    grouped = rows.join(F.broadcast(comp) if few else comp, "line", "left").select("doc_id", "line_no", F.coalesce("grp", "line").alias("grp"))
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), F.col("line_no").alias("l"))
    first = grouped.groupBy("grp").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("grp", "first")
    first = written(first, "firsts")
    dropped(found, wanted, texts, links)
    few = first.count() <= BROADCAST_ROWS
    out = grouped.join(F.broadcast(first) if few else first, "grp", "left").withColumn("first", F.coalesce("first", place))
    kept = (F.col("first.d") == place["d"]) & (F.col("first.l") == F.col("line_no"))
    return out.select("doc_id", "line_no", F.nullif("first.d", F.lit(2**63 - 1)).alias("first_doc_id"), F.col("first.l").alias("first_line_no"), kept.alias("kept"))


def clean(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """The documents without their dropped lines; one that loses its last word goes.

    text is rebuilt and, where it exists, n_chars counted anew; other columns stay as they are, whatever their names.
    """
    lines = written(fuzzy_lines(docs, percent=percent).where("NOT kept AND doc_id IS NOT NULL").select("doc_id", "line_no").distinct(), "dropped")
    own, gone, new = (unused(x, docs.columns) for x in ("own_id", "gone_lines", "new_text"))
    per_doc = lines.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("line_no").alias(gone))
    few = lines.count() <= BROADCAST_ROWS
    both = docs.join(F.broadcast(per_doc) if few else per_doc, docs["doc_id"] == F.col(own), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i))
    out = both.withColumn(new, F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept)))
    out = out.where(F.col(gone).isNull() | (F.btrim(new, F.lit(BLANKS)) != ""))
    cols = []
    for c in docs.columns:
        changed = F.col(new) if c == "text" else F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.length(new)) if c == "n_chars" else F.col(f"`{c}`")
        cols.append(changed.cast(docs.schema[c].dataType).alias(c))
    return out.select(*cols)
