"""Cost-balanced packing of tokenised documents (operator 1).

A piece of n tokens costs ``linear * n + quadratic * n**2`` (feed-forward plus attention
inside the document).  Pieces are taken in descending cost and each goes to the sequence of
lowest cost that still has room for it; a document is cut at ``capacity`` first, and again
only when no open sequence holds it whole.

Sequences are formed inside a task from groups of about ``group_tokens`` tokens, so there
is no shuffle, a hot source is spread like any other rows, and memory is bounded by one
group plus one document.  Groups before the last use full sequences only and hand the rest
on, so a partition pads fewer than ``capacity`` tokens in all.

Defined results: a null or empty text is the closing id alone; repeated rows are packed
each on their own; ties are taken in arrival order; an empty table packs nothing; columns
beside id and text are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm.bytetext import tidy

CAPACITY = 2048
CLOSING_ID = 1
GROUP_TOKENS = 2_000_000
SLICE_CHARS = 1 << 20


class ByteBpe:
    """Ids of a byte-level BPE tokenizer file, encoded by the faster of the installed libraries.

    The vocabulary comes from the tokenizer's own JSON file; the tests hold the ids against
    the library that defines the format.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
        byte = {c: b for b, c in shown.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.enc = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= SLICE_CHARS:
            return self.enc.encode_to_numpy(text, allowed_special="all")
        parts, begin = [], 0
        while begin < len(text):
            end = begin + SLICE_CHARS
            # The pre-tokenizer always cuts before a lone space between two other characters.
            while 0 < (end := text.find(" ", end)) < len(text) - 1 and (text[end - 1].isspace() or text[end + 1].isspace()):
                end += 1
            end = end if 0 < end < len(text) - 1 else len(text)
            parts.append(self.enc.encode_to_numpy(text[begin:end], allowed_special="all"))
            begin = end
        return np.concatenate(parts)


_LOADED: dict[str, ByteBpe] = {}


def assign(lengths: list[int], n_bins: int, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """(item, start in item, length, bin) of every piece; lengths are at most capacity each.

    The bins must hold all items together.
    """
    cost, room = np.zeros(n_bins), np.full(n_bins, capacity, np.int64)
    left = [(-n, i, 0) for i, n in enumerate(lengths)]
    heapq.heapify(left)
    out = []
    while left:
        n, i, start = heapq.heappop(left)
        n = -n
        fits = room >= n
        if fits.any():
            at, put = int(np.where(fits, cost, np.inf).argmin()), n
        else:
            most = int(room.max())
            at, put = int(np.where(room == most, cost, np.inf).argmin()), most
            heapq.heappush(left, (put - n, i, start + put))
        cost[at] += linear * put + quadratic * put * put
        room[at] -= put
        out.append((i, start, put, at))
    return out


def pack(df: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, closing_id: int = CLOSING_ID, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, cost and ids.

    ``ids`` is binary, little-endian unsigned 32-bit.  A sequence_id holds the partition in
    its upper bits, so that a retried task names its sequences as before.
    """
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType
    longs = ("start", "length", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(c, T.LongType()) for c in longs] + [T.StructField("cost", T.DoubleType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe = _LOADED.get(tokenizer_file) or _LOADED.setdefault(tokenizer_file, ByteBpe(tokenizer_file))
        ctx = TaskContext.get()
        base = (ctx.partitionId() if ctx else 0) << 36
        used = 0
        held: list[tuple] = []  # (document, start, ids, document's tokens), pieces shorter than capacity
        held_tokens = 0
        arrow_type = None

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, total, seq, offset = zip(*rows, strict=True)
            n = [len(x) for x in ids]
            cost = [linear * x + quadratic * x * x for x in n]
            cols = [pa.array(doc, arrow_type), *(pa.array(x, pa.int64()) for x in (start, n, total, seq, offset)), pa.array(cost, pa.float64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", *longs, "cost", "ids"])

        def close(last: bool) -> list[tuple]:
            nonlocal used, held, held_tokens
            bins = -(-held_tokens // capacity) if last else held_tokens // capacity
            if not bins:
                return []
            over = [] if last else held_tokens - bins * capacity
            keep: list[tuple] = []
            if over:  # the latest pieces wait for the next group
                while over:
                    doc, start, ids, total = held.pop()
                    if len(ids) > over:
                        cut = len(ids) - over
                        held.append((doc, start, ids[:cut], total))
                        doc, start, ids = doc, start + cut, ids[cut:]
                    keep.append((doc, start, ids, total))
                    over -= len(ids)
            rows, filled = [], [0] * bins
            for i, at, n, b in assign([len(p[2]) for p in held], bins, capacity, linear, quadratic):
                doc, start, ids, total = held[i]
                rows.append((doc, start + at, ids[at : at + n], total, base + used + b, filled[b]))
                filled[b] += n
            used += bins
            held, held_tokens = keep[::-1], sum(len(p[2]) for p in keep)
            return rows

        for batch in batches:
            arrow_type = batch.column(0).type
            rows: list[tuple] = []
            rows_tokens = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(bpe.ids(text or "").astype("<u4"), np.uint32(closing_id))
                whole = len(ids) - len(ids) % capacity
                for start in range(0, whole, capacity):
                    rows.append((doc, start, ids[start : start + capacity], len(ids), base + used, 0))
                    used += 1
                if whole < len(ids):
                    held.append((doc, whole, ids[whole:], len(ids)))
                    held_tokens += len(ids) - whole
                rows_tokens += len(ids)
                if held_tokens >= group_tokens:
                    rows += close(last=False)
                if rows_tokens >= group_tokens:
                    if rows:
                        yield emit(rows)
                    rows, rows_tokens = [], 0
            if rows:
                yield emit(rows)
        if rows := close(last=True):
            yield emit(rows)

    return src.mapInArrow(tidy(run), schema)


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns: the ids give way to their CRC."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost")
