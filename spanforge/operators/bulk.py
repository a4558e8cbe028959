"""Layout and content rules over whole documents, a batch of them at a time: what layout and
matching say page by page as expressions, here as array operations over all spans of a batch.

Input: rows in which those of a document follow each other within one partition, and a function
that reads spans from an Arrow table of them (arrays(), or one of a source); a page may be spread over
several rows. A document is held whole, so a task's memory grows with its largest document."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge import schema as S

#: Row in the table, page, y, x, text and span_seq of each span.
Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]
_NONE = np.iinfo(np.int64).max
_RULE = "^ *-{4,} *$"
_DATE = r"^(?:[0-9]{2,4}[/-][0-9]{1,2}[/-][0-9]{1,2}|20[0-9]{6})$"
_PLAIN = r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"
#: What else Spark's cast takes for a number: exponents, suffixes, hexadecimals, names, blanks around.
_LOOSE = r"(?i)^[\x00-\x20]*[+-]?(?:nan|inf(?:inity)?|0x[0-9a-f]*\.?[0-9a-f]*p[+-]?[0-9]+[fd]?|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?[fd]?)[\x00-\x20]*$"
_NUMBER_STARTS = np.zeros(256, bool)
_NUMBER_STARTS[[*range(33), *b"0123456789+-.,NnIi"]] = True


def contiguous(spans: DataFrame) -> DataFrame:
    """Spans one a row (doc_id, page, span_seq, y, x, text), or some of a page in an array s, dealt by
    document, for arrays()."""
    if "s" not in spans.columns:
        rest = [c for c in spans.columns if c not in ("doc_id", "page", "y", "x", "text", "span_seq")]
        spans = spans.select("doc_id", "page", *rest, F.array(F.struct("y", "x", "text", "span_seq")).alias("s"))
    return spans.where("doc_id IS NOT NULL").repartition("doc_id").sortWithinPartitions("doc_id")


def arrays(table: pa.Table) -> Spans:
    """Spans of rows (doc_id, page, s: array of y, x, text, span_seq)."""
    s = _one(table["s"])
    flat = s.flatten()
    part = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
    y, x, seq = (part[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("y", "x", "span_seq"))
    row = pc.list_parent_indices(s).to_numpy(zero_copy_only=False)
    return row, _one(table["page"]).to_numpy(zero_copy_only=False).astype(np.int64)[row], y, x, part["text"], seq


def _map(rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """work over tables of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []  # rows of the last document so far
        for b in batches:
            if not b.num_rows:
                continue
            doc = b.column("doc_id")
            changes = np.flatnonzero(pc.not_equal(doc[1:], doc[:-1]).to_numpy(zero_copy_only=False))
            cut = int(changes[-1]) + 1 if len(changes) else 0
            if cut or held and held[-1].column("doc_id")[-1] != doc[0]:
                yield from work(pa.Table.from_batches([*held, b.slice(0, cut)])).to_batches()
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return rows.mapInArrow(run, schema)


@dataclass
class Grid:
    """Pages by document and number, and their cells by page, row and column."""

    first_row: np.ndarray  # of each document, in the table
    page_doc: np.ndarray
    page_no: np.ndarray
    columns: np.ndarray  # of each page; -1 where it holds no table
    page: np.ndarray  # of each cell, as all below
    row: np.ndarray
    col: np.ndarray
    value: pa.Array


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def _starts(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 0 where there is none; number of bytes) of each text."""
    size = pc.binary_length(text).to_numpy(zero_copy_only=False)
    wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
    at = np.frombuffer(text.buffers()[1], wide)[text.offset : text.offset + len(text)] if len(text) else np.zeros(0, np.int64)
    first = np.zeros(len(text), np.uint8)
    some = size > 0
    if some.any():
        first[some] = np.frombuffer(text.buffers()[2], np.uint8)[at[some]]
    return first, size


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _order(*keys: np.ndarray) -> np.ndarray:
    """A stable order by keys, the first of them first."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    lows, spans = [int(k.min()) for k in keys], [int(k.max()) - int(k.min()) + 1 for k in keys]
    if np.prod([float(n) for n in spans]) >= 2.0**62:
        return np.lexsort(keys[::-1])
    one = np.zeros(len(keys[0]), np.int64)
    for k, low, n in zip(keys, lows, spans, strict=True):
        one = one * n + (k - low)
    return np.arange(len(one)) if (one[1:] >= one[:-1]).all() else np.argsort(one, kind="stable")


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, ...]:
    at = _order(*keys)
    keys = tuple(k[at] for k in keys)
    new = _begins(*keys)
    return tuple(k[new] for k in keys)


def _greedy(page: np.ndarray, v: np.ndarray, gap: int, most: int | None = None) -> np.ndarray:
    """Of each page's ascending values: the first, then each that is over gap beyond the one taken before; at most so many."""
    taken = np.zeros(len(v), bool)
    if not len(v):
        return taken
    line = page * (int(v.max()) - int(v.min()) + gap + 2) + (v - int(v.min()))
    at, n = np.flatnonzero(_begins(page)), 0
    while len(at) and (most is None or n < most):
        taken[at] = True
        to = np.searchsorted(line, line[at] + gap, side="right")
        go = to < len(v)
        go[go] = page[to[go]] == page[at[go]]
        at, n = to[go], n + 1
    return taken


def _settle_ties(order: np.ndarray, new: np.ndarray, text: pa.Array, seq: np.ndarray) -> np.ndarray:
    """Within runs of equal place, by text and span_seq."""
    tied = ~new
    tied[:-1] |= ~new[1:]
    at = np.flatnonzero(tied)
    if len(at):
        of, run = order[at], np.cumsum(new)[at]
        names = text.take(pa.array(of)).to_pylist()
        ranked = sorted(range(len(at)), key=lambda i: (run[i], names[i], seq[of[i]]))
        order = order.copy()
        order[at] = of[ranked]
    return order


def grid(table: pa.Table, read: Callable[[pa.Table], Spans], tolerance: int = 2) -> Grid:
    """Bounds, columns and cells of every page, by the rules of operators.layout."""
    doc = _one(table["doc_id"])
    new_doc = np.concatenate([[True], pc.not_equal(doc[1:], doc[:-1]).to_numpy(zero_copy_only=False)])
    span_row, number, y, x, names, seq = read(table)
    keys, page = np.unique(((np.cumsum(new_doc) - 1)[span_row] << 32) + (number + 2**31), return_inverse=True)
    n = len(keys)
    order = _order(page, y, x)
    order = _settle_ties(order, _begins(page[order], y[order], x[order]), names, seq)
    page, y, x, text = page[order], y[order], x[order], names.take(pa.array(order))

    first, size = _starts(text)
    rule = (first == ord("-")) | (first == ord(" "))
    at = np.flatnonzero(rule)
    rule[at] = pc.match_substring_regex(text.take(pa.array(at)), _RULE).to_numpy(zero_copy_only=False)

    def highest(mask: np.ndarray) -> np.ndarray:
        out, at = np.full(n, _NONE), np.flatnonzero(mask)
        at = at[_begins(page[at])]  # spans are sorted by y
        out[page[at]] = y[at]
        return out

    top = highest(first == ord("6"))
    at = np.flatnonzero(~rule & (top[page] == _NONE))
    if len(at):
        at = at[_order(page[at], x[at], y[at])]
        often = at[:-2][(page[at[2:]] == page[at[:-2]]) & (x[at[2:]] == x[at[:-2]])]
        np.minimum.at(top, page[often], y[often])
    above, inside = y < top[page], top[page] != _NONE
    feet, bottom = highest(rule & (size > 50) & inside & (y > top[page])), np.zeros(n, np.int64)
    last = np.flatnonzero(np.concatenate([_begins(page)[1:], [True]])) if len(page) else np.zeros(0, np.int64)
    bottom[page[last]] = y[last]
    bottom = np.where(feet == _NONE, bottom, feet - 3)

    lefts = [_distinct(page[m], x[m]) for m in [rule & above & inside]]
    bare = (np.bincount(lefts[0][0], minlength=n) == 0)[page] & inside
    at = np.flatnonzero(bare & above & (y > top[page] - 60))
    at = at[pc.utf8_length(text.take(pa.array(at))).to_numpy(zero_copy_only=False) <= 12]
    lefts.append(_distinct(page[at], x[at]))
    bare &= (np.bincount(lefts[1][0], minlength=n) == 0)[page]
    body = ~rule & (y < bottom[page])
    m = bare & body & ~above
    places = _distinct(page[m], x[m])
    kept = _greedy(*places, 20, 10)
    lefts.append(tuple(a[kept] for a in places))
    edge_page, edge = (np.concatenate([t[k] for t in lefts]) for k in (0, 1))
    at = _order(edge_page, edge)
    edge_page, edge = edge_page[at], edge[at]
    columns = np.bincount(edge_page, minlength=n)

    m = body & inside
    m[m] = y[m] >= top[page[m]] - 5
    at = np.flatnonzero(m)
    page, y, x = page[at], y[at], x[at]
    new_y = _begins(page, y)
    anchor = _greedy(page[new_y], y[new_y], tolerance)
    rank, begins = np.cumsum(anchor), _begins(page[new_y])
    base = np.repeat(rank[begins], np.diff(np.append(np.flatnonzero(begins), len(rank))))
    row = (rank - base)[np.cumsum(new_y) - 1]
    low, wide = (min(int(x.min(initial=0)), int(edge.min(initial=0))), max(int(x.max(initial=0)), int(edge.max(initial=0))))
    wide += 1 - low
    col = np.maximum(0, np.searchsorted(edge_page * wide + (edge - low), page * wide + (x - low), side="right") - (np.cumsum(columns) - columns)[page] - 1)

    by = _order(page, row, col)
    page, row, col, at = page[by], row[by], col[by], at[by]
    value, new = text.take(pa.array(at)), _begins(page, row, col)
    if not new.all():
        begin = np.append(np.flatnonzero(new), len(new)).astype(np.int32)
        value = pc.binary_join(pa.ListArray.from_arrays(pa.array(begin), value), "")
        page, row, col = page[new], row[new], col[new]
    return Grid(np.flatnonzero(new_doc), keys >> 32, (keys & 0xFFFFFFFF) - 2**31, np.where(top == _NONE, -1, columns), page, row, col, value)


def _number(text: str) -> float:
    t = text.strip("".join(map(chr, range(33)))).lower()
    if "0x" in t:
        return float.fromhex(t.rstrip("fd"))
    return float(t if "n" in t else t.rstrip("fd"))


def numbers(value: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(is a number without its commas, that number) of each value."""
    is_number, out = np.zeros(len(value), bool), np.zeros(len(value))
    at = np.flatnonzero(_NUMBER_STARTS[_starts(value)[0]] & (pc.binary_length(value).to_numpy(zero_copy_only=False) > 0))
    t = pc.replace_substring(value.take(pa.array(at)), ",", "")
    plain = pc.match_substring_regex(t, _PLAIN)
    m = plain.to_numpy(zero_copy_only=False)
    is_number[at[m]], out[at[m]] = True, pc.cast(t.filter(plain), pa.float64()).to_numpy(zero_copy_only=False)
    at, t = at[~m], t.filter(pc.invert(plain))
    loose = pc.match_substring_regex(t, _LOOSE)
    m = loose.to_numpy(zero_copy_only=False)
    for i, v in zip(at[m], t.filter(loose).to_pylist(), strict=True):
        try:
            is_number[i], out[i] = True, _number(v)
        except (ValueError, OverflowError):
            is_number[i] = False
    return is_number, out


def _products(doc, row, col, v, tolerance: float) -> tuple[np.ndarray, ...]:
    """(doc, i, j, k) of every row whose k-th column is the product of two others, i < j; cells by row and column."""
    begin = np.flatnonzero(_begins(row))
    size = np.diff(np.append(begin, len(row)))
    found = [np.zeros((4, 0), np.int64)]
    with np.errstate(all="ignore"):
        for m in np.unique(size[size >= 3]):
            at = begin[size == m][:, None] + np.arange(m)
            w, c = v[at], col[at]
            for i in range(m - 1):
                for j in range(i + 1, m):
                    r, k = np.nonzero(np.abs(w - (w[:, i] * w[:, j])[:, None]) <= tolerance)
                    other = (k != i) & (k != j)
                    r, k = r[other], k[other]
                    found.append(np.stack([doc[at[r, 0]], c[r, i], c[r, j], c[r, k]]))
    return tuple(np.concatenate(found, axis=1))


def _classified(table: pa.Table, read: Callable[[pa.Table], Spans], tolerance: float) -> pa.Table:
    g = grid(table, read)
    doc, n_docs = g.page_doc[g.page], len(g.first_row)
    is_number, v = numbers(g.value)
    length = pc.utf8_length(g.value).to_numpy(zero_copy_only=False).astype(np.int64)

    # Columns of documents, and what their values look like; shares and means in millionths, halves up.
    by = _order(doc, g.col)
    begin = np.flatnonzero(_begins(doc[by], g.col[by]))
    c_doc, c_col = doc[by][begin], g.col[by][begin]
    column = np.empty(len(by), np.int64)
    n = np.diff(np.append(begin, len(by)))
    column[by] = np.repeat(np.arange(len(begin)), n)
    count = lambda mask: np.bincount(column[mask], minlength=len(n))
    share = lambda total: (2_000_000 * total + n) // (2 * n)
    highest = lambda a: np.maximum.reduceat(a[by], begin) if len(begin) else n
    start, size = _starts(g.value)
    digit = np.flatnonzero((start >= ord("0")) & (start <= ord("9")))
    dated = np.zeros(len(doc), bool)
    dated[digit] = pc.match_substring_regex(g.value.take(pa.array(digit)), _DATE).to_numpy(zero_copy_only=False)
    inches = pc.ends_with(g.value, '"').to_numpy(zero_copy_only=False)
    decimals, at = np.zeros(len(doc), np.int64), np.flatnonzero(is_number)
    point = pc.find_substring(g.value.take(pa.array(at)), ".").to_numpy(zero_copy_only=False)
    decimals[at] = np.where(point >= 0, size[at] - point - 1, 0)
    total = np.add.reduceat(length[by], begin) if len(begin) else n
    mean, numeric, dated, inches = share(total), share(count(is_number)), share(count(dated)), share(count(inches))
    longest_value, decimals = highest(length), highest(decimals)
    kinds = np.bincount(_distinct(column, pc.dictionary_encode(g.value).indices.to_numpy(zero_copy_only=False).astype(np.int64))[0], minlength=len(n))

    # Amount is the product of two others in all rows that hold numbers.
    m = is_number & (numeric == 1_000_000)[column]
    row = np.cumsum(_begins(g.page, g.row))[m] if len(doc) else doc
    found = _products(doc[m], row, g.col[m], v[m], tolerance)
    found = tuple(a[_order(*found)] for a in found)
    hit = np.flatnonzero(_begins(*found))
    hits, rows = np.diff(np.append(hit, len(found[0]))), np.bincount(doc[m][_begins(row)], minlength=n_docs)
    hit = hit[hits >= rows[found[0][hit]]]
    hit = hit[_begins(found[0][hit])]
    triple = np.full((3, n_docs), -1)
    triple[:, found[0][hit]] = [a[hit] for a in found[1:]]
    i, j, k = triple[:, c_doc]
    places = np.zeros((2, n_docs), np.int64)
    for side, of in zip(places, (i, j), strict=True):
        side[c_doc[c_col == of]] = decimals[c_col == of]
    swap = (places[0] > places[1])[c_doc]
    qty, price = np.where(swap, j, i), np.where(swap, i, j)

    text = np.flatnonzero((numeric < 1_000_000) & (dated < 500_000) & (inches < 500_000))
    longest, key = np.full(n_docs, -1), np.full(n_docs, -1)
    best = text[_order(c_doc[text], -mean[text], c_col[text])]
    best = best[_begins(c_doc[best])]
    longest[c_doc[best]] = c_col[best]
    single = text[kinds[text] == n[text]]
    single = single[_begins(c_doc[single])]
    key[c_doc[single]] = c_col[single]
    names = [None, "QTY", "PRICE", "NEED_DATE", "WIDE", "MATM_DESC", "ORD_NO", "UNIT", None]
    rules = [c_col == k, c_col == qty, c_col == price, dated >= 500_000, inches >= 500_000, c_col == longest[c_doc], c_col == key[c_doc], (longest_value <= 3) & (2 * kinds <= n)]
    field = pa.array(names, pa.string()).take(pa.array(np.select(rules, range(8), 8)))
    return pa.table({"doc_id": _one(table["doc_id"]).take(pa.array(g.first_row[c_doc])), "col_idx": pa.array(c_col.astype(np.int32)), "field": field})


def _schema(rows: DataFrame, rest: str) -> str:
    return f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {rest}"


def classify_columns(rows: DataFrame, read: Callable[[pa.Table], Spans] = arrays, tolerance: float = 0.5) -> DataFrame:
    """matching.classify_columns over the grid of these spans, in one pass."""
    return _map(rows, lambda t: _classified(t, read, tolerance), _schema(rows, "col_idx int, field string"))


def _pages(table: pa.Table, read: Callable[[pa.Table], Spans]) -> pa.Table:
    g = grid(table, read)
    at = np.flatnonzero(g.columns >= 0)
    return pa.table({"doc_id": _one(table["doc_id"]).take(pa.array(g.first_row[g.page_doc[at]])), "page": pa.array(g.page_no[at].astype(np.int32)), "n": pa.array(g.columns[at].astype(np.int32))})


def page_columns(rows: DataFrame, read: Callable[[pa.Table], Spans] = arrays) -> DataFrame:
    """doc_id, page, n: the number of columns of each page that holds a table."""
    return _map(rows, lambda t: _pages(t, read), _schema(rows, "page int, n int"))


def _modal(g: Grid) -> np.ndarray:
    """Of each document: the commonest column count above 0, of equals the one seen first; else 0."""
    at = np.flatnonzero(g.columns > 0)
    at = at[_order(g.page_doc[at], g.columns[at], g.page_no[at])]
    begin = np.flatnonzero(_begins(g.page_doc[at], g.columns[at]))
    size, at = np.diff(np.append(begin, len(at))), at[begin]
    at = at[_order(g.page_doc[at], -size, g.page_no[at])]
    at = at[_begins(g.page_doc[at])]
    out = np.zeros(len(g.first_row), np.int64)
    out[g.page_doc[at]] = g.columns[at]
    return out


def _mapped(table: pa.Table, read: Callable[[pa.Table], Spans]) -> pa.Table:
    g = grid(table, read)
    mapping = _one(table["mapping"]).take(pa.array(g.first_row))
    wanted = pc.list_value_length(mapping).to_numpy(zero_copy_only=False)
    fields = pc.fill_null(pc.index_in(mapping.flatten(), pa.array(S.IMPORTED)), -1).to_numpy(zero_copy_only=False)
    fits = (g.columns == wanted[g.page_doc]) & (_modal(g) == wanted)[g.page_doc]
    at = np.flatnonzero(fits[g.page])
    field = fields[(np.cumsum(wanted) - wanted)[g.page_doc[g.page[at]]] + g.col[at]]
    at, field = at[field >= 0], field[field >= 0]
    new = _begins(g.page[at], g.row[at])
    row, first = np.cumsum(new) - 1, at[new]
    cell = np.full((len(S.IMPORTED), len(first)), -1)
    cell[field, row] = at
    told = cell[S.IMPORTED.index("ORD_NO")] >= 0
    cell, first = cell[:, told], first[told]
    page = g.page[first]
    key = {"doc_id": _one(table["doc_id"]).take(pa.array(g.first_row[g.page_doc[page]])), "page": pa.array(g.page_no[page].astype(np.int32)), "row_idx": pa.array(g.row[first].astype(np.int32))}
    return pa.table(key | {f: g.value.take(pa.array(c, mask=c < 0)) for f, c in zip(S.IMPORTED, cell, strict=True)})


def mapped_rows(rows: DataFrame, read: Callable[[pa.Table], Spans] = arrays) -> DataFrame:
    """doc_id, page, row_idx and the text of each imported field: the rows with an order number of the
    pages whose column count is both their document's commonest and the length of its mapping, which is
    in each of its rows and names no field twice."""
    return _map(rows, lambda t: _mapped(t, read), _schema(rows, "page int, row_idx int, " + ", ".join(f"{f} string" for f in S.IMPORTED)))
