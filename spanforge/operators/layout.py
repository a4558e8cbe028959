"""From positioned text to tables. A page is one row with its spans in an array, so one
shuffle by (doc_id, page) serves every operator; a page's spans are bounded by its paper.

What an array lambda reads besides its own element is bound by ``let`` first: the optimizer
would otherwise copy a column's whole expression into the lambda and run it per element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.scalar import let
from spanforge.sources.builders import is_rule

KEY = ("doc_id", "page")


def pages(spans: DataFrame) -> DataFrame:
    """doc_id, page, s: spans sorted by (y, x, text, span_seq) with their rule flag; first: the
    least y of a text that begins with 6; low: the largest y. spans: one a row, or those of a page
    in such an array s, which are not dealt anew."""
    if "s" in spans.columns:
        sixes = F.transform(F.filter("s", lambda z: z["text"].startswith("6")), lambda z: z["y"])
        return spans.select(*KEY, "s", F.array_min(sixes).alias("first"), F.element_at("s", -1)["y"].alias("low"))
    marked = spans.select(*KEY, "y", "x", "text", "span_seq", is_rule(F.col("text")).alias("rule"))
    return marked.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("y", "x", "text", "span_seq", "rule"))).alias("s"),
        F.min(F.when(F.col("text").startswith("6"), F.col("y"))).alias("first"), F.max("y").alias("low"),
    )


def _field(a: Column, name: str) -> Column:
    return F.transform(a, lambda z: z[name])


def repeated_top(s: Column) -> Column:
    """The least y among x places that hold three texts or more: of texts sorted by (x, y), those
    whose x is also that of the one two further on; one sort a page."""
    places = F.array_sort(F.transform(F.filter(s, lambda z: ~z["rule"]), lambda z: F.struct(z["x"].alias("x"), z["y"].alias("y"))))
    return let(places, lambda w: F.array_min(F.transform(F.filter(w, lambda z, i: F.get(w, i + 2)["x"] == z["x"]), lambda z: z["y"])))


def with_bounds(df: DataFrame) -> DataFrame:
    """Adds top and bottom; null where the page holds no table."""
    df = df.withColumn("top", F.when(F.col("first").isNotNull(), F.col("first")).otherwise(repeated_top(F.col("s"))))
    feet = let(F.col("top"), lambda top: F.array_min(_field(F.filter("s", lambda z: z["rule"] & (F.length(z["text"]) > 50) & (z["y"] > top)), "y")))
    return df.withColumn("bottom", F.when(F.col("top").isNotNull(), F.coalesce(feet - 3, F.col("low"))))


def _distinct(a: Column) -> Column:
    return F.array_sort(F.array_distinct(_field(a, "x")))


def _body_edges(s: Column, top: Column, bottom: Column) -> Column:
    """At most ten left edges of body texts, each over 20 right of the one before."""
    body = _distinct(F.filter(s, lambda z: (z["y"] >= top) & (z["y"] < bottom) & ~z["rule"]))
    spread = F.aggregate(body, F.array().cast("array<int>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > 20), F.concat(acc, F.array(x))).otherwise(acc))
    return F.slice(spread, 1, 10)


def with_lefts(df: DataFrame) -> DataFrame:
    """Adds lefts (ascending) and tier: 1 header rules, 2 header texts, 3 body positions."""
    s = F.col("s")

    def edges(b: Column) -> Column:
        top, bottom = b["top"], b["bottom"]
        one = _distinct(F.filter(s, lambda z: z["rule"] & (z["y"] < top)))
        two = _distinct(F.filter(s, lambda z: (z["y"] < top) & (z["y"] > top - 60) & (F.length(z["text"]) <= 12)))
        made = lambda tier, lefts: F.struct(F.lit(tier).alias("tier"), lefts.alias("lefts"))
        return let(one, lambda a: F.when(F.size(a) > 0, made(1, a)).otherwise(let(two, lambda t: F.when(F.size(t) > 0, made(2, t)).otherwise(made(3, _body_edges(s, top, bottom))))))

    found = let(F.struct(F.col("top").alias("top"), F.col("bottom").alias("bottom")), edges)
    df = df.withColumn("__edges", found)
    return df.select("*", F.col("__edges.tier").alias("tier"), F.col("__edges.lefts").alias("lefts")).drop("__edges")


def column_index(lefts: Column, x: Column) -> Column:
    """The last left edge at or before x; x before the first belongs to it."""
    return F.greatest(F.lit(0), F.size(F.filter(lefts, lambda e: e <= x)) - 1)


def row_anchors(ys: Column, tolerance: int) -> Column:
    """First y of every row: a fold over ascending y, as a row reaches from its first y only."""
    start = F.array().cast("array<int>")
    return F.aggregate(ys, start, lambda acc, y: F.when((F.size(acc) == 0) | (y - F.element_at(acc, -1) > tolerance), F.concat(acc, F.array(y))).otherwise(acc))


def tables(spans: DataFrame) -> DataFrame:
    """Pages with bounds and columns; pages without a table are left out."""
    return with_lefts(with_bounds(pages(spans)).where("top IS NOT NULL"))


def _placed(tolerance: int) -> Column:
    """A page's body spans in (y, x, text) order, as structs with their row_idx and col_idx."""
    inside = lambda b: F.filter("s", lambda z: ~z["rule"] & (z["y"] >= b["top"] - 5) & (z["y"] < b["bottom"]))

    def placed(b: Column) -> Column:
        def rows(body: Column) -> Column:
            anchors = row_anchors(F.array_distinct(_field(body, "y")), tolerance)  # spans are sorted by y
            cell = lambda e: lambda z: F.struct(column_index(e["anchors"], z["y"]).alias("row_idx"), column_index(e["lefts"], z["x"]).alias("col_idx"), *[z[c].alias(c) for c in ("y", "x", "text", "span_seq")])
            return let(F.struct(anchors.alias("anchors"), b["lefts"].alias("lefts")), lambda e: F.transform(body, cell(e)))

        return let(inside(b), rows)

    return let(F.struct(*[F.col(c).alias(c) for c in ("top", "bottom", "lefts")]), placed)


def body_cells(df: DataFrame, tolerance: int = 2) -> DataFrame:
    """Long form of the body's spans: row_idx, col_idx, y, x, text, span_seq."""
    return df.select(*KEY, F.inline(_placed(tolerance)))


def page_grid(df: DataFrame, tolerance: int = 2) -> DataFrame:
    """df (tables()) with cells: a page's cells (row_idx, col_idx, value) by row and column, values joined in (y, x, text) order."""
    kind = "array<struct<row_idx:int,col_idx:int,value:string>>"
    cell = lambda z, value: F.struct(z["row_idx"].alias("row_idx"), z["col_idx"].alias("col_idx"), value.alias("value"))
    same = lambda a, b: (a["row_idx"] == b["row_idx"]) & (a["col_idx"] == b["col_idx"])

    def merged(c: Column) -> Column:
        # Spans are sorted by row and column: a cell begins where one of these changes. Each first
        # span looks ahead for the rest of its cell only on pages where some cell has several.
        last = lambda acc: F.element_at(acc, -1)
        grow = lambda acc, z: F.when((F.size(acc) > 0) & same(last(acc), z), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(cell(z, F.concat(last(acc)["value"], z["text"]))))).otherwise(F.concat(acc, F.array(cell(z, z["text"]))))
        split = F.exists(F.transform(c, lambda z, i: F.coalesce(same(F.get(c, i + 1), z), F.lit(False))), lambda x: x)
        return F.when(split, F.aggregate(c, F.array().cast(kind), grow)).otherwise(F.transform(c, lambda z: cell(z, z["text"])))

    return df.withColumn("cells", let(F.sort_array(_placed(tolerance)), merged))


def _rows_of(df: DataFrame) -> DataFrame:
    """doc_id, page, row_idx, cells of pages with cells; a page's rows are numbered from 0 without gaps."""
    numbers = F.when(F.size("cells") > 0, F.sequence(F.lit(0), F.element_at("cells", -1)["row_idx"]))
    row = lambda r: F.struct(r.alias("row_idx"), F.transform(F.filter("cells", lambda z: z["row_idx"] == r), lambda z: F.struct(z["col_idx"].alias("col_idx"), z["value"].alias("value"))).alias("cells"))
    return df.select(*KEY, "cells").select(*KEY, F.inline(F.transform(numbers, row)))


def grid_rows(spans: DataFrame, tolerance: int = 2) -> DataFrame:
    """doc_id, page, row_idx, cells: array of (col_idx, value) by column, values joined in (y, x, text) order."""
    return _rows_of(page_grid(tables(spans), tolerance))


def grid(spans: DataFrame, tolerance: int = 2) -> DataFrame:
    """doc_id, page, row_idx, col_idx, value: cells joined in (y, x, text) order."""
    return page_grid(tables(spans), tolerance).select(*KEY, F.inline("cells"))


def nearest_headers(spans: DataFrame, reach: int = 40, above: int = 25) -> DataFrame:
    """doc_id, page, col_idx, header: the nearest header text of each column, null if none is near."""

    def near(head: Column, edge: Column) -> Column:
        gap = lambda z: F.abs(z["x"] - edge)
        return F.array_min(F.transform(F.filter(head, lambda z: gap(z) < reach), lambda z: F.struct(gap(z).alias("d"), z["span_seq"].alias("n"), z["text"].alias("t"))))["t"]

    heads = lambda top: F.filter("s", lambda z: ~z["rule"] & (z["y"] < top) & (z["y"] >= top - above))
    named = let(F.col("top"), lambda top: let(heads(top), lambda head: F.transform("lefts", lambda e: near(head, e))))
    return tables(spans).select(*KEY, F.posexplode(named).alias("col_idx", "header"))


def page_preview(spans: DataFrame, width: int = 70) -> DataFrame:
    """doc_id, page, y, line: the texts of equal y, left to right."""
    parts = F.array_sort(F.collect_list(F.struct("x", "text", "span_seq")))
    return spans.groupBy(*KEY, "y").agg(F.substring(F.array_join(F.transform(parts, lambda p: p["text"]), " "), 1, width).alias("line"))


def page_runs(spans: DataFrame, width: int = 34) -> DataFrame:
    """doc_id, page, run, x, line: texts of consecutive equal x in (y, x, text) order, joined and cut to width."""

    def step(acc: Column, z: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["x"].alias("x"), F.concat_ws(" ", last["line"], z["text"]).alias("line"))
        new = F.struct(z["x"].alias("x"), z["text"].alias("line"))
        return F.when((F.size(acc) > 0) & (last["x"] == z["x"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(new)))

    s = F.array_sort(F.collect_list(F.struct("y", "x", "text", "span_seq")))
    runs = F.aggregate("s", F.array().cast("array<struct<x:int,line:string>>"), step)
    flat = spans.groupBy(*KEY).agg(s.alias("s")).select(*KEY, F.posexplode(runs).alias("run", "r"))
    return flat.select(*KEY, "run", F.col("r.x").alias("x"), F.substring("r.line", 1, width).alias("line"))


def truth_tables(spans: DataFrame, tolerance: int = 2, width: int = 70) -> DataFrame:
    """doc_id, page, top, bottom, tier, lefts, rows, previews: what the layout operators find on a
    page, one row a page, with the number of rows and a line of text for each of them."""
    t = tables(spans)
    row = F.struct("row_idx", F.substring(F.array_join(_field(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), "text"), " "), 1, width).alias("line"))
    lines = body_cells(t, tolerance).groupBy(*KEY, "row_idx").agg(row["line"].alias("line"))
    per = lines.groupBy(*KEY).agg(F.count("*").alias("rows"), F.array_sort(F.collect_list(F.struct("row_idx", "line"))).alias("l"))
    return t.select(*KEY, "top", "bottom", "tier", "lefts").join(per, list(KEY), "left").select(*KEY, "top", "bottom", "tier", "lefts", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce(_field(F.col("l"), "line"), F.array().cast("array<string>")).alias("previews"))
