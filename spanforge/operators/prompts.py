"""Questions to a model about pages, from layout tables; answers come back as a table (matching.replay)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge import schema as S
from spanforge.operators import layout as L

_FIELDS = "Fields: " + ", ".join(S.IMPORTED) + ". Use null for none."


def _lines(rows: DataFrame, order: list[str], line: Column) -> DataFrame:
    """doc_id, page, lines: a page's lines joined in order."""
    per = rows.groupBy(*L.KEY).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("l"))
    return per.select(*L.KEY, F.array_join(F.transform("l", lambda z: z["line"]), "\n").alias("lines"))


def _asked(lines: DataFrame, head: str, tail: Column | str) -> DataFrame:
    return lines.select(*L.KEY, F.concat(F.lit(head + "\n"), "lines", F.lit("\n"), tail if isinstance(tail, Column) else F.lit(tail)).alias("prompt"))


def bounds_prompt(spans: DataFrame) -> DataFrame:
    """Where does the table begin and end?  Texts by y."""
    lines = _lines(L.page_preview(spans), ["y"], F.concat(F.lit("y="), F.col("y").cast("string"), F.lit(" "), "line"))
    return _asked(lines, "Texts of a page by height in points.", 'At which heights does the order table begin and end? Answer as JSON: {"top": 0, "bottom": 0}')


def rows_prompt(spans: DataFrame, width: int = 160) -> DataFrame:
    """Which lines are rows of the table?  All lines, numbered."""
    per = L.page_preview(spans, width).groupBy(*L.KEY).agg(F.array_sort(F.collect_list(F.struct("y", "line"))).alias("l"))
    flat = per.select(*L.KEY, F.posexplode("l").alias("k", "z"))
    lines = _lines(flat, ["k"], F.concat(F.lit("R"), F.col("k").cast("string"), F.lit(" "), F.col("z.line")))
    return _asked(lines, "Numbered lines of a page.", 'Which is the first and which the last row of the order table? Answer as JSON: {"first": 0, "last": 0}')


def edges_prompt(spans: DataFrame) -> DataFrame:
    """Where do the columns begin?  Texts by x, and how many columns there are."""
    lines = _lines(L.page_runs(spans), ["run"], F.concat(F.lit("x="), F.col("x").cast("string"), F.lit(" "), "line"))
    n = L.tables(spans).select(*L.KEY, F.size("lefts").alias("n"))
    tail = F.concat(F.lit("The table has "), F.col("n").cast("string"), F.lit(' columns. Where does each begin? Answer as JSON, ascending: {"lefts": [0]}'))
    return _asked(lines.join(n, list(L.KEY)), "Texts of a page by place from the left in points.", tail)


def _cells(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows of each page as index=value."""
    line = F.concat(F.lit("R"), F.col("row_idx").cast("string"), F.lit(": "), F.array_join(F.transform("cells", lambda c: F.concat(c["col_idx"].cast("string"), F.lit("="), c["value"])), " | "))
    return _lines(rows.where(F.col("row_idx") < limit), ["row_idx"], line)


def whole_prompt(spans: DataFrame, limit: int = 2) -> DataFrame:
    """Bounds and fields in one question."""
    heights = _lines(L.page_preview(spans), ["y"], F.concat(F.lit("y="), F.col("y").cast("string"), F.lit(" "), "line"))
    cells = _cells(L.grid_rows(spans), limit).withColumnRenamed("lines", "cells")
    both = heights.join(cells, list(L.KEY)).withColumn("lines", F.concat_ws("\n", "lines", F.lit("Rows of the table as column=value:"), "cells"))
    return _asked(both, "Texts of a page by height in points.", f'Where does the table begin and end, and which field is each column? {_FIELDS} Answer as JSON: {{"top": 0, "bottom": 0, "mapping": ["..."]}}')


def arm_prompt(sample: DataFrame, texts: list[str]) -> DataFrame:
    """The same question beside different specification texts (whole, in order); sample: doc_id, n, headers (array), rows (array of text)."""
    spec = "\n\n".join([*texts, "The above is the specification. The table to judge:"])
    heads = F.array_join(F.transform("headers", lambda h, i: F.concat(i.cast("string"), F.lit("="), F.coalesce(h, F.lit("")))), " | ")
    return sample.select("doc_id", F.concat_ws("\n", F.lit(spec), F.concat(F.lit("columns: "), F.col("n").cast("string")), F.concat(F.lit("headers: "), heads), F.array_join("rows", "\n"), F.concat(F.lit('Answer as JSON: {"mapping": [...]} of length '), F.col("n").cast("string"))).alias("prompt"))


def image_prompt(bands: DataFrame, spec: str, of: int, final: bool) -> DataFrame:
    """A question for each band of a page image (sources.page_bands): typed records, or texts as they stand."""
    keys = ", ".join(S.FIELDS) if final else "the header texts of the page"
    ask = f"Answer with JSON alone: every row of the table, {'converted by the specification, under data with recordCount' if final else 'texts unchanged, under rows'}; keys: {keys}."
    at = F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(", band "), F.col("band").cast("string"), F.lit(f" of {of}."))
    return bands.select("doc_id", "page", "band", F.concat_ws("\n", F.lit(spec), at, F.lit(ask)).alias("prompt"), "image")
