"""Which column holds which field: headers, proposals, votes, content."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge import schema as S
from spanforge.functions import loose_json as J
from spanforge.functions import scalar as C
from spanforge.operators import layout as L

HEADER_REACH = 40


def in_order(columns: list) -> bool:
    """Do the known fields stand in the document's usual order?"""
    places = [S.COLUMN_ORDER.index(f) for f in columns if f in S.COLUMN_ORDER and f is not None]
    return all(a < b for a, b in zip(places, places[1:], strict=False))


def infer(lefts: list[int], headers: list[tuple[int, list[str]]]) -> tuple[list, bool]:
    """(field per column, order is safe) from header places and their candidate fields.

    Nearest headers win first.  Fields of merged headers go to the next free column on the
    right, and the usual order fills what is left, only while the order is the usual one;
    otherwise columns stay blank rather than guessed.
    """
    n = len(lefts)
    found = []
    for x, fields in headers:
        if not n:
            break
        gap, at = min((abs(edge - x), i) for i, edge in enumerate(lefts))
        if gap < HEADER_REACH:
            found += [(at, gap, f) for f in fields]
    by_gap, by_place = sorted(found, key=lambda c: (c[1], c[0])), sorted(found, key=lambda c: (c[0], c[1]))

    columns: list = [None] * n
    for at, _, f in by_gap:
        if f not in columns and columns[at] is None:
            columns[at] = f

    def spread(filled: list) -> list:
        taken = {f for f in filled if f}
        for at, _, f in by_place:
            free = next((j for j in range(at, n) if filled[j] is None), None)
            if f not in taken and free is not None:
                filled[free] = f
                taken.add(f)
        return filled

    trial: list = [None] * n
    for at, _, f in by_gap:
        trial[at] = trial[at] or f
    safe = in_order(columns) and in_order(spread(trial))
    if safe:
        columns = spread(columns)
        if None in columns:
            rest = list(S.COLUMN_ORDER)
            for f in columns:
                if f is not None:
                    rest.remove(f)
            for i in range(n):
                if columns[i] is None and rest:
                    columns[i] = rest.pop(0)
    return columns, safe


def infer_fields(spans: DataFrame) -> DataFrame:
    """doc_id, page, fields, safe: the field of every column of a page."""
    t = L.tables(spans)
    head = C.let(F.col("top"), lambda top: F.filter("s", lambda z: ~z["rule"] & (z["y"] < top)))
    found = C.let(head, lambda h: F.struct(F.transform(h, lambda z: z["x"]).alias("xs"), F.transform(h, lambda z: C.header_candidates(z["text"])).alias("found")))
    t = t.select(*L.KEY, "lefts", found.alias("h")).select(*L.KEY, "lefts", "h.xs", "h.found")
    schema = T.StructType([t.schema[c] for c in L.KEY] + [T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("safe", T.BooleanType())])

    def run(frames):
        for f in frames:
            got = [infer([int(v) for v in e], [(int(p), list(c)) for p, c in zip(x, cs, strict=True)]) for e, x, cs in zip(f["lefts"], f["xs"], f["found"], strict=True)]
            yield pd.DataFrame({"doc_id": f["doc_id"], "page": f["page"], "fields": [g[0] for g in got], "safe": [g[1] for g in got]})

    return t.mapInPandas(run, schema)


def order_ok(mapping: Column) -> Column:
    """in_order() as an expression over array<string> with nulls."""
    order = F.array(*[F.lit(f or "") for f in S.COLUMN_ORDER])
    places = F.filter(F.transform(mapping, lambda f: F.array_position(order, F.coalesce(f, F.lit("?")))), lambda p: p > 0)
    return ~F.exists(F.zip_with(places, F.slice(places, 2, 1000), lambda a, b: a >= b), lambda bad: F.coalesce(bad, F.lit(False)))


def modal_columns(pages: DataFrame) -> DataFrame:
    """doc_id, n: the commonest column count above 0; of equals the one seen first.  pages: (doc_id, page, n)."""
    per = pages.where("n > 0").groupBy("doc_id", "n").agg(F.count("*").alias("c"), F.min("page").alias("p"))
    return per.groupBy("doc_id").agg(F.max_by("n", F.struct("c", -F.col("p"))).alias("n"))


def sample_rows(grid_rows: DataFrame, limit: int) -> DataFrame:
    """Row 0 of each page, then row 1 of each page, ... up to limit.  grid_rows: (doc_id, page, row_idx, ...)."""
    order = W.partitionBy("doc_id").orderBy("row_idx", "page")
    return grid_rows.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= limit)


def parse_mapping(raw: Column, n: Column | None) -> Column:
    """struct(mapping, error): any fault rejects the whole proposal. Without n, any length will do."""
    value = J.loose_json(raw)
    listed = F.from_json(F.get_json_object(value["value"], "$.mapping"), "array<string>")
    # Each step is bound: an answer is read once, an item of it resolved once. Blank items are null, unknown ones have a null field.
    item = lambda x: C.let(C.stripped(x), lambda t: F.when(t.isNotNull() & ~F.lower(t).isin(*S.NULL_WORDS), F.struct(C.resolve_field(t).alias("field"))))
    read = lambda v: F.struct(v["fault"].alias("fault"), v["listed"].alias("listed"), F.transform(v["listed"], item).alias("items"))
    named = lambda r: F.struct(r["fault"].alias("fault"), r["listed"].alias("listed"), r["items"].alias("items"), F.transform(r["items"], lambda i: i["field"]).alias("fields"))

    def judged(r: Column) -> Column:
        odd = F.exists(r["items"], lambda i: i.isNotNull() & ~F.coalesce(i["field"].isin(*S.IMPORTED), F.lit(False)))
        told = F.filter(r["fields"], lambda x: x.isNotNull())
        error = (
            F.when(r["fault"].isNotNull(), "no JSON").when(r["listed"].isNull(), "no mapping").when(F.lit(False) if n is None else F.size(r["listed"]) != n, "length")
            .when(odd, "unknown field").when(F.size(told) != F.size(F.array_distinct(told)), "duplicate")
        )
        return F.struct(r["fields"].alias("fields"), error.alias("error"))

    made = F.struct(value["error"].alias("fault"), listed.alias("listed"))
    return C.let(made, lambda v: C.let(read(v), lambda r: C.let(named(r), lambda m: C.let(judged(m), lambda e: F.struct(F.when(e["error"].isNull(), e["fields"]).alias("mapping"), e["error"].alias("error"))))))


def mapping_faults(raw: Column, n: Column) -> Column:
    """struct(mapping, faults): strict JSON, but a faulty proposal is kept beside its faults."""
    listed = F.from_json(F.get_json_object(raw, "$.mapping"), "array<string>")
    said = F.filter(listed, lambda x: x.isNotNull() & (F.lower(F.trim(x)) != "null"))
    faults = F.array_compact(F.array(
        F.when(F.try_parse_json(raw).isNull(), "no JSON").when(listed.isNull(), "no mapping"), F.when(F.size(listed) != n, "length"),
        F.when(F.exists(listed, lambda x: F.coalesce(F.lower(F.trim(x)) == "null", F.lit(False))), "null as text"), F.when(F.size(said) != F.size(F.array_distinct(said)), "duplicate"),
    ))
    return F.struct(listed.alias("mapping"), faults.alias("faults"))


def vote(proposals: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, mapping, votes, runs: a mapping that more than half of the runs share, else null."""
    per = proposals.groupBy(key, "mapping").agg(F.count("*").alias("c"))
    out = per.groupBy(key).agg(F.max_by("mapping", "c").alias("m"), F.max("c").alias("votes"), F.sum("c").alias("runs"))
    return out.select(key, F.when(2 * F.col("votes") > F.col("runs"), F.col("m")).alias("mapping"), "votes", "runs")


def agreed(answers: DataFrame) -> DataFrame:
    """doc_id, mapping: the vote of documents all of whose answers are faultless and of one length, which
    their pages have yet to match; answers are dealt by document alone."""
    p = answers.select("doc_id", parse_mapping(F.col("raw"), None)["mapping"].alias("mapping"))
    per = p.groupBy("doc_id", "mapping").agg(F.count("*").alias("c"))
    all_of = per.groupBy("doc_id").agg(F.max_by("mapping", "c").alias("mapping"), F.max("c").alias("votes"), F.sum("c").alias("runs"), F.count_if(F.col("mapping").isNull()).alias("bad"), F.min(F.size("mapping")).alias("low"), F.max(F.size("mapping")).alias("high"))
    return all_of.where("bad = 0 AND low = high AND 2 * votes > runs").select("doc_id", "mapping")


def apply_grid(rows: DataFrame, mappings: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Long cells (…, row_idx, field, value) of rows that have an order number.  rows: layout.grid_rows()."""
    joined = rows.join(mappings.select(*key, "mapping"), list(key))
    named = C.let(F.col("mapping"), lambda m: F.transform("cells", lambda c: F.struct(F.get(m, c["col_idx"]).alias("field"), c["value"].alias("value"))))
    # Cells without a field go; so does a row without an order number.
    wanted = C.let(named, lambda n: F.when(F.exists(n, lambda c: F.coalesce(c["field"] == "ORD_NO", F.lit(False))), F.filter(n, lambda c: c["field"].isNotNull())))
    return joined.select("doc_id", "page", "row_idx", F.inline(wanted))


def skipped_pages(pages: DataFrame, mappings: DataFrame) -> DataFrame:
    """Pages whose column count differs from the mapping's length."""
    return pages.join(mappings.select("doc_id", F.size("mapping").alias("wanted")), "doc_id").where("n <> wanted").select("doc_id", "page", "n", "wanted")


def agreement(a: Column, b: Column) -> Column:
    """Positions at which two mappings differ; beyond its end a mapping names no field."""
    both = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    return F.filter(F.transform(both, lambda d, i: F.when(d, i)), lambda i: i.isNotNull())


def agreement_with_inferred(mappings: DataFrame, inferred: DataFrame) -> DataFrame:
    """mappings with differ: where each departs from what headers tell on the first page that holds a table.

    An empty list means that both sources agree, not that they are right.
    """
    first = inferred.groupBy("doc_id").agg(F.min_by("fields", "page").alias("inferred"))
    return mappings.join(first, "doc_id").withColumn("differ", agreement(F.col("mapping"), F.col("inferred")))


def column_profile(grid: DataFrame) -> DataFrame:
    """What the values of each column look like."""
    v = F.col("value")
    number = F.translate(v, ",", "").try_cast("double")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return grid.groupBy("doc_id", "col_idx").agg(
        F.count("*").alias("n"), F.countDistinct("value").alias("kinds"), F.round(F.avg(F.length(v)), 6).alias("mean_length"), F.max(F.length(v)).alias("max_length"),
        share(number.isNotNull()).alias("numeric"), share(v.rlike(r"^\d{2,4}[/-]\d{1,2}[/-]\d{1,2}$") | v.rlike(r"^20\d{6}$")).alias("dated"),
        share(v.endswith('"')).alias("inches"), F.max(F.when(number.isNotNull() & v.contains("."), F.length(F.substring_index(v, ".", -1))).otherwise(0)).alias("decimals"),
    )


def classify_columns(grid: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """doc_id, col_idx, field: from content alone.

    Amount is the product of two other columns; of these the one with fewer decimals is the
    quantity.  Then dates, inches, the longest text, and repetition decide.
    """
    p = column_profile(grid)
    # Joined by document alone and a row at a time: what lies together by document is not dealt anew.
    numeric = p.where("numeric = 1.0").groupBy("doc_id").agg(F.collect_set("col_idx").alias("numbers"))
    parsed = grid.select("doc_id", "page", "row_idx", "col_idx", F.translate("value", ",", "").try_cast("double").alias("v")).where("v IS NOT NULL")
    row = parsed.groupBy("doc_id", "page", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "v"))).alias("c")).join(numeric, "doc_id")
    row = row.select("doc_id", "page", "row_idx", F.filter("c", lambda z: F.array_contains("numbers", z["col_idx"])).alias("c")).where(F.size("c") > 0)
    # All column triples of a row; a row holds about ten cells.
    pairs = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b["col_idx"] > a["col_idx"]), lambda b: F.struct(a["col_idx"].alias("i"), b["col_idx"].alias("j"), (a["v"] * b["v"]).alias("x")))))
    triples = F.flatten(F.transform(pairs, lambda q: F.transform(F.filter("c", lambda z: (z["col_idx"] != q["i"]) & (z["col_idx"] != q["j"]) & (F.abs(z["v"] - q["x"]) <= tolerance)), lambda z: F.struct(q["i"].alias("i"), q["j"].alias("j"), z["col_idx"].alias("k")))))
    hit = row.select("doc_id", F.explode(F.array_distinct(triples)).alias("t")).groupBy("doc_id", "t").agg(F.count("*").alias("hits"))
    rows = row.groupBy("doc_id").agg(F.count("*").alias("rows"))
    # Never more hits than rows; an equality would become a key of the join and deal both sides anew.
    best = hit.join(rows, "doc_id").where("hits >= rows").groupBy("doc_id").agg(F.min("t").alias("t"))
    w = W.partitionBy("doc_id")  # about ten columns a document
    q = p.join(best, "doc_id", "left")
    of = lambda i: F.max(F.when(F.col("col_idx") == F.col(f"t.{i}"), F.col("decimals"))).over(w)
    q = q.withColumn("swap", of("i") > of("j")).withColumn("is_text", (F.col("numeric") < 1.0) & (F.col("dated") < 0.5) & (F.col("inches") < 0.5))
    y = q.select(
        "*", F.when(F.col("swap"), F.col("t.j")).otherwise(F.col("t.i")).alias("q"), F.when(F.col("swap"), F.col("t.i")).otherwise(F.col("t.j")).alias("r"), F.col("t.k").alias("k"),
        F.max_by("col_idx", F.when(F.col("is_text"), F.struct("mean_length", -F.col("col_idx")))).over(w).alias("longest"),
        F.min(F.when(F.col("is_text") & (F.col("kinds") == F.col("n")), F.col("col_idx"))).over(w).alias("first_key"),
    )
    c = F.col("col_idx")
    field = (
        F.when(c == F.col("k"), None).when(c == F.col("q"), "QTY").when(c == F.col("r"), "PRICE").when(F.col("dated") >= 0.5, "NEED_DATE").when(F.col("inches") >= 0.5, "WIDE")
        .when(c == F.col("longest"), "MATM_DESC").when(c == F.col("first_key"), "ORD_NO").when((F.col("max_length") <= 3) & (F.col("kinds") * 2 <= F.col("n")), "UNIT")
    )
    return y.select("doc_id", "col_idx", field.alias("field"))


def prompt(sample: DataFrame, vocabulary: tuple[str, ...] = S.IMPORTED) -> DataFrame:
    """doc_id, prompt: the question to a classifier, from sampled rows (doc_id, pick, cells map<int,string>)."""
    line = F.concat(F.lit("row "), F.col("pick").cast("string"), F.lit(": "), F.to_json("cells"))
    per = sample.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pick", line.alias("line")))).alias("l"))
    head = "Name the field of each column. Fields: " + ", ".join(vocabulary) + ". Use null for none. Answer as JSON with a list under mapping.\n"
    return per.select("doc_id", F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("prompt"))


def predict(prompts: DataFrame, predictor) -> DataFrame:
    """Raw answers from predictor(list of prompts) -> list of texts; models stay outside the plan."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "raw": predictor(f["prompt"].tolist())})

    return prompts.select("doc_id", "prompt").mapInPandas(run, prompts.select("doc_id", F.lit("").alias("raw")).schema)


def replay(prompts: DataFrame, recorded: DataFrame) -> DataFrame:
    """Answers (doc_id, run, raw) recorded earlier for these prompts; a prompt without one has a null answer, run 0."""
    return prompts.select("doc_id").join(recorded.select("doc_id", "run", "raw"), "doc_id", "left").select("doc_id", F.coalesce("run", F.lit(0)).alias("run"), "raw")
