"""Reports as tables of lines: (section, a, b, c, line), in the order of the first four columns.

Nothing is gathered on the driver: a report may list every difference of a large comparison,
and sorting and writing it stays distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge import schema as S
from spanforge.operators import compare as A
from spanforge.operators import metrics as E

ORDER = ("section", "a", "b", "c")


def parse_limit(value: str | int | None) -> int | None:
    """How many rows to show: "all", a negative number or nothing is no limit."""
    if value is None or str(value).strip().lower() == "all":
        return None
    return None if int(value) < 0 else int(value)


def _line(section: int, line: Column, a: Column | int = 0, b: Column | int = 0, c: Column | str = "") -> list[Column]:
    of = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return [F.lit(section).alias("section"), of(a, "long").alias("a"), of(b, "long").alias("b"), of(c, "string").alias("c"), line.alias("line")]


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _percent(rate: Column) -> Column:
    """One decimal and a percent sign."""
    return _text(F.round(rate, 1).cast("decimal(5,1)"), "%")


def _shown(c: str) -> Column:
    return F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("(none)"))


def shaped_diffs(diffs: DataFrame) -> DataFrame:
    """diffs with the kind of each, how many there are of that kind in the field, and the field's place."""
    of = diffs.withColumn("shape", A.diff_shape_of())
    n = of.groupBy("field", "shape").agg(F.count("*").alias("n"))  # a few rows
    return of.join(F.broadcast(n), ["field", "shape"]).withColumn("place", F.array_position(F.array(*[F.lit(f) for f in S.FIELDS]), F.col("field")))


def compare_report(expected: DataFrame, actual: DataFrame, show: int | None = 10, full: bool = False) -> DataFrame:
    """Keys, accuracy of all cells and of each field, kinds of differences, and the differences
    themselves: the first ones by key, or all of them by field and kind."""
    overall, diffs = A.overall_accuracy(expected, actual), A.diff_cells(expected, actual)
    counts = expected.agg(F.count("*").alias("wanted")).join(F.broadcast(actual.agg(F.count("*").alias("got")))).join(F.broadcast(overall))  # three single rows
    common, cells = F.col("common"), F.col("common") * len(S.FIELDS)
    heads = [
        _text("records: expected ", F.col("wanted"), ", actual ", F.col("got")), _text("keys found: ", common, " of ", F.col("wanted")),
        _text("missing keys: ", F.col("wanted") - common), _text("extra keys: ", F.col("got") - common),
        _text("accuracy over ", common, " records of ", str(len(S.FIELDS)), " fields, ", cells, " cells: ", _percent(100 * F.col("accuracy"))), _text("differences: ", F.col("diffs")),
    ]
    parts = [counts.select(F.posexplode(F.array(*heads)).alias("k", "line")).select(*_line(1, F.col("line"), F.col("k")))]
    for section, word, keys in ((2, "missing", A.missing_keys(expected, actual)), (3, "extra", A.extra_keys(expected, actual))):
        parts.append(keys.select(*_line(section, _text(word, " ", F.col("doc_id"), " ", F.col("ORD_NO")), F.col("doc_id"), 0, F.col("ORD_NO"))))
    place = F.array_position(F.array(*[F.lit(f) for f in S.FIELDS]), F.col("field"))
    parts.append(A.field_accuracy(expected, actual).select(*_line(4, _text(F.rpad("field", 12, " "), F.lpad(F.col("errors").cast("string"), 8, " "), F.lpad(_percent(F.col("rate")), 8, " "), F.when(F.col("all_wrong"), " all wrong").otherwise("")), place)))
    kinds = A.diff_shapes(diffs)
    total = kinds.groupBy("field").agg(F.sum("n").alias("total"))
    kinds = kinds.join(F.broadcast(total), "field")  # twelve rows
    parts.append(kinds.select(*_line(5, _text(F.rpad("field", 12, " "), "[", F.col("n"), "] ", F.col("shape")), -F.col("total"), -F.col("n"), F.concat_ws(" ", "field", "shape"))))
    if full:
        told = shaped_diffs(diffs).select(*_line(6, _detail(), F.col("place"), -F.col("n"), F.concat_ws(" ", "shape", "doc_id", "ORD_NO")))
    else:
        first = diffs if show is None else diffs.orderBy("doc_id", "ORD_NO", "field").limit(show)
        told = first.select(*_line(6, _detail(), F.col("doc_id"), 0, F.concat_ws(" ", "ORD_NO", "field")))
    out = parts[0]
    for p in (*parts[1:], told):
        out = out.unionByName(p)
    return out


def _detail() -> Column:
    return _text(F.col("doc_id"), " ", F.col("ORD_NO"), " ", F.col("field"), ": expected ", _shown("expected"), ", actual ", _shown("actual"))


def run_report(run: dict[str, DataFrame], checks: DataFrame, *, problems: int = 20, mismatches: int = 10) -> DataFrame:
    """A run of plans.extract: its counts, the first problems and failed documents, and the cross-check
    (records.cross_check) with its first mismatches."""
    records = run["records"].agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.count_if("changed").alias("repaired"))
    checked = checks.agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad"))
    out = records.select(*_line(1, _text("records: ", F.col("n"), " of ", F.col("docs"), " documents, codes repaired: ", F.col("repaired"))))
    out = out.unionByName(checked.select(*_line(2, _text("cross-check: ", F.col("n"), " verified, ", F.col("bad"), " mismatches"))))
    bad = checks.where("NOT ok").orderBy("doc_id", "rec_seq").limit(mismatches)
    out = out.unionByName(bad.select(*_line(3, _text(F.col("doc_id"), " ", F.col("ORD_NO"), ": calculated ", F.col("calc"), ", amount ", F.col("amount")), F.col("doc_id"), F.col("rec_seq"))))
    some = run["problems"].orderBy("doc_id", "page", "row_idx", "problem").limit(problems)
    out = out.unionByName(some.select(*_line(4, _text(F.col("doc_id"), " page ", F.col("page"), " row ", F.col("row_idx"), ": ", F.col("problem")), F.col("doc_id"), F.col("page") * 100_000 + F.col("row_idx"), F.col("problem"))))
    if "failed" in run:
        out = out.unionByName(run["failed"].select(*_line(5, _text(F.col("doc_id"), " failed: ", F.col("error")), F.col("doc_id"), 0, F.col("error"))))
    for section, name, word in ((6, "skipped", "skipped"), (7, "blank", "columns left blank")):
        if name in run:
            out = out.unionByName(run[name].select(*_line(section, _text(F.col("doc_id"), " page ", F.col("page"), f": {word}"), F.col("doc_id"), F.col("page"))))
    return out


def batch_report(files: DataFrame) -> DataFrame:
    """One line a file (doc_id, records, verified, mismatches, agreed, mapping) and the totals of the batch."""
    agreed = F.when(F.col("agreed").isNull(), "n/a").when(F.col("agreed"), "yes").otherwise("no")
    rows = files.select(*_line(1, _text(F.col("doc_id"), ": ", F.col("records"), " records, ", F.col("verified"), " verified, ", F.col("mismatches"), " mismatches, headers agree: ", agreed), F.col("doc_id")))
    t = E.batch_totals(files)
    heads = [
        _text("files: ", F.col("files")), _text("records: ", F.coalesce("records", F.lit(0))), _text("verified: ", F.coalesce("verified", F.lit(0)), " of ", F.coalesce("records", F.lit(0))),
        _text("mismatches: ", F.coalesce("mismatches", F.lit(0))), _text("headers agree: ", F.col("agreed"), " of ", F.col("files")), _text("different mappings: ", F.col("mappings")),
    ]
    return rows.unionByName(t.select(F.posexplode(F.array(*heads)).alias("k", "line")).select(*_line(2, F.col("line"), F.col("k"))))


def write_lines(report: DataFrame, path: str) -> None:
    """The lines in order as text; a report's path is new, so no earlier one is lost."""
    report.orderBy(*ORDER).select("line").write.mode("errorifexists").text(path)


def write_batch(files: DataFrame, out_dir: str, model: str) -> tuple[str, str, str]:
    """The batch summary as text, its totals and its files as JSON; replaced by each run of a model."""
    name = model.replace(":", "_")
    paths = tuple(f"{out_dir}/{kind}.{name}.{end}" for kind, end in (("summary", "txt"), ("summary", "json"), ("files", "json")))
    batch_report(files).orderBy(*ORDER).select("line").write.mode("overwrite").text(paths[0])
    E.batch_totals(files).select(F.lit(model).alias("model"), "*").write.mode("overwrite").json(paths[1])
    files.write.mode("overwrite").json(paths[2])
    return paths
