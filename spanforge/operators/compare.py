"""Keyed comparison of record sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge import schema as S
from spanforge.functions import scalar as C

KEY = ("doc_id", "ORD_NO")


def last_records(records: DataFrame, order: str = "rec_seq") -> DataFrame:
    """One record a key: the last."""
    cols = [c for c in records.columns if c not in KEY]
    return records.groupBy(*KEY).agg(F.max_by(F.struct(*cols), order).alias("r")).select(*KEY, "r.*")


def _normal(df: DataFrame) -> DataFrame:
    # Numbers are rounded, so that text and number compare alike; other fields as text.
    text = lambda f: C.to_number(F.col(f), S.DIGITS[f]).cast("string") if f in S.DIGITS else C.to_text(F.col(f))
    return df.select(*KEY, F.array(*[text(f) for f in S.FIELDS if f != "ORD_NO"]).alias("v"))


def diff_cells(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """doc_id, ORD_NO, field, expected, actual of the cells that differ; both sides hold one record a key."""
    names = F.array(*[F.lit(f) for f in S.FIELDS if f != "ORD_NO"])
    both = _normal(expected).withColumnRenamed("v", "e").join(_normal(actual).withColumnRenamed("v", "a"), list(KEY))
    cells = both.select(*KEY, F.inline(F.arrays_zip(names.alias("field"), F.col("e").alias("expected"), F.col("a").alias("actual"))))
    return cells.where(~F.col("expected").eqNullSafe(F.col("actual")))


def missing_keys(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.select(*KEY).join(actual.select(*KEY), list(KEY), "left_anti").distinct()


def extra_keys(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return missing_keys(actual, expected)


def common_count(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.select(*KEY).join(actual.select(*KEY), list(KEY), "left_semi").agg(F.count("*").alias("common"))


def overall_accuracy(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """common, diffs, accuracy (0 without common keys), coverage of the expected keys."""
    n = common_count(expected, actual)
    d = diff_cells(expected, actual).agg(F.count("*").alias("diffs"))
    e = expected.agg(F.count("*").alias("wanted"))
    cells = F.col("common") * len(S.FIELDS)
    out = n.join(F.broadcast(d)).join(F.broadcast(e))  # three single rows
    return out.select("common", "diffs", F.when(cells == 0, 0.0).otherwise(F.round((cells - F.col("diffs")) / cells, 6)).alias("accuracy"), F.round(F.col("common") / F.greatest("wanted", F.lit(1)), 6).alias("coverage"))


def field_accuracy(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """field, errors, rate in percent (100 without common keys), all_wrong: twelve rows."""
    spark = expected.sparkSession
    fields = spark.range(1).select(F.explode(F.array(*[F.lit(f) for f in S.FIELDS])).alias("field"))
    e = diff_cells(expected, actual).groupBy("field").agg(F.count("*").alias("errors"))
    out = fields.join(e, "field", "left").join(F.broadcast(common_count(expected, actual)))
    n, wrong = F.col("common"), F.coalesce("errors", F.lit(0))
    return out.select("field", wrong.alias("errors"), F.when(n == 0, 100.0).otherwise(F.round(100.0 * (n - wrong) / n, 4)).alias("rate"), ((n > 0) & (wrong == n)).alias("all_wrong"))


def diff_shape_of() -> Column:
    """The kind of the difference between expected and actual."""
    return C.diff_shape(F.col("expected"), F.col("actual"))


def diff_shapes(diffs: DataFrame) -> DataFrame:
    """field, shape, n of the differing cells."""
    return diffs.groupBy("field", diff_shape_of().alias("shape")).agg(F.count("*").alias("n"))


def result_summary(expected: DataFrame, results: DataFrame) -> DataFrame:
    """file, n, missing, diffs, rate: every result file against one baseline, best first.

    results: records with a file column, one record a file and key.
    """
    e = _normal(expected).withColumnRenamed("v", "e")
    a = results.select("file", *KEY, F.array(*[C.to_number(F.col(f), S.DIGITS[f]).cast("string") if f in S.DIGITS else C.to_text(F.col(f)) for f in S.FIELDS if f != "ORD_NO"]).alias("v"))
    j = a.join(e, list(KEY), "left")
    wrong = F.size(F.filter(F.zip_with("e", "v", lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
    s = j.groupBy("file").agg(F.count("*").alias("n"), F.count("e").alias("common"), F.sum(F.when(F.col("e").isNotNull(), wrong)).alias("diffs"))
    total = expected.agg(F.count("*").alias("wanted"))
    cells = F.col("common") * len(S.FIELDS)
    out = s.join(F.broadcast(total)).select("file", "n", (F.col("wanted") - F.col("common")).alias("missing"), F.coalesce("diffs", F.lit(0)).cast("long").alias("diffs"), F.when(cells == 0, 0.0).otherwise(F.round(100.0 * (cells - F.col("diffs")) / cells, 4)).alias("rate"))
    return out.orderBy(F.desc("rate"), "file")
