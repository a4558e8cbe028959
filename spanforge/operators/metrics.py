"""Scores of answers and summaries of experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import scalar as C


def _hits(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda h: h))


def mapping_score(answer: Column, truth: Column) -> Column:
    """Share of right columns; 0 where lengths differ."""
    return F.when(answer.isNull() | (F.size(answer) != F.size(truth)) | (F.size(truth) == 0), 0.0).otherwise(_hits(answer, truth) / F.size(truth))


def wrong_columns(answer: Column, truth: Column) -> Column:
    """Positions that are not right; empty where lengths differ, as no position can be told then."""
    found = F.filter(F.transform(F.zip_with(answer, truth, lambda x, y: ~x.eqNullSafe(y)), lambda d, i: F.when(d, i)), lambda i: i.isNotNull())
    return F.when(answer.isNull() | (F.size(answer) != F.size(truth)), F.array().cast("array<int>")).otherwise(found)


def mapping_scores(answer: Column, truth: Column) -> Column:
    """struct(strict, normal): as said, and with null words and headers resolved."""
    plain = F.transform(answer, lambda x: C.answer_field(x))
    return F.struct(mapping_score(answer, truth).alias("strict"), mapping_score(plain, truth).alias("normal"))


def bounds_score(top: Column, bottom: Column, true_top: Column, true_bottom: Column) -> Column:
    dt, db = F.abs(top - true_top), F.abs(bottom - true_bottom)
    return F.when(top.isNull() | bottom.isNull(), 0.0).when((dt == 0) & (db == 0), 1.0).when((dt <= 10) & (db <= 10), 0.8).otherwise(0.3)


def range_f1(first: Column, last: Column, true_first: Column, true_last: Column) -> Column:
    """F1 of two inclusive ranges of rows."""
    size = lambda a, b: F.greatest(F.lit(0), b - a + 1)
    both = size(F.greatest(first, true_first), F.least(last, true_last))
    total = size(first, last) + size(true_first, true_last)
    return F.when(first.isNull() | last.isNull(), 0.0).when(total == 0, 1.0).otherwise(2.0 * both / total)


def edges_score(answer: Column, truth: Column) -> Column:
    """1 if exact, 0.7 within 2 points, else less by the summed distance; 0 where counts differ."""
    d = F.zip_with(answer, truth, lambda x, y: F.abs(x - y))
    total = F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x)
    return (
        F.when(answer.isNull() | (F.size(answer) != F.size(truth)), 0.0).when(total == 0, 1.0).when(F.array_max(d) <= 2, 0.7).otherwise(F.greatest(F.lit(0.0), 1.0 - total / 200.0))
    )


def end_to_end(rate: Column, n: Column, wanted: Column) -> Column:
    return rate / 100.0 * n / wanted


def lenient_pass(right: Column, n: Column) -> Column:
    return right >= F.floor(n / 2)


def run_summary(runs: DataFrame, by: str = "case_id") -> DataFrame:
    """Repeated runs (by, run, score, raw, elapsed): spread, failures, distinct answers, verdict."""
    out = runs.groupBy(by).agg(
        F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"), F.count_if(F.col("score") == 0).alias("failures"),
        F.countDistinct("raw").alias("answers"), F.round(F.avg("elapsed"), 6).alias("mean_s"), F.round(F.sum("elapsed"), 6).alias("total_s"),
    )
    verdict = F.when((F.col("mean") >= 0.95) & (F.col("answers") == 1), "usable").when(F.col("mean") >= 0.8, "with checks").otherwise("unusable")
    return out.withColumn("verdict", verdict)


def arm_summary(runs: DataFrame) -> DataFrame:
    """Arms over clean cases: exact cases, mean score and tokens, violations of first runs."""
    per = runs.where("NOT contaminated").groupBy("arm", "case_id").agg(F.bool_and(F.col("score") == 1.0).alias("exact"), F.avg("score").alias("s"), F.avg("tokens").alias("t"), F.min_by("violations", "run").alias("v"))
    return per.groupBy("arm").agg(F.count_if("exact").alias("exact"), F.count("*").alias("cases"), F.round(F.avg("s"), 6).alias("score"), F.round(F.avg("t"), 4).alias("tokens"), F.count_if(F.col("v") > 0).alias("violations"))


def batch_totals(files: DataFrame) -> DataFrame:
    """One row over files (records, verified, mismatches, agreed, mapping)."""
    return files.agg(F.count("*").alias("files"), F.sum("records").alias("records"), F.sum("verified").alias("verified"), F.sum("mismatches").alias("mismatches"), F.count_if("agreed").alias("agreed"), F.countDistinct("mapping").alias("mappings"))


def untrusted(files: DataFrame) -> DataFrame:
    """Files whose cross-check failed or did not cover every record."""
    return files.where(~((F.col("mismatches") == 0) & (F.col("verified") == F.col("records"))))
