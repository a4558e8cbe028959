"""Typed order records: mapping, repair, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge import schema as S
from spanforge.functions import scalar as C

#: raw_orders cells of each imported field.
CELL_OF = {"ORD_NO": "ord_no", "MATM_NAME": "part_no", "MATM_DESC": "descr", "WIDE": "width", "QTY": "qty", "UNIT": "unit", "PRICE": "price", "NEED_DATE": "need_date", "NEED_CUST": "cust"}


def empty_record() -> dict[str, Column]:
    """A record of a document that told nothing: no numbers, empty texts."""
    return {f: F.lit(None).cast("double") if f in S.DIGITS else F.lit("") for f in S.FIELDS}


def from_raw(raw: DataFrame, keep: tuple[str, ...] = ("doc_id", "rec_seq")) -> DataFrame:
    """Twelve typed fields from one cell each; a narrow projection."""
    return raw.select(*keep, *[C.coerce(f, F.col(c)).alias(f) for f, c in CELL_OF.items()], *[empty_record()[f].alias(f) for f in S.BLANK_FIELDS])


def apply_mapping(rows: DataFrame, keep: tuple[str, ...] = ("doc_id", "rec_seq")) -> DataFrame:
    """Records from long rows (keep..., ord, key, value): of equal fields the last ord wins."""
    # The field is resolved once a cell; rows of keys without any field fall out afterwards, as a
    # filter before the aggregate would resolve every header again.
    cells = rows.select(*keep, "ord", C.resolve_field(F.col("key")).alias("field"), "value")
    last = cells.groupBy(*keep).agg(F.count("field").alias("known"), *[F.max_by("value", F.when(F.col("field") == f, F.col("ord"))).alias(f) for f in S.IMPORTED]).where("known > 0")
    return typed(last, keep)


def typed(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Records of rows (keep..., a text of each imported field)."""
    return rows.select(*keep, *[C.coerce(f, F.col(f)).alias(f) for f in S.IMPORTED], *[empty_record()[f].alias(f) for f in S.BLANK_FIELDS])


def ignored_headers(rows: DataFrame) -> DataFrame:
    """doc_id, ignored: distinct headers that are not imported."""
    return rows.where(C.header_ignored(F.col("key")) & ~F.col("key").isin(*S.FIELDS)).groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias("ignored"))


def repair(records: DataFrame) -> DataFrame:
    """Colour codes repaired, with a changed flag."""
    return records.withColumn("changed", C.code_changed(F.col("MATM_DESC"))).withColumn("MATM_DESC", C.repair_code(F.col("MATM_DESC")))


def repair_count(records: DataFrame) -> DataFrame:
    """repaired: how many records repair() changes."""
    return records.agg(F.count_if(C.code_changed(F.col("MATM_DESC"))).alias("repaired"))


def validate(records: DataFrame, keep: tuple[str, ...] = ("doc_id", "rec_seq")) -> DataFrame:
    """keep..., problem: one row per fault."""
    faults = F.array_compact(F.array(F.when(F.col("ORD_NO") == "", "no order number"), F.when(F.col("QTY").isNull(), "no quantity")))
    return records.select(*keep, F.explode(faults).alias("problem"))


def validate_envelopes(envelopes: DataFrame) -> DataFrame:
    """file, row (from 1, null for the whole), problem of result envelopes (file, raw: JSON text)."""
    kind = "success boolean, recordCount int, data array<map<string,string>>"
    e = envelopes.select("file", F.from_json("raw", kind).alias("e"), F.try_parse_json("raw").isNotNull().alias("is_json"))
    data = F.col("e.data")
    whole = F.array_compact(F.array(
        F.when(~F.col("is_json"), "no JSON").when(data.isNull(), "no data"), F.when(data.isNotNull() & ~F.col("e.recordCount").eqNullSafe(F.size(data)), "record count"), F.when(F.size(data) == 0, "empty"),
    ))
    blank = lambda r, f: F.coalesce(C.to_text(F.try_element_at(r, F.lit(f))), F.lit("")) == ""
    lacking = lambda r: F.filter(F.array(*[F.lit(f) for f in S.FIELDS]), lambda f: ~F.map_contains_key(r, f))
    faults = lambda r: F.when(r.isNull(), F.array(F.lit("no object"))).otherwise(F.array_compact(F.array(
        F.when(blank(r, "ORD_NO"), "no order number"), F.when(F.try_element_at(r, F.lit("QTY")).isNull(), "no quantity"),
        F.when(F.size(lacking(r)) > 0, F.concat(F.lit("lacks "), F.array_join(lacking(r), ","))),
    )))
    rows = F.flatten(F.transform(data, lambda r, i: F.transform(faults(r), lambda p: F.struct((i + 1).alias("row"), p.alias("problem")))))
    every = F.concat(F.transform(whole, lambda p: F.struct(F.lit(None).cast("int").alias("row"), p.alias("problem"))), F.coalesce(rows, F.array().cast("array<struct<row:int,problem:string>>")))
    return e.select("file", F.inline(every))


def product(qty: Column, price: Column) -> Column:
    """The value of a line to two places, multiplied exactly."""
    return F.round(qty.cast("decimal(16,2)") * price.cast("decimal(16,3)"), 2).cast("double")


def amounts(raw: DataFrame) -> DataFrame:
    """doc_id, ORD_NO, amount_text: the amount cell by order number, the last of equals."""
    return raw.where("ord_no <> ''").groupBy("doc_id", F.col("ord_no").alias("ORD_NO")).agg(F.max_by("amount", "rec_seq").alias("amount_text"))


def cross_check(records: DataFrame, amount: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """doc_id, rec_seq, ORD_NO, calc, amount, ok of the records that have all three numbers."""
    both = records.join(amount, ["doc_id", "ORD_NO"], "left").withColumn("amount", C.to_number(F.col("amount_text"), 2))
    both = both.where("QTY IS NOT NULL AND PRICE IS NOT NULL AND amount IS NOT NULL").withColumn("calc", product(F.col("QTY"), F.col("PRICE")))
    return both.select("doc_id", "rec_seq", "ORD_NO", "calc", "amount", (F.abs(F.col("calc") - F.col("amount")) <= tolerance).alias("ok"))
