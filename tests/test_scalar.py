import pytest
from pyspark.sql import functions as F

from spanforge.functions import loose_json as J
from spanforge.functions import scalar as C


def one(spark, rule, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", rule(F.col("v")).alias("x")).orderBy("i").collect()]


def test_dates(spark):
    given = ["2026/03/27", "2026-03-27", "20260327", "113/03/27", "113-03-27", "", "junk", None, "2026.3.7", "2026/02/31", "99/01/01", "2026/13/01", "00000000"]
    assert one(spark, C.to_date, given) == ["20260327"] * 3 + ["20240327"] * 2 + ["", "", "", "20260307", "20260231", "", "", "00000000"]


def test_numbers(spark):
    given = ["1,460.0", "73.00", "  820.0 ", "", "pieces", None, "NT$73.00", "-", "1.2.3", "1，000", "-5", "12kg"]
    assert one(spark, lambda c: C.to_number(c, 2), given) == [1460.0, 73.0, 820.0, None, None, None, 73.0, None, None, 1000.0, -5.0, 12.0]


def test_width_and_units(spark):
    assert one(spark, C.to_width, ['44"', "", None, "４４x5"]) == ["44", "", "", "４４5"]
    assert one(spark, C.to_unit, ["碼", "y d", "Y-2", "米", "个", "box", "", None]) == ["YD", "YD", "Y2", "M", "PC", "box", "", ""]


def test_headers(spark):
    assert one(spark, C.header_field, ["訂購單號", "Total Qty", "Unit Price", "料 號", "材料名稱／顏色代碼", "ship-date", "x", None]) == ["ORD_NO", None, "PRICE", "MATM_NAME", "MATM_DESC", "NEED_DATE", None, None]
    assert one(spark, C.header_candidates, ["訂購單號料 號", "none"]) == [["ORD_NO", "MATM_NAME"], []]


@pytest.mark.parametrize(("text", "want", "changed"), [("OAV x/(0AV)", "0AV x/(0AV)", True), ("0AV x/(OAV)", "0AV x/(OAV)", True), ("0AV x/(0AV)", "0AV x/(0AV)", False), ("OAV x/(0AB)", "OAV x/(0AB)", False), ("plain", "plain", False), (None, None, False), ("", "", False)])
def test_code_repair(spark, text, want, changed):
    assert one(spark, C.repair_code, [text]) == [want]
    assert one(spark, C.code_changed, [text]) == [changed]


def test_loose_json():
    assert J.parse('```json\n{"a": [1, 2,],}\n```') == ({"a": [1, 2]}, None)
    assert J.parse('so: {"a": "x } \\" {"} done') == ({"a": 'x } " {'}, None)
    assert J.parse("nothing")[0] is None
    assert J.rows_of({"rows": [{"x": 1}, " 7 "]}) == [{"x": 1}, {"ORD_NO": "7"}]
    assert J.rows_of([]) == [] and J.rows_of(3) is None


def test_shapes_and_width(spark):
    pairs = spark.createDataFrame([("0AV", "OAV"), ("1,000", "1000"), ("a1", "b 1"), ("x", ""), ("a1", "cd2")], "e string, a string")
    assert [r[0] for r in pairs.select(C.diff_shape(F.col("e"), F.col("a"))).collect()] == ["same length", "separators", "same digits", "one side empty", "other"]
    assert pairs.select(C.diff_marks(F.lit("0AV"), F.lit("OAV")).alias("m")).first()[0] == "^  "
    assert one(spark, C.display_width, ["abc", "數量", "Ａ"]) == [3, 4, 2]
