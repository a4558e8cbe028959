"""Layout and content rules over batches of documents, against the same rules as expressions."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge import queries as orders
from spanforge.operators import bulk as K
from spanforge.operators import layout as L
from spanforge.operators import matching as M
from spanforge.sources import builders as B

SF = "/root/testdata/sf0.001"
WORDS = ("6AB1", "6", "12", "1,200.50", ".5", "5.", "-3", "+4", "1e3", "2d", "NaN", "-inf", "0x1p3", "abc", "料號", "2026/03/27", "20260327", "113-3-7", '44"', '7"', "----", " ----- ", "-" * 51, "x" * 13, "YD", "10", "20", "200")


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture(scope="module")
def odd(spark):
    rng, rows = random.Random(3), []
    for doc in range(120):
        for page in range(1, rng.choice((2, 2, 4))):
            for k in range(rng.choice((1, 3, 30, 60))):
                rows.append((doc, page, k, rng.choice((80, 88, 94, 107, 108, 109, 110, 112, 132, 157, 802)), rng.choice((5, 21, 30, 66, 96, 340, 350, 503)), rng.choice(WORDS)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, page int, span_seq int, y int, x int, text string").repartition(3).localCheckpoint()


def same(a, b):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a, b = (sorted(map(tuple, df.collect()), key=key) for df in (a, b))
    assert a == b and a


def test_columns_of_odd_pages_are_classified_alike(small_batches, odd):
    same(K.classify_columns(K.contiguous(odd)), M.classify_columns(L.grid(odd)))


def test_columns_of_orders_are_classified_alike(small_batches):
    raw = B.raw_orders(small_batches, SF).where("doc_id < 400")
    blank = raw.withColumns({"unit": F.when(F.col("rec_seq") != 2, F.col("unit")), "descr": F.when(F.col("rec_seq") == 1, "  ").otherwise(F.col("descr"))})
    for rows in (raw, blank):
        same(K.classify_columns(rows, B.row_spans), M.classify_columns(L.grid(B.spans(rows).where("text IS NOT NULL"))))


def test_columns_of_orders_are_classified_in_one_pass(spark):
    plan = orders.classify_columns(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and plan.count("Exchange hashpartitioning(") == 1


def test_rows_of_an_order_lie_together_by_a_shuffled_join(spark, monkeypatch):
    def kept(rows):
        doc = [r[0] for r in rows.select("doc_id", "rec_seq").collect()]
        return 1 + sum(a != b for a, b in zip(doc, doc[1:], strict=False)) == len(set(doc))

    got = B.raw_orders(spark, SF)
    monkeypatch.setattr(B, "BROADCAST_ROWS", 0)
    shuffled = B.raw_orders(spark, SF)
    assert kept(got) and kept(shuffled)
    same(got, shuffled)


GOOD = '{"mapping": ["ORD_NO","料號","MATM_DESC","WIDE","QTY","UNIT","PRICE",null,"NEED_DATE","NEED_CUST"]}'


def test_proposals_agree_as_by_parse_and_vote(spark):
    short, bad, odd, twice = '{"mapping": ["ORD_NO", " n/a ", "QTY"]}', "no", '{"mapping": ["ORD_NO", "what"]}', '{"mapping": ["QTY", "數量"]}'
    said = {1: [GOOD] * 3, 2: [GOOD, GOOD, short], 3: [GOOD, bad], 4: [short], 5: [odd], 6: [twice], 7: [None], 8: ['{"mapping": null}'], 9: [GOOD, GOOD.replace('"UNIT"', "null")]}
    rows = spark.createDataFrame([(d, i, r) for d, raws in said.items() for i, r in enumerate(raws)], "doc_id long, run int, raw string")
    assert {r.doc_id: len(r.mapping) for r in M.agreed(rows).collect()} == {1: 10, 4: 3}
    errors = {(r.doc_id, r.run): r.error for r in rows.select("doc_id", "run", M.parse_mapping(F.col("raw"), F.lit(10))["error"].alias("error")).collect()}
    assert errors[(1, 0)] is None and [errors[(d, 0)] for d in (3, 4, 5, 6, 7, 8)] == [None, "length", "length", "length", "no JSON", "no mapping"] and errors[(3, 1)] == "no JSON"
    free = {r.doc_id: r.error for r in rows.where("run = 0").select("doc_id", M.parse_mapping(F.col("raw"), None)["error"].alias("error")).collect()}
    assert free[5] == "unknown field" and free[6] == "duplicate"


def test_columns_of_odd_pages_are_counted_alike(small_batches, odd):
    same(K.page_columns(K.contiguous(odd)), L.tables(odd).select("doc_id", "page", F.size("lefts")))


def test_proposals_are_applied_in_one_pass(spark):
    df = orders.extract_by_proposal(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 2  # order rows, and their numbers for the answers
