import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanforge import queries as orders

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(orders.ORACLES))
def test_query_equals_sql(spark, db, name):
    df = orders.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = db.execute(orders.ORACLES[name])
    have = [d[0] for d in r.description]
    assert cols == sorted(have)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got = sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=key)
    want = sorted((tuple(plain(x[have.index(c)]) for c in cols) for x in r.fetchall()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(orders.QUERIES) - set(orders.ORACLES)))
def test_query_runs(spark, name):
    assert orders.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_masked_orders_pass_their_audit(spark):
    rows = {r["column"]: r for r in orders.anonymize_audit(spark, SF).collect()}
    assert all(r["same_lengths"] for c, r in rows.items() if c in ("ord_no", "part_no", "qty", "price", "unit", "need_date"))
    assert all(r["leaks"] == 0 for r in rows.values())


def test_audit_of_masks_moves_each_order_once(spark):
    raw = orders._raw(spark, SF)
    got, want = (sorted(map(tuple, df.collect())) for df in (orders.anonymize_audit(spark, SF), orders.N.audit(raw, orders.N.anonymize(raw), orders._AUDITED)))
    assert got == want and len(got) == 10
    plan = orders.anonymize_audit(spark, SF)._jdf.queryExecution().sparkPlan().toString() + orders.anonymize_audit(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") <= 5


def test_rows_without_a_part_are_audited_as_in_sql(spark):
    raw = orders._raw(spark, SF).withColumn("part_no", F.when(F.col("rec_seq") != 2, F.col("part_no")))
    got = sorted(map(tuple, orders.N.audit_masks(raw, orders._AUDITED).collect()))
    assert got == sorted(map(tuple, orders.N.audit(raw, orders.N.anonymize(raw), orders._AUDITED).collect()))
    assert orders.N.anonymize(raw).where("part_no IS NULL").count() == 0
