"""Queries of the order engine over the star-schema tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge import schema as S
from spanforge.functions import loose_json as J
from spanforge.functions import scalar as C
from spanforge.operators import anonymize as N
from spanforge.operators import bulk as K
from spanforge.operators import compare as A
from spanforge.operators import layout as L
from spanforge.operators import matching as M
from spanforge.operators import metrics as E
from spanforge.operators import prompts as Q
from spanforge.operators import records as R
from spanforge.operators import report as T
from spanforge.sources import builders as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _list(words, quote="'") -> str:
    return "[" + ", ".join("NULL" if w is None else quote + str(w) + quote for w in words) + "]"


# --- DuckDB forms of the sources -------------------------------------------------------
RAW = """
WITH RECURSIVE line AS (
  SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate)::INT AS rec_seq,
    l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity::BIGINT * (1 + 37 * l_linenumber) AS q, round(l_extendedprice * 10 / l_quantity)::BIGINT AS milli,
    substr('ABCDEFGHJK', (l_partkey % 10 + 1)::INT, 1) || 'V' AS letters FROM lineitem),
raw AS (
  SELECT doc_id, rec_seq, CASE WHEN doc_id % 17 = 0 THEN 'X' ELSE '6' END || letters || doc_id || '-' || l_linenumber AS ord_no, 'P' || l_partkey AS part_no,
    CASE WHEN l_partkey % 3 = 1 THEN 'O' ELSE '0' END || letters || ' ' || coalesce(p_name, '') || '/(' || CASE WHEN l_partkey % 4 = 1 THEN 'O' ELSE '0' END || letters || ')' AS descr,
    coalesce(p_size, 0) || '"' AS width, format('{:,.1f}', q::DOUBLE) AS qty, ['碼', 'Y-2', '公尺', 'kg', '個', 'BOX'][(l_suppkey % 6 + 1)::INT] AS unit,
    (milli // 1000) || '.' || lpad((milli % 1000)::VARCHAR, 3, '0') AS price,
    format('{:,}', (q * milli + 500) // 1000 + CASE WHEN l_partkey % 17 = 0 THEN 5 ELSE 0 END) AS amount,
    CASE l_linenumber % 5 WHEN 0 THEN strftime(l_shipdate, '%Y/%m/%d') WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 2 THEN strftime(l_shipdate, '%Y%m%d')
      WHEN 3 THEN (year(l_shipdate) - 1911) || '/' || strftime(l_shipdate, '%m/%d') ELSE 'soon' END AS need_date,
    'C' || (l_suppkey % 40) AS cust
  FROM line LEFT JOIN part ON l_partkey = p_partkey)
"""


def _num(c: str, digits: int) -> str:
    return f"round(try_cast(regexp_replace(regexp_replace(replace({c}, ',', ''), '^[^0-9.\\-]+', ''), '[^0-9.]+$', '') AS DOUBLE), {digits})"


def _date(c: str) -> str:
    p = r"^(\d{3,4})[/-](\d{1,2})[/-](\d{1,2})$"
    y = f"try_cast(regexp_extract(replace({c}, '.', '/'), '{p}', 1) AS INT)"
    m, d = (f"try_cast(regexp_extract(replace({c}, '.', '/'), '{p}', {k}) AS INT)" for k in (2, 3))
    return (
        f"CASE WHEN regexp_full_match({c}, '[0-9]{{8}}') THEN {c} WHEN {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31"
        f" THEN lpad((CASE WHEN {y} < 1911 THEN {y} + 1911 ELSE {y} END)::VARCHAR, 4, '0') || lpad({m}::VARCHAR, 2, '0') || lpad({d}::VARCHAR, 2, '0') ELSE '' END"
    )


def _unit(c: str) -> str:
    table = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in S.UNITS.items()) + "}"
    return f"coalesce({table}[upper(replace({c}, ' ', ''))], {c})"


REC = RAW + f""", rec AS (
  SELECT doc_id, rec_seq, ord_no AS ORD_NO, part_no AS MATM_NAME, descr AS MATM_DESC, regexp_replace(width, '[^0-9]', '', 'g') AS WIDE, {_num('qty', 2)} AS QTY,
    {_unit('unit')} AS UNIT, {_num('price', 3)} AS PRICE, {_date('need_date')} AS NEED_DATE, cust AS NEED_CUST, '' AS BRAND_NO, '' AS CUST_NO, '' AS CONTACT_NO FROM raw)
"""
#: A golden side and a disturbed one: keys dropped, added, flipped, blanked.
SIDES = REC + """, expected AS (SELECT * FROM rec WHERE doc_id % 50 <> 3 QUALIFY row_number() OVER (PARTITION BY doc_id, ORD_NO ORDER BY rec_seq DESC) = 1),
actual AS (SELECT doc_id, rec_seq, ORD_NO, MATM_NAME, CASE WHEN doc_id % 6 = 1 THEN 'O' || substr(MATM_DESC, 2) ELSE MATM_DESC END AS MATM_DESC, WIDE,
  CASE WHEN doc_id % 9 = 4 THEN QTY + 1 ELSE QTY END AS QTY, UNIT, CASE WHEN doc_id % 21 = 5 THEN NULL ELSE PRICE END AS PRICE, CASE WHEN doc_id % 8 = 2 THEN '' ELSE NEED_DATE END AS NEED_DATE,
  NEED_CUST, BRAND_NO, CUST_NO, CONTACT_NO
  FROM rec WHERE doc_id % 40 <> 7 QUALIFY row_number() OVER (PARTITION BY doc_id, ORD_NO ORDER BY rec_seq DESC) = 1)
"""
_TEXTS = [f for f in S.FIELDS if f not in ("ORD_NO", "QTY", "PRICE")]
DIFFS = SIDES + ", diffs AS (" + " UNION ALL ".join(
    f"SELECT e.doc_id, e.ORD_NO, '{f}' AS field, e.{f}{x} AS expected, a.{f}{x} AS actual FROM expected e JOIN actual a ON e.doc_id = a.doc_id AND e.ORD_NO = a.ORD_NO WHERE e.{f} IS DISTINCT FROM a.{f}"
    for f, x in [(f, "") for f in _TEXTS] + [("QTY", "::VARCHAR"), ("PRICE", "::VARCHAR")]
) + ")"
SPANS = RAW + f""", body AS (
  SELECT doc_id, ((rec_seq - 1) // {B.PAGE_ROWS} + 1)::INT AS page, (rec_seq - 1) % {B.PAGE_ROWS} AS r, * EXCLUDE (doc_id) FROM raw),
fixed(span_seq, y, x, text, m) AS (VALUES {', '.join([f"({k}, {B.HEADER_Y}, {B.LEFTS[k]}, '{B.HEADERS[k]}', 13)" for k in range(10)] + [f"({20 + k}, {B.RULE_Y}, {B.LEFTS[k]}, '------', 11)" for k in range(10)] + [f"(40, {B.FOOTER_Y}, 21, '{'-' * 60}', 7)"])}),
spans AS (
  {' UNION ALL '.join(f"SELECT doc_id, page, r * 10 + 100 + {k} AS span_seq, {B.FIRST_Y} + {B.PITCH} * r + {k % 2} AS y, {B.DATA_X[k]}{f' - length({B.CELLS[k]})' if k in B.RIGHT_ALIGNED else ''} AS x, {B.CELLS[k]} AS text FROM body" for k in range(10))}
  UNION ALL SELECT doc_id, page, span_seq, y, x, text FROM (SELECT DISTINCT doc_id, page FROM body), fixed WHERE (doc_id % m <> 0 OR (doc_id % 17 = 0 AND m = 11)) AND NOT (doc_id % 13 = 0 AND m = 11)),
ruled AS (SELECT *, regexp_full_match(trim(text), '-{{4,}}') AS rule FROM spans),
tops AS (SELECT doc_id, page, min(y) FILTER (text LIKE '6%') AS one, max(y) AS low FROM ruled GROUP BY ALL),
often AS (SELECT doc_id, page, min(y) AS two FROM (SELECT doc_id, page, x, min(y) AS y FROM ruled WHERE NOT rule GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL),
bounds AS (
  SELECT t.doc_id, t.page, coalesce(one, two)::INT AS top, coalesce((SELECT min(y) - 3 FROM ruled r WHERE r.doc_id = t.doc_id AND r.page = t.page AND r.rule AND length(r.text) > 50 AND r.y > coalesce(one, two)), low)::INT AS bottom
  FROM tops t LEFT JOIN often USING (doc_id, page) WHERE coalesce(one, two) IS NOT NULL),
edge1 AS (SELECT DISTINCT doc_id, page, x FROM ruled JOIN bounds USING (doc_id, page) WHERE rule AND y < top),
edge2 AS (SELECT DISTINCT doc_id, page, x FROM ruled JOIN bounds USING (doc_id, page) WHERE y < top AND y > top - 60 AND length(text) <= 12),
xs AS (SELECT DISTINCT doc_id, page, x FROM ruled JOIN bounds b USING (doc_id, page) WHERE NOT rule AND y >= top AND y < bottom
  AND NOT EXISTS (SELECT 1 FROM edge1 e WHERE e.doc_id = b.doc_id AND e.page = b.page) AND NOT EXISTS (SELECT 1 FROM edge2 e WHERE e.doc_id = b.doc_id AND e.page = b.page)),
edge3 AS (SELECT doc_id, page, min(x) AS x, 1 AS k FROM xs GROUP BY ALL
  UNION ALL SELECT e.doc_id, e.page, min(xs.x), k + 1 FROM edge3 e JOIN xs ON xs.doc_id = e.doc_id AND xs.page = e.page AND xs.x > e.x + 20 WHERE k < 10 GROUP BY e.doc_id, e.page, k),
edges AS (SELECT doc_id, page, x, 1 AS tier FROM edge1 UNION ALL SELECT doc_id, page, x, 2 FROM edge2 WHERE (doc_id, page) NOT IN (SELECT doc_id, page FROM edge1) UNION ALL SELECT doc_id, page, x, 3 FROM edge3),
lefts AS (SELECT doc_id, page, min(tier) AS tier, list_sort(list(x::INT)) AS lefts FROM edges GROUP BY ALL),
inner_spans AS (SELECT doc_id, page, span_seq, y, x, text, lefts FROM ruled JOIN bounds USING (doc_id, page) JOIN lefts USING (doc_id, page) WHERE NOT rule AND y >= top - 5 AND y < bottom),
ys AS (SELECT DISTINCT doc_id, page, y FROM inner_spans),
anchors AS (SELECT doc_id, page, min(y) AS y, 0 AS row_idx FROM ys GROUP BY ALL
  UNION ALL SELECT a.doc_id, a.page, min(ys.y), row_idx + 1 FROM anchors a JOIN ys ON ys.doc_id = a.doc_id AND ys.page = a.page AND ys.y > a.y + 2 GROUP BY a.doc_id, a.page, row_idx),
cells AS (SELECT s.doc_id, s.page, a.row_idx, greatest(0, len(list_filter(lefts, lambda e: e <= s.x)) - 1) AS col_idx, s.y, s.x, s.text, s.span_seq
  FROM inner_spans s ASOF JOIN anchors a ON s.doc_id = a.doc_id AND s.page = a.page AND s.y >= a.y),
grid AS (SELECT doc_id, page, row_idx, col_idx, string_agg(text, '' ORDER BY y, x, text) AS value FROM cells GROUP BY ALL)
"""


# --- Spark forms -----------------------------------------------------------------------
def _raw(spark, d):
    return B.raw_orders(spark, d)


def _rec(spark, d):
    return R.from_raw(_raw(spark, d))


def _spans(spark, d):
    return B.spans(_raw(spark, d))


def _sides(spark, d):
    rec = _rec(spark, d)
    i = F.col("doc_id")
    act = rec.where(i % 40 != 7).withColumns({"MATM_DESC": F.when(i % 6 == 1, F.concat(F.lit("O"), F.substring("MATM_DESC", 2, 1000))).otherwise(F.col("MATM_DESC")), "QTY": F.when(i % 9 == 4, F.col("QTY") + 1).otherwise(F.col("QTY")), "PRICE": F.when(i % 21 != 5, F.col("PRICE")), "NEED_DATE": F.when(i % 8 == 2, "").otherwise(F.col("NEED_DATE"))})
    return A.last_records(rec.where(i % 50 != 3)), A.last_records(act)


@query(REC + "SELECT NEED_CUST AS cust, substr(NEED_DATE, 1, 6) AS month, count(*) AS n, round(sum(round(QTY::DECIMAL(16,2) * PRICE::DECIMAL(16,3), 2)), 2)::DOUBLE AS revenue FROM rec WHERE ORD_NO <> '' AND QTY IS NOT NULL GROUP BY ALL")
def revenue_by_customer(spark, d):
    rec = _rec(spark, d).where("ORD_NO <> '' AND QTY IS NOT NULL")
    return rec.groupBy(F.col("NEED_CUST").alias("cust"), F.substring("NEED_DATE", 1, 6).alias("month")).agg(F.count("*").alias("n"), F.round(F.sum(R.product(F.col("QTY"), F.col("PRICE")).cast("decimal(24,2)")), 2).cast("double").alias("revenue"))


@query(RAW + f"SELECT doc_id, rec_seq, {_num('qty', 2)} AS qty, {_num('price', 3)} AS price, {_num('amount', 2)} AS amount, {_num('need_date', 2)} AS odd FROM raw")
def clean_number(spark, d):
    return _raw(spark, d).select("doc_id", "rec_seq", C.to_number(F.col("qty"), 2).alias("qty"), C.to_number(F.col("price"), 3).alias("price"), C.to_number(F.col("amount"), 2).alias("amount"), C.to_number(F.col("need_date"), 2).alias("odd"))


@query(RAW + f"SELECT doc_id, rec_seq, {_date('need_date')} AS day FROM raw")
def clean_date(spark, d):
    return _raw(spark, d).select("doc_id", "rec_seq", C.to_date(F.col("need_date")).alias("day"))


@query(RAW + "SELECT doc_id, rec_seq, regexp_replace(width, '[^0-9]', '', 'g') AS wide FROM raw")
def clean_width(spark, d):
    return _raw(spark, d).select("doc_id", "rec_seq", C.to_width(F.col("width")).alias("wide"))


@query(RAW + f"SELECT {_unit('unit')} AS code, count(*) AS n FROM raw GROUP BY ALL")
def map_unit(spark, d):
    return _raw(spark, d).groupBy(C.to_unit(F.col("unit")).alias("code")).agg(F.count("*").alias("n"))


#: Headers: the page's, fixed ones, and merged ones, spread over the parts table.
_HEADS = (*B.HEADERS, "Total Qty", "Unit Price", "ＰＯ／Number", "item_no", "Delivery-Date", "訂購單號料 號", "unknown", "Sub Company", "")
_KEY_SQL = "upper(regexp_replace(translate(h, '" + S.WIDE_ASCII.replace("'", "''") + "', '" + S.PLAIN_ASCII.replace("'", "''") + "'), '[\\s/\\\\|\\-_\u3000]', '', 'g'))"
HEADS = f"WITH heads AS (SELECT p_partkey AS id, {_list(_HEADS)}[(p_partkey % {len(_HEADS)} + 1)::INT] AS h FROM part), keyed AS (SELECT id, h, {_KEY_SQL} AS key FROM heads), alias(field, akey, ord) AS (VALUES {', '.join(str((f, k, i)) for f, k, i in S.ALIAS_KEYS)}) "


def _heads(spark, d):
    words = F.array(*[F.lit(h) for h in _HEADS])
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.element_at(words, (F.col("p_partkey") % len(_HEADS) + 1).cast("int")).alias("h"))


@query(HEADS + "SELECT id, key FROM keyed")
def normalize_header(spark, d):
    return _heads(spark, d).select("id", C.header_key(F.col("h")).alias("key"))


@query(HEADS + f"SELECT id, CASE WHEN len(list_filter({_list(S.IGNORED_KEYS)}, lambda w: contains(key, w))) > 0 THEN NULL ELSE (SELECT arg_max(field, length(akey) * 1000 - ord) FROM alias WHERE contains(key, akey)) END AS field FROM keyed")
def match_header(spark, d):
    return _heads(spark, d).select("id", C.header_field(F.col("h")).alias("field"))


@query(HEADS + "SELECT id, coalesce((SELECT list(field ORDER BY n DESC, field DESC) FROM (SELECT field, max(length(akey)) AS n FROM alias WHERE contains(key, akey) GROUP BY field)), []) AS fields FROM keyed")
def header_candidates(spark, d):
    return _heads(spark, d).select("id", C.header_candidates(F.col("h")).alias("fields"))


@query(REC + f"SELECT {', '.join(['doc_id', 'rec_seq', *S.FIELDS])} FROM rec")
def apply_mapping(spark, d):
    keys = {"ord_no": "訂購單號", "part_no": "料號", "descr": "品名", "width": "規格", "qty": "數量", "unit": "單位", "price": "單價", "amount": "金額", "need_date": "交貨日期", "cust": "子公司"}
    cells = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(h).alias("key"), F.col(c).alias("value")) for i, (c, h) in enumerate(keys.items())])
    return R.apply_mapping(_raw(spark, d).select("doc_id", "rec_seq", F.inline(cells)))


@query(RAW + "SELECT doc_id, list_sort(['金額'] || CASE WHEN doc_id % 3 = 0 THEN ['Total Amount'] WHEN doc_id % 3 = 1 THEN ['小 計'] ELSE [] END) AS ignored FROM raw GROUP BY doc_id")
def ignored_headers(spark, d):
    third = F.when(F.col("doc_id") % 3 == 0, "Total Amount").when(F.col("doc_id") % 3 == 1, "小 計").otherwise("Unit Price")
    cells = F.array(*[F.struct(h.alias("key"), F.col("amount").alias("value")) for h in (F.lit("金額"), third, F.lit("數量"))])
    return R.ignored_headers(_raw(spark, d).select("doc_id", "rec_seq", F.inline(cells)))


@query(REC + ", bad AS (SELECT doc_id, rec_seq, CASE WHEN doc_id % 23 = 0 THEN '' ELSE ORD_NO END AS o, CASE WHEN doc_id % 31 = 0 THEN NULL ELSE QTY END AS q FROM rec) SELECT doc_id, rec_seq, 'no order number' AS problem FROM bad WHERE o = '' UNION ALL SELECT doc_id, rec_seq, 'no quantity' FROM bad WHERE q IS NULL")
def validate_records(spark, d):
    rec = _rec(spark, d)
    return R.validate(rec.withColumn("ORD_NO", F.when(F.col("doc_id") % 23 == 0, "").otherwise(F.col("ORD_NO"))).withColumn("QTY", F.when(F.col("doc_id") % 31 != 0, F.col("QTY"))))


@query(REC + f", am AS (SELECT doc_id, ord_no AS ORD_NO, arg_max(amount, rec_seq) AS amount_text FROM raw GROUP BY ALL), c AS (SELECT rec.doc_id, rec_seq, rec.ORD_NO, round(QTY::DECIMAL(16,2) * PRICE::DECIMAL(16,3), 2)::DOUBLE AS calc, {_num('amount_text', 2)} AS amount FROM rec JOIN am ON am.doc_id = rec.doc_id AND am.ORD_NO = rec.ORD_NO) SELECT *, abs(calc - amount) <= 1.0 AS ok FROM c WHERE calc IS NOT NULL AND amount IS NOT NULL")
def cross_check(spark, d):
    return R.cross_check(_rec(spark, d), R.amounts(_raw(spark, d)))


@query(RAW + "SELECT doc_id, ord_no AS ORD_NO, arg_max(amount, rec_seq) AS amount_text FROM raw GROUP BY ALL")
def amount_lookup(spark, d):
    return R.amounts(_raw(spark, d))


@query(SPANS + "SELECT page, count(*) AS n, count(*) FILTER (length(text) > 50) AS long FROM ruled WHERE rule GROUP BY ALL")
def rule_lines(spark, d):
    return _spans(spark, d).where(L.is_rule(F.col("text"))).groupBy("page").agg(F.count("*").alias("n"), F.count_if(F.length("text") > 50).alias("long"))


@query(SPANS + "SELECT * FROM bounds")
def table_bounds(spark, d):
    return L.with_bounds(L.pages(_spans(spark, d))).where("top IS NOT NULL").select("doc_id", "page", "top", "bottom")


@query(SPANS + "SELECT * FROM lefts")
def column_lefts(spark, d):
    return L.tables(_spans(spark, d)).select("doc_id", "page", "tier", "lefts")


@query(SPANS + "SELECT doc_id, page, span_seq, col_idx FROM cells")
def assign_columns(spark, d):
    return L.body_cells(L.tables(_spans(spark, d))).select("doc_id", "page", "span_seq", "col_idx")


@query(SPANS + "SELECT doc_id, page, span_seq, row_idx FROM cells")
def cluster_rows(spark, d):
    return L.body_cells(L.tables(_spans(spark, d))).select("doc_id", "page", "span_seq", "row_idx")


@query(SPANS + "SELECT * FROM grid")
def assemble_grid(spark, d):
    return L.grid(_spans(spark, d))


@query(SPANS + ", near AS (SELECT e.doc_id, e.page, e.i AS col_idx, (SELECT arg_min(r.text, abs(r.x - e.x) * 100000 + r.span_seq) FROM ruled r JOIN bounds b ON b.doc_id = r.doc_id AND b.page = r.page WHERE r.doc_id = e.doc_id AND r.page = e.page AND NOT r.rule AND r.y < b.top AND r.y >= b.top - 25 AND abs(r.x - e.x) < 40) AS header FROM (SELECT doc_id, page, unnest(lefts) AS x, generate_subscripts(lefts, 1) - 1 AS i FROM lefts) e) SELECT * FROM near")
def nearest_header(spark, d):
    return L.nearest_headers(_spans(spark, d))


@query(SPANS + "SELECT doc_id, page, y, substr(string_agg(text, ' ' ORDER BY x, text, span_seq), 1, 70) AS line FROM spans GROUP BY ALL")
def page_preview(spark, d):
    return L.page_preview(_spans(spark, d))


_CANON = _list(S.COLUMN_ORDER)
#: Column inference in SQL, for headers whose candidate fields do not compete for a column.
INFER = SPANS + f""", alias(field, akey, ord) AS (VALUES {', '.join(str((f, k, i)) for f, k, i in S.ALIAS_KEYS)}),
edge_at AS (SELECT doc_id, page, unnest(lefts) AS l, generate_subscripts(lefts, 1) - 1 AS i FROM lefts),
named AS (SELECT DISTINCT r.doc_id, r.page, r.span_seq, r.x, field FROM (SELECT ruled.doc_id, ruled.page, span_seq, x, {_KEY_SQL.replace('translate(h,', 'translate(text,')} AS key FROM ruled JOIN bounds USING (doc_id, page) WHERE NOT rule AND y < top) r JOIN alias ON contains(key, akey)),
near AS (SELECT n.doc_id, n.page, field, min(abs(l - x)) AS gap, arg_min(i, abs(l - x) * 1000 + i) AS spot FROM named n JOIN edge_at e ON e.doc_id = n.doc_id AND e.page = n.page GROUP BY n.doc_id, n.page, span_seq, field HAVING gap < {M.HEADER_REACH}),
picked AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY doc_id, page, spot ORDER BY gap) = 1 AND row_number() OVER (PARTITION BY doc_id, page, field ORDER BY gap, spot) = 1),
placed AS (SELECT e.doc_id, e.page, list(field ORDER BY i) AS cols FROM edge_at e LEFT JOIN picked p ON p.doc_id = e.doc_id AND p.page = e.page AND p.spot = e.i GROUP BY e.doc_id, e.page),
judged AS (SELECT *, [list_position({_CANON}, f) FOR f IN cols IF f IS NOT NULL] AS places, list_filter({_CANON}, lambda f: f IS NULL OR NOT list_contains(cols, f)) AS rest FROM placed),
inferred AS (SELECT doc_id, page, places = list_sort(places) AND len(list_distinct(places)) = len(places) AS safe,
  CASE WHEN places = list_sort(places) AND len(list_distinct(places)) = len(places) THEN [CASE WHEN cols[i] IS NULL THEN rest[len([1 FOR f IN cols[:i] IF f IS NULL])] ELSE cols[i] END FOR i IN range(1, len(cols) + 1)] ELSE cols END AS fields FROM judged)
"""


@query(INFER + "SELECT doc_id, page, fields, safe FROM inferred")
def infer_fields(spark, d):
    return M.infer_fields(_spans(spark, d))


@query(SPANS + ", n AS (SELECT doc_id, len(lefts) AS n, count(*) AS c, min(page) AS p FROM lefts GROUP BY ALL) SELECT doc_id, arg_max(n, c * 100000 - p) AS n FROM n GROUP BY doc_id")
def modal_columns(spark, d):
    return M.modal_columns(L.tables(_spans(spark, d)).select("doc_id", "page", F.size("lefts").alias("n")))


@query(SPANS + ", r AS (SELECT DISTINCT doc_id, page, row_idx FROM grid) SELECT doc_id, page, row_idx, row_number() OVER (PARTITION BY doc_id ORDER BY row_idx, page)::INT AS pick FROM r QUALIFY pick <= 3")
def sample_round_robin(spark, d):
    return M.sample_rows(L.grid(_spans(spark, d)).select("doc_id", "page", "row_idx").distinct(), 3)


#: Recorded answers: the usual order turned by doc_id % 10, said in several ways and with faults of each kind.
_GOOD = [*S.COLUMN_ORDER]
_SAID = ["訂購單號", "料號", "品名", "規格", "數量", "單位", "單價", "n/a", "交貨日期", "子公司"]
_KINDS = 7  # as it is, in header words, cut short, a field twice, an unknown one, no JSON, null as a word
_TURN = f"SELECT doc_id, run, kind, doc_id % 10 AS r, CASE WHEN kind = 1 THEN {_list(_SAID)} ELSE {_list(_GOOD)} END AS words, {_list(_GOOD)} AS truth"
_TURNED = (
    "turned AS (SELECT * EXCLUDE (words), words[r + 1:] || words[:r] AS whole, (truth[r + 1:] || truth[:r]) AS plain FROM kinds), "
    "said AS (SELECT *, CASE kind WHEN 2 THEN whole[:9] WHEN 3 THEN list_transform(whole, lambda f: CASE WHEN f = 'MATM_NAME' THEN 'ORD_NO' ELSE f END) WHEN 4 THEN list_transform(whole, lambda f: CASE WHEN f = 'ORD_NO' THEN 'nonsense' ELSE f END)"
    " WHEN 5 THEN NULL WHEN 6 THEN list_transform(whole, lambda f: CASE WHEN f = 'ORD_NO' THEN 'null' ELSE f END) ELSE whole END AS words FROM turned), "
    "parsed AS (SELECT *, CASE kind WHEN 0 THEN plain WHEN 1 THEN plain WHEN 6 THEN list_transform(plain, lambda f: CASE WHEN f = 'ORD_NO' THEN NULL ELSE f END) END AS mapping,"
    " CASE kind WHEN 2 THEN 'length' WHEN 3 THEN 'duplicate' WHEN 4 THEN 'unknown field' WHEN 5 THEN 'no JSON' END AS error FROM said)"
)


def _answer(kind, doc):
    """The JSON text of an answer of a kind for a document."""
    of = lambda words: F.array(*[F.lit(w).cast("string") for w in words])
    turned = lambda a: F.concat(F.slice(a, (doc % 10 + 1).cast("int"), F.lit(10)), F.slice(a, F.lit(1), (doc % 10).cast("int")))
    swap = lambda a, old, new: F.transform(a, lambda f: F.when(f == old, F.lit(new)).otherwise(f))
    whole = turned(F.when(kind == 1, of(_SAID)).otherwise(of(_GOOD)))
    words = F.when(kind == 2, F.slice(whole, 1, 9)).when(kind == 3, swap(whole, "MATM_NAME", "ORD_NO")).when(kind == 4, swap(whole, "ORD_NO", "nonsense")).when(kind == 6, swap(whole, "ORD_NO", "null")).otherwise(whole)
    return F.to_json(F.struct(words.alias("mapping")))


def _proposals(spark, d):
    cust = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("run"))
    kind = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % _KINDS).otherwise((F.col("doc_id") + F.col("run")) % _KINDS)
    json = _answer(F.col("kind"), F.col("doc_id"))
    fenced = F.concat(F.lit("```json\n"), F.regexp_replace(json, r"\}$", ",}"), F.lit("\n```"))
    return cust.withColumn("kind", kind).select("doc_id", "run", F.when(F.col("kind") == 5, "no answer").otherwise(fenced).alias("raw"))


_RUN_CTES = f"kinds AS ({_TURN} FROM (SELECT c_custkey AS doc_id, run, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % {_KINDS} ELSE (c_custkey + run) % {_KINDS} END AS kind FROM customer, (VALUES (0), (1), (2)) t(run))), " + _TURNED
_RUNS = f"WITH {_RUN_CTES} "


@query(_RUNS + "SELECT doc_id, run, mapping, error FROM parsed")
def parse_mapping(spark, d):
    p = _proposals(spark, d)
    return p.select("doc_id", "run", M.parse_mapping(F.col("raw"), F.lit(10)).alias("p")).select("doc_id", "run", "p.mapping", "p.error")


@query(_RUNS + ", c AS (SELECT doc_id, mapping, count(*) AS c FROM parsed WHERE error IS NULL GROUP BY ALL) SELECT doc_id, CASE WHEN 2 * max(c) > sum(c) THEN arg_max(mapping, c) END AS mapping, max(c) AS votes, sum(c)::BIGINT AS runs FROM c GROUP BY doc_id")
def vote_mapping(spark, d):
    return M.vote(parse_mapping(spark, d).where("error IS NULL"))


def _docs_mapping(spark, d):
    return _raw(spark, d).select("doc_id").distinct().withColumn("mapping", F.array(*[F.lit(f) for f in _GOOD]))


@query(SPANS + f", m AS (SELECT unnest({_list(_GOOD)}) AS field, generate_subscripts({_list(_GOOD)}, 1) - 1 AS col_idx) SELECT doc_id, page, row_idx, field, value FROM grid JOIN m USING (col_idx) WHERE field IS NOT NULL AND (doc_id, page, row_idx) IN (SELECT doc_id, page, row_idx FROM grid WHERE col_idx = 0)")
def apply_grid_mapping(spark, d):
    return M.apply_grid(L.grid_rows(_spans(spark, d)), _docs_mapping(spark, d))


@query(SPANS + "SELECT doc_id, page, len(lefts)::INT AS n, 10 AS wanted FROM lefts WHERE len(lefts) <> 10")
def skipped_pages(spark, d):
    return M.skipped_pages(L.tables(_spans(spark, d)).select("doc_id", "page", F.size("lefts").alias("n")), _docs_mapping(spark, d))


@query(INFER + f", {_RUN_CTES}, firsts AS (SELECT doc_id, arg_min(fields, page) AS fields FROM inferred GROUP BY doc_id) SELECT doc_id, run, [i - 1 FOR i IN range(1, greatest(len(mapping), len(fields)) + 1) IF mapping[i] IS DISTINCT FROM fields[i]] AS differ FROM parsed JOIN firsts USING (doc_id) WHERE error IS NULL")
def mapping_agreement(spark, d):
    return M.agreement_with_inferred(parse_mapping(spark, d).where("error IS NULL"), M.infer_fields(_spans(spark, d))).select("doc_id", "run", "differ")


@query(DIFFS + "SELECT * FROM diffs")
def diff_cells(spark, d):
    return A.diff_cells(*_sides(spark, d))


@query(SIDES + "SELECT doc_id, ORD_NO FROM expected EXCEPT SELECT doc_id, ORD_NO FROM actual")
def missing_keys(spark, d):
    return A.missing_keys(*_sides(spark, d))


@query(SIDES + "SELECT doc_id, ORD_NO FROM actual EXCEPT SELECT doc_id, ORD_NO FROM expected")
def extra_keys(spark, d):
    return A.extra_keys(*_sides(spark, d))


_COMMON = ", c AS (SELECT count(*) AS common FROM expected e JOIN actual a ON e.doc_id = a.doc_id AND e.ORD_NO = a.ORD_NO) "


@query(DIFFS + _COMMON + "SELECT common, (SELECT count(*) FROM diffs) AS diffs, round((common * 12 - (SELECT count(*) FROM diffs)) / (common * 12), 6) AS accuracy, round(common / (SELECT count(*) FROM expected), 6) AS coverage FROM c")
def overall_accuracy(spark, d):
    return A.overall_accuracy(*_sides(spark, d))


@query(DIFFS + _COMMON + f"SELECT field, count(doc_id) AS errors, round(100.0 * (common - count(doc_id)) / common, 4) AS rate, count(doc_id) = common AS all_wrong FROM (SELECT unnest({_list(S.FIELDS)}) AS field) LEFT JOIN diffs USING (field), c GROUP BY field, common")
def field_accuracy(spark, d):
    return A.field_accuracy(*_sides(spark, d))


@query(DIFFS + "SELECT field, CASE WHEN coalesce(expected, '') = '' OR coalesce(actual, '') = '' THEN 'one side empty' WHEN length(expected) = length(actual) THEN 'same length' WHEN regexp_replace(expected, '[^0-9]', '', 'g') = regexp_replace(actual, '[^0-9]', '', 'g') THEN 'same digits' ELSE 'other' END AS shape, count(*) AS n FROM diffs GROUP BY ALL")
def diff_shapes(spark, d):
    return A.diff_shapes(A.diff_cells(*_sides(spark, d)))


@query(DIFFS + ", f(file, k) AS (VALUES ('result.a.json', 1), ('result.b.json', 2)), a AS (SELECT file, doc_id, ORD_NO FROM actual, f WHERE doc_id % k = 0), j AS (SELECT file, count(*) AS n, count(e.doc_id) AS common FROM a LEFT JOIN expected e ON e.doc_id = a.doc_id AND e.ORD_NO = a.ORD_NO GROUP BY file), x AS (SELECT file, count(*) AS diffs FROM diffs, f WHERE doc_id % k = 0 GROUP BY file) SELECT file, n, (SELECT count(*) FROM expected) - common AS missing, diffs, round(100.0 * (common * 12 - diffs) / (common * 12), 4) AS rate FROM j JOIN x USING (file)")
def result_summary(spark, d):
    e, a = _sides(spark, d)
    files = a.withColumn("file", F.explode(F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("result.a.json"), F.lit("result.b.json"))).otherwise(F.array(F.lit("result.a.json")))))
    return A.result_summary(e, files)


_P1, _B1 = "regexp_extract(MATM_DESC, '^([0O])([A-Z]{2})', ['a', 'b'])", "regexp_extract(MATM_DESC, '/\\(([0O])([A-Z]{2})\\)', ['a', 'b'])"


@query(REC + f", p AS (SELECT doc_id, rec_seq, MATM_DESC, {_P1} AS pp, {_B1} AS bb FROM rec), c AS (SELECT *, pp.a <> '' AND bb.a <> '' AND pp.b = bb.b AND pp.a <> bb.a AS changed FROM p) SELECT doc_id, rec_seq, changed, CASE WHEN changed THEN '0' || substr(MATM_DESC, 2) ELSE MATM_DESC END AS MATM_DESC FROM c")
def repair_codes(spark, d):
    return R.repair(_rec(spark, d)).select("doc_id", "rec_seq", "changed", "MATM_DESC")


_LETTERS, _SIGNS = S.MASK_LETTERS, S.MASK_SIGNS


def _like(text: str, digit: str, seq: str) -> str:
    ring = lambda letters: f"substr('{letters}', (({seq} + i - 1) % {len(letters)} + 1)::INT, 1)"
    return f"array_to_string(list_transform(string_split({text}, ''), lambda ch, i: CASE WHEN regexp_full_match(ch, '[0-9]') THEN {digit} WHEN regexp_full_match(ch, '[A-Z]') THEN {ring(_LETTERS)} WHEN regexp_full_match(ch, '[a-z]') THEN {ring(_LETTERS.lower())} ELSE ch END), '')"


def _desc_like(text: str, seq: str) -> str:
    ring = lambda letters, first: f"substr('{letters}', (((unicode(ch) - {first}) * 7 + {seq} * 3) % {len(letters)} + 1)::INT, 1)"
    return (
        f"array_to_string(list_transform(string_split({text}, ''), lambda ch: CASE WHEN ch IN ('0', 'O') THEN ch WHEN regexp_full_match(ch, '[1-9]') THEN (((unicode(ch) - 49) * 2 + {seq}) % 9 + 1)::VARCHAR"
        f" WHEN regexp_full_match(ch, '[A-Z]') THEN {ring(_LETTERS, 65)} WHEN regexp_full_match(ch, '[a-z]') THEN {ring(_LETTERS.lower(), 97)}"
        f" WHEN unicode(ch) BETWEEN 13312 AND 40959 THEN substr('{_SIGNS}', ((unicode(ch) + {seq}) % {len(_SIGNS)} + 1)::INT, 1) ELSE ch END), '')"
    )


def _moved(text: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN lpad(((substr({text}, 1, {n})::BIGINT + 1) % (10 ** {n})::BIGINT)::VARCHAR, {n}::INT, '0') || substr({text}, {n} + 1) ELSE {text} END"


def _unit_like(text: str, seq: str) -> str:
    rings = {}
    for w in sorted(S.UNITS):
        rings.setdefault(len(w), []).append(w)
    cases = " ".join(f"WHEN list_contains({_list(r)}, {text}) THEN {_list(r)}[((list_position({_list(r)}, {text}) + {seq}) % {len(r)} + 1)::INT]" for r in rings.values())
    return f"CASE {cases} ELSE {_desc_like(text, seq)} END"


_RANKED = ("part_no", "descr", "unit", "cust")
MASKED = RAW + "".join(f", seq_{c} AS (SELECT doc_id, {c}, row_number() OVER (PARTITION BY doc_id ORDER BY min(rec_seq), {c}) - 1 AS s_{c} FROM raw GROUP BY doc_id, {c})" for c in _RANKED) + f""",
numbered AS (SELECT raw.*, {', '.join(f's_{c}' for c in _RANKED)}, length(regexp_extract(width, '^[0-9]*')) AS w, length(regexp_extract(need_date, '^[0-9]*')) AS y FROM raw {' '.join(f'JOIN seq_{c} ON raw.doc_id = seq_{c}.doc_id AND raw.{c} = seq_{c}.{c}' for c in _RANKED)}),
dated AS (SELECT * EXCLUDE (y), CASE WHEN y = 8 THEN 4 WHEN y BETWEEN 2 AND 4 THEN y ELSE 0 END AS y FROM numbered),
masked AS (SELECT doc_id, rec_seq, {_like('ord_no', 'CASE WHEN i = 1 THEN chr(54) ELSE ((rec_seq - 1 + i - 1) % 10)::VARCHAR END', '(rec_seq - 1)')} AS ord_no, {_like('part_no', '((s_part_no * 3 + i - 1) % 10)::VARCHAR', 's_part_no')} AS part_no,
  {_desc_like('descr', 's_descr')} AS descr, {_moved('width', 'w')} AS width, qty, {_unit_like('unit', 's_unit')} AS unit, price, amount, {_moved('need_date', 'y')} AS need_date, {_like('cust', '((s_cust * 3 + i - 1) % 10)::VARCHAR', 's_cust')} AS cust FROM dated)
"""


@query(MASKED + "SELECT doc_id, rec_seq, ord_no, part_no, width FROM masked")
def anonymize_codes(spark, d):
    return N.anonymize(_raw(spark, d)).select("doc_id", "rec_seq", "ord_no", "part_no", "width")


@query(MASKED + "SELECT doc_id, rec_seq, descr, unit, need_date, cust FROM masked")
def anonymize_words(spark, d):
    return N.anonymize(_raw(spark, d)).select("doc_id", "rec_seq", "descr", "unit", "need_date", "cust")


_AUDITED = ("ord_no", "part_no", "descr", "width", "qty", "unit", "price", "amount", "need_date", "cust")


def _shape(table: str) -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS v FROM {table}" for c in _AUDITED)
    return f"(SELECT c, list_sort(list(DISTINCT length(v))) AS lens, count(*) FILTER (contains(v, ',')) AS commas, count(DISTINCT v) AS kinds, count(*) FILTER (regexp_matches(v, '{N.SENSITIVE}')) AS leaks FROM ({cells}) GROUP BY c)"


@query(MASKED + f"SELECT c AS \"column\", a.leaks, b.lens = a.lens AS same_lengths, b.commas = a.commas AS same_commas, round(a.kinds / b.kinds, 6) AS distinct_ratio, a.leaks = 0 AND b.lens = a.lens AND b.commas = a.commas AND round(a.kinds / b.kinds, 6) BETWEEN 0.5 AND 1.6 AS passed FROM {_shape('raw')} b JOIN {_shape('masked')} a USING (c)")
def anonymize_audit(spark, d):
    return N.audit_masks(_raw(spark, d), _AUDITED)


@query("SELECT event_id, (props->>'$.k')::INT AS k, 'ok' AS state FROM events")
def json_loose(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here: "), "props", F.lit(" done"))).otherwise(F.col("props"))
    v = e.select("event_id", J.loose_json(wrapped).alias("v"))
    return v.select("event_id", F.get_json_object("v.value", "$.k").try_cast("int").alias("k"), F.when(F.col("v.error").isNull(), "ok").otherwise("bad").alias("state"))


@query("SELECT event_id, 2 AS record_count, props AS first FROM events")
def coerce_shape(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    key = F.element_at(F.array(*[F.lit(k) for k in J.ROW_KEYS]), (F.col("event_id") % len(J.ROW_KEYS) + 1).cast("int"))
    text = F.concat(F.lit('{"'), key, F.lit('": ['), "props", F.lit(', "x"]}'))
    r = e.select("event_id", J.result_rows(text).alias("r"))
    return r.select("event_id", "r.record_count", F.get("r.data", F.lit(0)).alias("first"))


@query(_RUNS + "SELECT doc_id, run, CASE WHEN mapping IS NULL THEN 0.0 ELSE len([1 FOR i IN range(1, 11) IF mapping[i] IS NOT DISTINCT FROM truth[i]]) / 10 END AS score, CASE WHEN mapping IS NULL THEN []::INT[] ELSE [(i - 1)::INT FOR i IN range(1, 11) IF mapping[i] IS DISTINCT FROM truth[i]] END AS wrong FROM parsed")
def score_mapping(spark, d):
    truth = F.array(*[F.lit(f) for f in _GOOD])
    return parse_mapping(spark, d).select("doc_id", "run", E.mapping_score(F.col("mapping"), truth).alias("score"), E.wrong_columns(F.col("mapping"), truth).alias("wrong"))


_ONE_RUN = f"WITH kinds AS ({_TURN} FROM (SELECT c_custkey AS doc_id, 0 AS run, c_custkey % {_KINDS} AS kind FROM customer)), " + _TURNED + " "


def _strict(spark, d):
    """The same answers as strict JSON, one a document."""
    kind = F.col("doc_id") % _KINDS
    cust = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("doc_id"))
    raw = F.when(kind == 5, "no answer").otherwise(_answer(kind, F.col("doc_id")))
    return cust.select("doc_id", M.mapping_faults(raw, F.lit(10)).alias("p")).select("doc_id", "p.mapping", "p.faults")


@query(_ONE_RUN + "SELECT doc_id, words AS mapping, CASE kind WHEN 2 THEN ['length'] WHEN 3 THEN ['duplicate'] WHEN 5 THEN ['no JSON'] WHEN 6 THEN ['null as text'] ELSE []::VARCHAR[] END AS faults FROM said")
def mapping_faults(spark, d):
    return _strict(spark, d)


_HITS = "CASE WHEN {0} IS NULL OR len({0}) <> 10 THEN 0.0 ELSE len([1 FOR i IN range(1, 11) IF {0}[i] IS NOT DISTINCT FROM truth[i]]) / 10 END::DOUBLE"


@query(_ONE_RUN + ", resolved AS (SELECT *, CASE kind WHEN 1 THEN plain WHEN 6 THEN list_transform(words, lambda f: CASE WHEN f = 'null' THEN NULL ELSE f END) ELSE words END AS meant FROM said) SELECT doc_id, " + _HITS.format("words") + " AS strict, " + _HITS.format("meant") + " AS normal FROM resolved")
def score_mapping_dual(spark, d):
    return _strict(spark, d).select("doc_id", E.mapping_scores(F.col("mapping"), F.array(*[F.lit(f) for f in _GOOD])).alias("s")).select("doc_id", "s.strict", "s.normal")


_PLACES = f"[list_position({_list(_GOOD)}, f) FOR f IN {{0}} IF f IS NOT NULL]"


@query(_RUNS + f"SELECT doc_id, run, {_PLACES.format('mapping')} = list_sort({_PLACES.format('mapping')}) AS forward, {_PLACES.format('list_reverse(mapping)')} = list_sort({_PLACES.format('mapping')}) AS backward FROM parsed WHERE error IS NULL")
def order_check(spark, d):
    return parse_mapping(spark, d).where("error IS NULL").select("doc_id", "run", M.order_ok(F.col("mapping")).alias("forward"), M.order_ok(F.reverse("mapping")).alias("backward"))


@query(SPANS + ", r AS (SELECT doc_id, page, row_idx, '{' || string_agg('\"' || col_idx || '\":' || to_json(value)::VARCHAR, ',' ORDER BY col_idx) || '}' AS cells FROM grid GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row_idx, page) AS pick FROM r QUALIFY pick <= 3) SELECT doc_id, 'Name the field of each column. Fields: " + ", ".join(S.IMPORTED) + ". Use null for none. Answer as JSON with a list under mapping.' || chr(10) || string_agg('row ' || pick || ': ' || cells, chr(10) ORDER BY pick) AS prompt FROM p GROUP BY doc_id")
def prompt_texts(spark, d):
    cells = F.map_from_entries(F.array_sort(F.collect_list(F.struct("col_idx", "value")))).alias("cells")
    return M.prompt(M.sample_rows(L.grid(_spans(spark, d)).groupBy("doc_id", "page", "row_idx").agg(cells), 3))


_WIDE = "[\\x{1100}-\\x{115f}\\x{2e80}-\\x{303e}\\x{3041}-\\x{a4cf}\\x{ac00}-\\x{d7a3}\\x{f900}-\\x{faff}\\x{fe30}-\\x{fe6f}\\x{ff01}-\\x{ff60}\\x{ffe0}-\\x{ffe6}]"


@query(HEADS + f", w AS (SELECT id, h, length(h) + len(regexp_extract_all(h, '{_WIDE}')) AS width FROM heads) SELECT id, width::INT AS width, h || repeat(' ', greatest(0, 20 - width)) AS padded FROM w")
def display_width(spark, d):
    return _heads(spark, d).select("id", C.display_width(F.col("h")).cast("int").alias("width"), C.padded(F.col("h"), 20).alias("padded"))


@query(DIFFS + "SELECT doc_id, ORD_NO, array_to_string([CASE WHEN expected[i] = actual[i] THEN ' ' ELSE '^' END FOR i IN range(1, length(expected) + 1)], '') AS marks FROM diffs WHERE field = 'MATM_DESC'")
def diff_marks(spark, d):
    diffs = A.diff_cells(*_sides(spark, d)).where("field = 'MATM_DESC'")
    return diffs.select("doc_id", "ORD_NO", C.diff_marks(F.col("expected"), F.col("actual")).alias("marks"))


@query("SELECT o_orderkey AS id, round((o_custkey % 101) / 100.0 * (o_orderkey % 40) / 38, 9)::DOUBLE AS score, o_orderkey % 11 >= 5 AS passed FROM orders")
def score_end_to_end(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), F.round(E.end_to_end((F.col("o_custkey") % 101).cast("double"), F.col("o_orderkey") % 40, F.lit(38)), 9).alias("score"), E.lenient_pass(F.col("o_orderkey") % 11, F.lit(10)).alias("passed"))


_O = "SELECT o_orderkey AS id, (o_orderkey % 20)::INT AS f, (o_orderkey % 20 + o_custkey % 15)::INT AS l, 5 AS tf, 20 AS tl FROM orders"


def _ranges(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 20).cast("int").alias("f"), (F.col("o_orderkey") % 20 + F.col("o_custkey") % 15).cast("int").alias("l"), F.lit(5).alias("tf"), F.lit(20).alias("tl"))


@query(f"WITH o AS ({_O}) SELECT id, round(2.0 * greatest(0, least(l, tl) - greatest(f, tf) + 1) / (l - f + 1 + tl - tf + 1), 9) AS score FROM o")
def score_ranges_f1(spark, d):
    return _ranges(spark, d).select("id", F.round(E.range_f1(*map(F.col, ("f", "l", "tf", "tl"))), 9).alias("score"))


@query(f"WITH o AS ({_O}) SELECT id, CASE WHEN f = tf AND l = tl THEN 1.0 WHEN abs(f - tf) <= 10 AND abs(l - tl) <= 10 THEN 0.8 ELSE 0.3 END::DOUBLE AS score FROM o")
def score_bounds(spark, d):
    return _ranges(spark, d).select("id", E.bounds_score(*map(F.col, ("f", "l", "tf", "tl"))).cast("double").alias("score"))


@query(f"WITH o AS ({_O}) SELECT id, CASE WHEN f = tf AND l = tl THEN 1.0 WHEN abs(f - tf) <= 2 AND abs(l - tl) <= 2 THEN 0.7 ELSE greatest(0, 1 - (abs(f - tf) + abs(l - tl)) / 200) END::DOUBLE AS score FROM o")
def score_edges(spark, d):
    return _ranges(spark, d).select("id", E.edges_score(F.array("f", "l"), F.array("tf", "tl")).cast("double").alias("score"))


def _runs(spark, d):
    o, i = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey")
    case = F.concat(F.lit("case"), (F.col("o_custkey") % 50).cast("string"))
    return o.select(case.alias("case_id"), F.concat(F.lit("A"), (i % 4).cast("string")).alias("arm"), i.alias("run"), F.when(F.col("o_custkey") % 5 == 0, 1.0).otherwise((i % 11) / 10).alias("score"), (i % 3).cast("string").alias("raw"), (F.col("o_custkey") % 100 / 10).alias("elapsed"), (i % 1000).alias("tokens"), (i % 3).alias("violations"), (F.col("o_custkey") % 7 == 0).alias("contaminated"))


_R = "WITH r AS (SELECT 'case' || (o_custkey % 50) AS case_id, 'A' || (o_orderkey % 4) AS arm, o_orderkey AS run, CASE WHEN o_custkey % 5 = 0 THEN 1.0 ELSE (o_orderkey % 11) / 10 END AS score, (o_orderkey % 3)::VARCHAR AS raw, o_custkey % 100 / 10 AS elapsed, o_orderkey % 1000 AS tokens, o_orderkey % 3 AS violations, o_custkey % 7 = 0 AS contaminated FROM orders) "


@query(_R + ", x AS (SELECT arm, case_id, bool_and(score = 1.0) AS e, avg(score) AS s, avg(tokens) AS t, arg_min(violations, run) AS v FROM r WHERE NOT contaminated GROUP BY ALL) SELECT arm, count(*) FILTER (e) AS exact, count(*) AS cases, round(avg(s), 6) AS score, round(avg(t), 4) AS tokens, count(*) FILTER (v > 0) AS violations FROM x GROUP BY arm")
def arm_summary(spark, d):
    return E.arm_summary(_runs(spark, d))


@query(_R + ", s AS (SELECT case_id, round(avg(score), 6) AS mean, min(score)::DOUBLE AS low, max(score)::DOUBLE AS high, count(*) FILTER (score = 0) AS failures, count(DISTINCT raw) AS answers, round(avg(elapsed), 6) AS mean_s, round(sum(elapsed), 6) AS total_s FROM r GROUP BY case_id) SELECT *, CASE WHEN mean >= 0.95 AND answers = 1 THEN 'usable' WHEN mean >= 0.8 THEN 'with checks' ELSE 'unusable' END AS verdict FROM s")
def run_stability(spark, d):
    return E.run_summary(_runs(spark, d))


_FILES = REC + ", am AS (SELECT doc_id, ord_no AS ORD_NO, arg_max(amount, rec_seq) AS t FROM raw GROUP BY ALL), files AS (SELECT rec.doc_id, count(*) AS records, count(*) FILTER (QTY IS NOT NULL AND PRICE IS NOT NULL AND t IS NOT NULL) AS verified, count(*) FILTER (abs(round(QTY::DECIMAL(16,2) * PRICE::DECIMAL(16,3), 2)::DOUBLE - replace(t, ',', '')::DOUBLE) > 1) AS mismatches, rec.doc_id % 10 <> 0 AS agreed, (rec.doc_id % 3)::VARCHAR AS mapping FROM rec JOIN am ON am.doc_id = rec.doc_id AND am.ORD_NO = rec.ORD_NO GROUP BY rec.doc_id) "


def _files(spark, d):
    x = cross_check(spark, d).groupBy("doc_id").agg(F.count("*").alias("verified"), F.count_if(~F.col("ok")).alias("mismatches"))
    r = _rec(spark, d).groupBy("doc_id").agg(F.count("*").alias("records")).join(x, "doc_id", "left")
    return r.select("doc_id", "records", F.coalesce("verified", F.lit(0)).alias("verified"), F.coalesce("mismatches", F.lit(0)).alias("mismatches"), (F.col("doc_id") % 10 != 0).alias("agreed"), (F.col("doc_id") % 3).cast("string").alias("mapping"))


@query(_FILES + "SELECT count(*) AS files, sum(records)::BIGINT AS records, sum(verified)::BIGINT AS verified, sum(mismatches)::BIGINT AS mismatches, count(*) FILTER (agreed) AS agreed, count(DISTINCT mapping) AS mappings FROM files")
def batch_totals(spark, d):
    return E.batch_totals(_files(spark, d))


@query(_FILES + "SELECT doc_id, records, verified, mismatches FROM files WHERE NOT (mismatches = 0 AND verified = records)")
def untrusted_files(spark, d):
    return E.untrusted(_files(spark, d)).select("doc_id", "records", "verified", "mismatches")


_V = "try_cast(replace(value, ',', '') AS DOUBLE)"


@query(SPANS + f"SELECT doc_id, col_idx, count(*) AS n, count(DISTINCT value) AS kinds, round(avg(length(value)), 6) AS mean_length, max(length(value))::INT AS max_length, round(avg(({_V} IS NOT NULL)::INT), 6) AS numeric, round(avg((regexp_full_match(value, '\\d{{2,4}}[/-]\\d{{1,2}}[/-]\\d{{1,2}}') OR regexp_full_match(value, '20\\d{{6}}'))::INT), 6) AS dated, round(avg((value LIKE '%\"')::INT), 6) AS inches, max(CASE WHEN {_V} IS NOT NULL AND value LIKE '%.%' THEN length(split_part(value, '.', -1)) ELSE 0 END)::INT AS decimals FROM grid GROUP BY ALL")
def column_profile(spark, d):
    return M.column_profile(L.grid(_spans(spark, d)))


_PROFILE = ORACLES["column_profile"].removeprefix(SPANS)


@query(SPANS + f""", p AS ({_PROFILE}),
num AS (SELECT g.doc_id, g.page, g.row_idx, g.col_idx, replace(value, ',', '')::DOUBLE AS v FROM grid g JOIN p ON p.doc_id = g.doc_id AND p.col_idx = g.col_idx WHERE numeric = 1.0),
hits AS (SELECT doc_id, i, j, k, count(*) AS hits FROM (SELECT DISTINCT a.doc_id, a.page, a.row_idx, a.col_idx AS i, b.col_idx AS j, z.col_idx AS k FROM num a JOIN num b ON a.doc_id = b.doc_id AND a.page = b.page AND a.row_idx = b.row_idx AND b.col_idx > a.col_idx
  JOIN num z ON z.doc_id = a.doc_id AND z.page = a.page AND z.row_idx = a.row_idx AND z.col_idx <> a.col_idx AND z.col_idx <> b.col_idx WHERE abs(z.v - a.v * b.v) <= 0.5) GROUP BY ALL),
whole AS (SELECT doc_id, count(DISTINCT (page, row_idx)) AS n_rows FROM num GROUP BY doc_id),
best AS (SELECT doc_id, min([i, j, k]) AS t FROM hits JOIN whole USING (doc_id) WHERE hits = n_rows GROUP BY doc_id),
q AS (SELECT p.*, t, numeric < 1.0 AND dated < 0.5 AND inches < 0.5 AS is_text, max(CASE WHEN col_idx = t[1] THEN decimals END) OVER w > max(CASE WHEN col_idx = t[2] THEN decimals END) OVER w AS swap FROM p LEFT JOIN best ON best.doc_id = p.doc_id WINDOW w AS (PARTITION BY p.doc_id)),
y AS (SELECT *, CASE WHEN swap THEN t[2] ELSE t[1] END AS qc, CASE WHEN swap THEN t[1] ELSE t[2] END AS rc, t[3] AS kc, arg_max(CASE WHEN is_text THEN col_idx END, CASE WHEN is_text THEN mean_length * 1000 - col_idx END) OVER w AS longest, min(CASE WHEN is_text AND kinds = n THEN col_idx END) OVER w AS first_key FROM q WINDOW w AS (PARTITION BY doc_id))
SELECT doc_id, col_idx, CASE WHEN col_idx = kc THEN NULL WHEN col_idx = qc THEN 'QTY' WHEN col_idx = rc THEN 'PRICE' WHEN dated >= 0.5 THEN 'NEED_DATE' WHEN inches >= 0.5 THEN 'WIDE' WHEN col_idx = longest THEN 'MATM_DESC' WHEN col_idx = first_key THEN 'ORD_NO' WHEN max_length <= 3 AND kinds * 2 <= n THEN 'UNIT' END AS field FROM y""")
def classify_columns(spark, d):
    return K.classify_columns(_raw(spark, d).where("doc_id IS NOT NULL"), B.row_spans)


def _extracted(cells: str) -> str:
    """Typed, repaired records of cells (doc_id, page, row_idx, field, value), as rows with an order number."""
    pivot = ", ".join(f"coalesce(trim(max(value) FILTER (field = '{f}')), '') AS {f}" for f in S.IMPORTED)
    typed = {f: f for f in S.FIELDS} | {"WIDE": "regexp_replace(WIDE, '[^0-9]', '', 'g')", "QTY": _num("QTY", 2), "PRICE": _num("PRICE", 3), "UNIT": _unit("UNIT"), "NEED_DATE": _date("replace(NEED_DATE, ' ', '')"), "MATM_DESC": "CASE WHEN changed THEN '0' || substr(MATM_DESC, 2) ELSE MATM_DESC END"} | {f: "''" for f in S.BLANK_FIELDS}
    return (
        f", wide AS (SELECT doc_id, page, row_idx, {pivot} FROM ({cells}) GROUP BY ALL HAVING count(*) FILTER (field = 'ORD_NO') > 0), coded AS (SELECT *, {_P1} AS pp, {_B1} AS bb FROM wide), marked AS (SELECT *, pp.a <> '' AND bb.a <> '' AND pp.b = bb.b AND pp.a <> bb.a AS changed FROM coded) "
        f"SELECT doc_id, page, row_idx, {', '.join(f'{e} AS {f}' for f, e in typed.items())}, changed FROM marked"
    )


@query(INFER + _extracted("SELECT g.doc_id, g.page, g.row_idx, fields[g.col_idx + 1] AS field, value FROM grid g JOIN inferred f ON f.doc_id = g.doc_id AND f.page = g.page WHERE fields[g.col_idx + 1] IS NOT NULL"))
def extract_records(spark, d):
    from spanforge.plans.extract import deterministic

    return deterministic(_spans(spark, d))["records"]


@query(SPANS + f", widths AS (SELECT doc_id, page, len(lefts) AS n FROM lefts), modal AS (SELECT doc_id, arg_max(n, c * 100000 - p) AS n FROM (SELECT doc_id, n, count(*) AS c, min(page) AS p FROM widths GROUP BY ALL) GROUP BY doc_id)" + _extracted(f"SELECT g.doc_id, g.page, g.row_idx, ({_list(_GOOD)})[g.col_idx + 1] AS field, value FROM grid g JOIN widths w ON w.doc_id = g.doc_id AND w.page = g.page AND w.n = 10 JOIN modal ON modal.doc_id = g.doc_id AND modal.n = 10 WHERE ({_list(_GOOD)})[g.col_idx + 1] IS NOT NULL"))
def extract_by_proposal(spark, d):
    import json

    from spanforge.plans.extract import by_proposal

    answer = json.dumps({"mapping": _GOOD})
    answers = _raw(spark, d).select("doc_id").distinct().select("doc_id", F.lit(0).alias("run"), F.lit(answer).alias("raw"))
    return by_proposal(_raw(spark, d), answers, B.row_spans)["records"]


@query(SPANS + ", marked AS (SELECT *, row_number() OVER w AS k, x IS DISTINCT FROM lag(x) OVER w AS begins FROM spans WINDOW w AS (PARTITION BY doc_id, page ORDER BY y, x, text, span_seq)), numbered AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id, page ORDER BY k) - 1 AS run FROM marked) SELECT doc_id, page, run::INT AS run, any_value(x)::INT AS x, substr(string_agg(text, ' ' ORDER BY k), 1, 34) AS line FROM numbered GROUP BY doc_id, page, run")
def page_runs(spark, d):
    return L.page_runs(_spans(spark, d))


@query(SPANS + ", lines AS (SELECT doc_id, page, row_idx, substr(string_agg(text, ' ' ORDER BY y, x, text), 1, 70) AS line FROM cells GROUP BY ALL), per AS (SELECT doc_id, page, count(*) AS n, list(line ORDER BY row_idx) AS previews FROM lines GROUP BY ALL) SELECT b.doc_id, b.page, top, bottom, tier, lefts, coalesce(n, 0) AS rows, coalesce(previews, []) AS previews FROM bounds b JOIN lefts USING (doc_id, page) LEFT JOIN per USING (doc_id, page)")
def truth_tables(spark, d):
    return L.truth_tables(_spans(spark, d))


_PLACE = "list_position(" + _list(S.FIELDS) + ", field)"
_SHAPE = ORACLES["diff_shapes"].removeprefix(DIFFS)
_ONE = lambda x: f"round({x}, 1)::DECIMAL(5,1)::VARCHAR || '%'"
_SHOWN = "doc_id || ' ' || ORD_NO || ' ' || field || ': expected ' || coalesce(nullif(expected, ''), '(none)') || ', actual ' || coalesce(nullif(actual, ''), '(none)')"
_REPORT = DIFFS + _COMMON.rstrip() + f""", t AS (SELECT common, (SELECT count(*) FROM expected) AS wanted, (SELECT count(*) FROM actual) AS got, (SELECT count(*) FROM diffs) AS n FROM c),
heads AS (SELECT unnest(['records: expected ' || wanted || ', actual ' || got, 'keys found: ' || common || ' of ' || wanted, 'missing keys: ' || (wanted - common), 'extra keys: ' || (got - common),
  'accuracy over ' || common || ' records of 12 fields, ' || (common * 12) || ' cells: ' || {_ONE('100 * round((common * 12 - n) / (common * 12), 6)')}, 'differences: ' || n]) AS line, generate_subscripts([1, 2, 3, 4, 5, 6], 1) - 1 AS a FROM t),
shapes AS ({_SHAPE}), errors AS (SELECT field, count(doc_id) AS errors FROM (SELECT unnest({_list(S.FIELDS)}) AS field) LEFT JOIN diffs USING (field) GROUP BY field),
fixed_lines AS (SELECT 1 AS section, a::BIGINT AS a, 0::BIGINT AS b, '' AS c, line FROM heads
UNION ALL SELECT 2, doc_id, 0, ORD_NO, 'missing ' || doc_id || ' ' || ORD_NO FROM (SELECT doc_id, ORD_NO FROM expected EXCEPT SELECT doc_id, ORD_NO FROM actual)
UNION ALL SELECT 3, doc_id, 0, ORD_NO, 'extra ' || doc_id || ' ' || ORD_NO FROM (SELECT doc_id, ORD_NO FROM actual EXCEPT SELECT doc_id, ORD_NO FROM expected)
UNION ALL SELECT 4, {_PLACE}, 0, '', rpad(field, 12, ' ') || lpad(errors::VARCHAR, 8, ' ') || lpad({_ONE('round(100.0 * (common - errors) / common, 4)')}, 8, ' ') || CASE WHEN errors = common THEN ' all wrong' ELSE '' END FROM errors, t
UNION ALL SELECT 5, -sum(n) OVER (PARTITION BY field), -n, field || ' ' || shape, rpad(field, 12, ' ') || '[' || n || '] ' || shape FROM shapes)
SELECT * FROM fixed_lines UNION ALL """


@query(_REPORT + f"SELECT 6, doc_id, 0, ORD_NO || ' ' || field, {_SHOWN} FROM (SELECT * FROM diffs ORDER BY doc_id, ORD_NO, field LIMIT 10)")
def compare_report(spark, d):
    return T.compare_report(*_sides(spark, d))


@query(_REPORT.replace("shapes AS (", "of_shape AS (SELECT *, " + _SHAPE.split("SELECT field, ", 1)[1].split(" AS shape", 1)[0] + " AS shape FROM diffs), shapes AS (", 1) + f"SELECT 6, {_PLACE}, -count(*) OVER (PARTITION BY field, shape), shape || ' ' || doc_id || ' ' || ORD_NO, {_SHOWN} FROM of_shape")
def compare_report_full(spark, d):
    return T.compare_report(*_sides(spark, d), full=True)


@query(_FILES + ", t AS (SELECT count(*) AS n, sum(records) AS r, sum(verified) AS v, sum(mismatches) AS m, count(*) FILTER (agreed) AS g, count(DISTINCT mapping) AS k FROM files) SELECT 1 AS section, doc_id AS a, 0::BIGINT AS b, '' AS c, doc_id || ': ' || records || ' records, ' || verified || ' verified, ' || mismatches || ' mismatches, headers agree: ' || CASE WHEN agreed THEN 'yes' ELSE 'no' END AS line FROM files UNION ALL SELECT 2, unnest([0, 1, 2, 3, 4, 5]), 0, '', unnest(['files: ' || n, 'records: ' || r, 'verified: ' || v || ' of ' || r, 'mismatches: ' || m, 'headers agree: ' || g || ' of ' || n, 'different mappings: ' || k]) FROM t")
def batch_report(spark, d):
    return T.batch_report(_files(spark, d))


@query(SPANS + """, lines AS (SELECT doc_id, page, y, 'y=' || y || ' ' || substr(string_agg(text, ' ' ORDER BY x, text, span_seq), 1, 70) AS line FROM spans GROUP BY doc_id, page, y) SELECT doc_id, page, 'Texts of a page by height in points.' || chr(10) || string_agg(line, chr(10) ORDER BY y) || chr(10) || 'At which heights does the order table begin and end? Answer as JSON: {"top": 0, "bottom": 0}' AS prompt FROM lines GROUP BY doc_id, page""")
def prompt_bounds(spark, d):
    return Q.bounds_prompt(_spans(spark, d))


def _broken(spark, d):
    """Envelopes of the records, one JSON text a document, with faults by document number."""
    i = F.col("doc_id")
    rec = _rec(spark, d).withColumn("ORD_NO", F.when(i % 23 == 0, "").otherwise(F.col("ORD_NO")))
    fields = [f for f in S.FIELDS if f != "PRICE"]
    whole, short = (F.to_json(F.struct(*c), {"ignoreNullFields": "false"}) for c in (S.FIELDS, fields))
    per = rec.select("doc_id", "rec_seq", F.when(i % 7 == 0, short).otherwise(whole).alias("row")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rec_seq", "row"))).alias("rows"))
    n = F.size("rows")
    data = F.when(i % 31 == 0, "").otherwise(F.array_join(F.transform("rows", lambda r: r["row"]), ","))
    raw = F.concat(F.lit('{"success": true, "recordCount": '), (F.when(i % 31 == 0, 0).otherwise(n) + F.when(i % 29 == 0, 1).otherwise(0)).cast("string"), F.lit(', "data": ['), data, F.lit("]}"))
    return per.select(i.cast("string").alias("file"), F.when(i % 37 == 0, "nothing").otherwise(raw).alias("raw"))


@query(REC + """, r AS (SELECT * FROM rec WHERE doc_id % 31 <> 0 AND doc_id % 37 <> 0), d AS (SELECT DISTINCT doc_id FROM rec)
SELECT doc_id::VARCHAR AS file, rec_seq AS row, 'no order number' AS problem FROM r WHERE doc_id % 23 = 0 UNION ALL SELECT doc_id::VARCHAR, rec_seq, 'no quantity' FROM r WHERE QTY IS NULL UNION ALL SELECT doc_id::VARCHAR, rec_seq, 'lacks PRICE' FROM r WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id::VARCHAR, NULL, 'no JSON' FROM d WHERE doc_id % 37 = 0 UNION ALL SELECT doc_id::VARCHAR, NULL, 'record count' FROM d WHERE doc_id % 29 = 0 AND doc_id % 37 <> 0 UNION ALL SELECT doc_id::VARCHAR, NULL, 'empty' FROM d WHERE doc_id % 31 = 0 AND doc_id % 37 <> 0""")
def validate_envelopes(spark, d):
    return R.validate_envelopes(_broken(spark, d))
