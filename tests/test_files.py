"""Sources, sinks, reports, prompts and the stream, with files."""

import json

import pytest
from pyspark.sql import functions as F

from spanforge.functions import scalar as C
from spanforge.operators import anonymize as N
from spanforge.operators import compare as A
from spanforge.operators import layout as L
from spanforge.operators import matching as M
from spanforge.operators import prompts as Q
from spanforge.operators import records as R
from spanforge.operators import report as T
from spanforge.plans.extract import by_proposal, deterministic
from spanforge.schema import FIELDS
from spanforge.sources import builders as B
from spanforge.streaming.spans import SPAN_SCHEMA, extract_stream
from tests.test_layout import frame, page


def put(folder, **files):
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text, encoding="utf-8")
    return f"file://{folder}"


def test_documents_are_listed_and_decoded(spark, tmp_path):
    path = put(tmp_path, b__pdf="107,21, 6AB1 |125.4,21.6,6AB2", a__pdf="5,5,x|6,6,  ", c__txt="no")
    assert [r.path.rsplit("/", 1)[1] for r in B.list_documents(spark, path).collect()] == ["a.pdf", "b.pdf"]
    with pytest.raises(FileNotFoundError):
        B.list_documents(spark, path, "*.xls")

    def decoder(content):
        for part in content.decode().split("|"):
            y, x, text = part.split(",")
            yield 1, float(y), float(x), text

    got = {(r.doc_id.rsplit("/", 1)[1], r.span_seq, r.y, r.x, r.text) for r in B.decode_documents(spark, path + "/*.pdf", decoder).collect()}
    assert got == {("b.pdf", 0, 107, 21, "6AB1"), ("b.pdf", 1, 125, 22, "6AB2"), ("a.pdf", 0, 5, 5, "x")}


def test_pages_are_cut_into_bands(spark, tmp_path):
    path = put(tmp_path, a__pdf="ab")
    assert B.band_edges(0.2, 0.8, 3) == [pytest.approx(x) for x in ((0.2, 0.4), (0.4, 0.6), (0.6, 0.8))] and B.band_edges(0, 1, 0) == [(0.0, 1.0)]

    def renderer(content, dpi, edges):
        for letter in content.decode():
            yield [f"{letter}{dpi}{round(a, 2)}".encode() for a, _ in edges]

    got = [(r.page, r.band, r.image) for r in B.page_bands(spark, path, renderer, 2, dpi=72, crop_top=0.5).collect()]
    import base64

    assert [(p, b, base64.b64decode(i).decode()) for p, b, i in got] == [(1, 1, "a720.5"), (1, 2, "a720.75"), (2, 1, "b720.5"), (2, 2, "b720.75")]
    assert B.page_bands(spark, path, renderer, 2, max_pages=1).count() == 2
    asked = Q.image_prompt(B.page_bands(spark, path, renderer, 2), "Rules.", 2, True).first()
    assert asked.prompt.startswith("Rules.\nPage 1, band 1 of 2.") and "recordCount" in asked.prompt


def envelope(**change):
    row = dict.fromkeys(FIELDS, "") | {"ORD_NO": "6A1", "QTY": 2.0, "PRICE": 3.0}
    return json.dumps({"success": True, "recordCount": 1, "data": [row]} | change)


def test_result_files(spark, tmp_path):
    bad = json.loads(envelope())["data"][0]
    del bad["UNIT"], bad["QTY"]
    path = put(
        tmp_path, result__x__text__json=envelope(), result__y__vision__json=envelope(recordCount=5), result__z__json="oops", result__n__json='{"success": true}', result__e__json=envelope(data=[], recordCount=0),
        result__m__json=envelope(data=[bad | {"ORD_NO": " "}, None], recordCount=2), other__json="{}",
    )
    got = {(r.file, r.row, r.problem) for r in R.validate_envelopes(B.envelope_texts(spark, path)).collect()}
    assert got == {
        ("result.y.vision.json", None, "record count"), ("result.z.json", None, "no JSON"), ("result.n.json", None, "no data"), ("result.n.json", None, "record count"), ("result.e.json", None, "empty"),
        ("result.m.json", 1, "no order number"), ("result.m.json", 1, "no quantity"), ("result.m.json", 1, "lacks QTY,UNIT"), ("result.m.json", 2, "no object"),
    } - {("result.n.json", None, "record count")}
    (tmp_path / "result.z.json").unlink()
    routes = {r.file: r.route for r in B.result_files(spark, path).collect()}
    assert routes["result.x.text.json"] == "text layer" and routes["result.y.vision.json"] == "page image" and routes["result.e.json"] == "unknown" and len(routes) == 5


def test_specifications_are_read_whole(spark, tmp_path):
    path = put(tmp_path, a__md="one\ntwo", b__md="three")
    assert {r.file: r.value for r in B.spec_texts(spark, path).collect()} == {"a.md": "one\ntwo", "b.md": "three"}
    sample = spark.createDataFrame([(1, 2, ["No", None], ["0=6A|1=x"])], "doc_id long, n int, headers array<string>, rows array<string>")
    asked = Q.arm_prompt(sample, ["one\ntwo", "three"]).first().prompt
    assert asked.startswith("one\ntwo\n\nthree\n\n") and "headers: 0=No | 1=\n0=6A|1=x\n" in asked and asked.endswith("length 2")


def test_envelopes_and_reports_are_written(spark, tmp_path):
    run = deterministic(frame(spark, page()))
    B.write_envelopes(run["records"], f"file://{tmp_path}/out", "text layer", "2026-01-02 03:04:05", 1.23456)
    e = spark.read.json(f"file://{tmp_path}/out").first()
    assert e.success and e.recordCount == 2 and e._meta.source == "text layer" and e._meta.startedAt == "2026-01-02T11:04:05+08:00" and e._meta.elapsedSec == 1.235
    assert spark.range(1).select(C.time_slug(F.lit("2026-01-02 03:04:05"))).first()[0] == "20260102-110405"
    checks = R.cross_check(run["records"].withColumn("rec_seq", F.col("row_idx")), spark.createDataFrame([(1, "6AB1", "10,220"), (1, "6AB2", "999")], "doc_id long, ORD_NO string, amount_text string"))
    T.write_lines(T.run_report(run, checks), f"file://{tmp_path}/report")
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/report").collect()]
    assert lines == ["records: 2 of 1 documents, codes repaired: 1", "cross-check: 2 verified, 1 mismatches", "1 6AB2: calculated 146.0, amount 999.0"]
    with pytest.raises(Exception, match="(?i)exist"):
        T.write_lines(T.run_report(run, checks), f"file://{tmp_path}/report")
    assert R.repair_count(run["records"].withColumn("MATM_DESC", F.lit("OAV x/(0AV)"))).first()[0] == 2


def test_failed_runs_are_reported(spark):
    spans = frame(spark, page())
    run = by_proposal(spans, spark.createDataFrame([(1, 0, "no")], "doc_id long, run int, raw string"))
    checks = spark.createDataFrame([], "doc_id long, rec_seq int, ORD_NO string, calc double, amount double, ok boolean")
    assert "1 failed: no JSON" in [r.line for r in T.run_report(run, checks).collect()]


def test_batches_are_summed_up(spark, tmp_path):
    files = spark.createDataFrame([(1, 2, 2, 0, True, "a"), (2, 3, 1, 1, None, "b")], "doc_id long, records long, verified long, mismatches long, agreed boolean, mapping string")
    paths = T.write_batch(files, f"file://{tmp_path}", "some:model")
    assert paths[0].endswith("summary.some_model.txt")
    assert [r.value for r in spark.read.text(paths[0]).collect()][-5:] == ["records: 5", "verified: 3 of 5", "mismatches: 1", "headers agree: 1 of 2", "different mappings: 2"]
    assert spark.read.json(paths[1]).first().records == 5 and spark.read.json(paths[2]).count() == 2
    T.write_batch(files, f"file://{tmp_path}", "some:model")
    assert [T.parse_limit(x) for x in (None, "all", "-1", "7", 0)] == [None, None, None, 7, 0]


def test_comparison_report_without_common_keys(spark):
    rec = spark.createDataFrame([(1, "6A", *[""] * 11)], "doc_id long, " + ", ".join(f"{f} string" for f in FIELDS))
    other = rec.withColumn("ORD_NO", F.lit("6B"))
    lines = [r.line for r in T.compare_report(rec, other).orderBy(*T.ORDER).collect()]
    assert lines[1] == "keys found: 0 of 1" and "missing 1 6A" in lines and "extra 1 6B" in lines and any(x.startswith("ORD_NO") and x.endswith("100.0%") for x in lines)
    diffs = A.diff_cells(rec, rec.withColumn("UNIT", F.lit("KG")))
    assert [(r.field, r.shape, r.n) for r in T.shaped_diffs(diffs).collect()] == [("UNIT", "one side empty", 1)]


def test_gate_refuses_failed_audits(spark):
    good = spark.createDataFrame([("a", True)], "column string, passed boolean")
    N.gate(good)
    with pytest.raises(ValueError, match="b"):
        N.gate(good.unionByName(spark.createDataFrame([("b", False)], "column string, passed boolean")))


def test_masks_keep_shape(spark):
    row = spark.createDataFrame([("OAV Net 碼12/(OAV)", "9.50 mm", "99", "113/03/27", "20991231", "soon", "kg", "公尺", "")], "d string, w string, w2 string, y string, y8 string, no string, u string, u2 string, e string")
    s = F.lit(4)
    got = row.select(
        N.desc_like(F.col("d"), s).alias("d"), N.width_like(F.col("w")).alias("w"), N.width_like(F.col("w2")).alias("w2"), N.date_like(F.col("y")).alias("y"), N.date_like(F.col("y8")).alias("y8"),
        N.date_like(F.col("no")).alias("no"), N.unit_like(F.col("u"), s).alias("u"), N.unit_like(F.col("u2"), s).alias("u2"), N.desc_like(F.col("e"), s).alias("e"),
    ).first()
    assert len(got.d) == 17 and got.d[0] == "O" and got.d[:3] == got.d[-4:-1] and got.d[3] == " " and got.d[8] in "甲乙丙丁戊己庚辛壬癸" and got.d[9:11].isdigit() and "Net" not in got.d
    assert (got.w, got.w2, got.y, got.y8, got.no) == ("0.50 mm", "00", "114/03/27", "21001231", "soon")
    assert len(got.u) == 2 and got.u != "kg" and got.u2 in ("公斤", "KG", "YD", "Y2", "PC") and got.e == ""


def test_recorded_answers_are_replayed(spark):
    prompts = M.prompt(spark.createDataFrame([(1, 1, {0: "6A"}), (2, 1, {0: "6B"})], "doc_id long, pick int, cells map<int,string>"))
    recorded = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (9, 0, "z")], "doc_id long, run int, raw string")
    assert sorted(map(tuple, M.replay(prompts, recorded).collect()), key=str) == [(1, 0, "x"), (1, 1, "y"), (2, 0, None)]
    assert {r.doc_id: r.raw for r in M.predict(prompts, lambda texts: [t[-3:] for t in texts]).collect()} == {1: 'A"}', 2: 'B"}'}


def test_prompts_hold_what_they_ask_about(spark):
    spans = frame(spark, page())
    rows, edges, whole = (f(spans).first().prompt for f in (Q.rows_prompt, Q.edges_prompt, Q.whole_prompt))
    assert "R0 " in rows and "6AB1" in rows and '"first"' in rows
    assert "x=21 " in edges and "The table has 10 columns" in edges
    assert "R0: 0=6AB1 | 1=P1" in whole and '"mapping"' in whole and "y=107 " in whole


def test_span_files_stream_into_records(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for k in (1, 2):
        frame(spark, page(), k).coalesce(1).write.mode("append").parquet(src)
        extract_stream(spark, src, out, f"file://{tmp_path}/check").awaitTermination(120)
    got = spark.read.parquet(f"{out}/records")
    assert sorted((r.doc_id, r.ORD_NO, r.batch) for r in got.collect()) == [(1, "6AB1", 0), (1, "6AB2", 0), (2, "6AB1", 1), (2, "6AB2", 1)]
    frame(spark, page(), 1).coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="spread over batches"):
        extract_stream(spark, src, out, f"file://{tmp_path}/check").awaitTermination(120)
    assert [f.name for f in spark.read.schema(SPAN_SCHEMA).parquet(src).schema] == ["doc_id", "page", "span_seq", "y", "x", "text"]


def test_top_without_a_leading_six(spark):
    rows = [(y, x, "7" if y == 107 else t) for y, x, t in page(rules=False)]
    rows = [(y, x, t.replace("6", "9")) for y, x, t in rows]
    got = L.tables(frame(spark, rows)).first()
    assert got.top == 88  # header and both rows share their places
    assert L.tables(frame(spark, [(5, 5, "x"), (9, 5, "y"), (12, 6, "z")])).count() == 0


def test_layout_runs_no_pattern_per_span_and_sorts_once(spark):
    """No pattern runs in any lambda, the page's spans are sorted once, and top and bottom are not
    worked out again inside the filters that use them."""
    plan = L.body_cells(L.tables(frame(spark, page())))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and plan.count("collect_list") == 1
    for start in [i for i in range(len(plan)) if plan.startswith("filter(s#", i)]:
        depth, end = 0, start + len("filter")
        while True:
            depth += (plan[end] == "(") - (plan[end] == ")")
            end += 1
            if not depth:
                break
        inner = plan[start:end]
        assert "array_sort" not in inner and "array_min" not in inner and "CASE WHEN" not in inner, inner
