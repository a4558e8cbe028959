"""The queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _vocabulary(name: str) -> str:
    """The place of a tokenizer file; the directory is that of the installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.packing import digest, pack

    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary("byte_bpe_50k.json")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.quality import score, train

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.near_dedup import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.fst_tokens import count_tokens

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary("piece_bpe_32k.model"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.decontaminate import find_leaks

    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.html_text import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.warc import round_trip

    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.pitman_yor import score

    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.chat import render, repair

    return render(repair(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.line_dedup import fuzzy_lines

    return fuzzy_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pack_sequences, op4_quality, op5_near_duplicates, op6_token_counts, op7_decontaminate, op8_main_text, op9_archive_round_trip, op2_language_model, op3_role_repair, op10_line_dedup)
}
#: Words of a text, lower-cased, and its five-word shingles; duckdb.
_SHINGLES = r"""
shingled AS (
  SELECT {id} AS id, UNNEST(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s
  FROM (SELECT {id}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM {table}))
"""

ORACLES: dict[str, str] = {
    "op5_near_duplicates": "WITH RECURSIVE " + _SHINGLES.format(id="doc_id", table="documents") + """,
sizes AS (SELECT id, count(*) AS n FROM shingled GROUP BY id),
links AS (
  SELECT a.id AS a, b.id AS b FROM shingled a JOIN shingled b ON a.s = b.s AND a.id < b.id
  JOIN sizes x ON x.id = a.id JOIN sizes y ON y.id = b.id
  GROUP BY a.id, b.id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS other FROM both_ways UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
least_id AS (SELECT id, min(other) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes ON sizes.id = d.doc_id LEFT JOIN least_id ON least_id.id = d.doc_id
""",
    "op7_decontaminate": "WITH " + _SHINGLES.format(id="doc_id", table="documents") + ", " + _SHINGLES.format(id="item_id", table="benchmark").replace("shingled", "wanted", 1) + """,
sizes AS (SELECT id, count(*) AS n FROM wanted GROUP BY id)
SELECT d.id AS doc_id, w.id AS item_id, n AS n_item, count(*) AS n_shared
FROM wanted w JOIN shingled d ON d.s = w.s JOIN sizes ON sizes.id = w.id
GROUP BY d.id, w.id, n HAVING 100 * count(*) >= 80 * n
""",
    "op9_archive_round_trip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(x, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM q
""",
}
