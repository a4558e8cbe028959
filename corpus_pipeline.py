"""Corpus cleaning: every stage is one operator and its decisions take effect on the documents.

Defined results of all stages: a null or empty text fails the quality rules and goes there; of
equal rows, lines and documents the first by id stays, and rows that share an id are one
document; a null id is never linked or dropped as a copy; further columns are carried along
whatever their names; empty tables give an empty result, and without labels of both kinds only
the base rules judge.  A near copy mostly goes in the line stage already, which takes the lines
that it shares with an earlier document; the near-duplicate stage sees what is left of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm.storage import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the classifier reject go."""
    from spanforge.llm.quality import clean, train

    return clean(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal or similar lines the first stays; a document that loses all its words goes."""
    from spanforge.llm.line_dedup import clean

    return clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays; documents are linked from a similarity of 0.8."""
    from spanforge.llm.near_dedup import clean

    return clean(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    from spanforge.llm.decontaminate import clean

    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    import public_tokenizers

    from spanforge.llm.packing import digest, pack

    return digest(pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]
#: Classifier and tokenizer can't be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
