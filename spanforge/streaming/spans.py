"""Span files as a stream: documents are independent, so each micro-batch is extracted by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.plans.extract import deterministic

SPAN_SCHEMA = "doc_id long, page int, span_seq int, y int, x int, text string"


def extract_stream(spark: SparkSession, source: str, target: str, checkpoint: str, *, check: bool = True):
    """Starts a query that appends the records of each batch of span files as Parquet, in folders records/ and
    documents/ (the ids seen) by batch.

    A repeated batch writes its own folders again.  A document must not be spread over batches; with
    check, one that an earlier batch has seen fails the stream before anything of its batch is written.
    """

    def batch(df: DataFrame, number: int) -> None:
        ids = df.select("doc_id").distinct()
        if check and number:
            seen = spark.read.parquet(f"{target}/documents").where(f"batch < {number}").select("doc_id")
            again = [r[0] for r in ids.join(seen, "doc_id", "left_semi").limit(5).collect()]
            if again:
                raise ValueError(f"documents spread over batches: {again}")
        ids.write.mode("overwrite").parquet(f"{target}/documents/batch={number}")
        deterministic(df)["records"].write.mode("overwrite").parquet(f"{target}/records/batch={number}")

    return spark.readStream.schema(SPAN_SCHEMA).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
