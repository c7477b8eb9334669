"""Ingest as a stream: request files arrive in a folder, each batch is checked and written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import payload, validate

SCHEMA = "page_id long, category string, source_url string, document_text string, html string"


def dispatch(batch: DataFrame) -> DataFrame:
    """Checked requests with the text that each brings."""
    kind = F.when(F.col("source_url").isNotNull(), "url").otherwise("text")
    return validate(batch).withColumn("content", F.when(F.col("status") == 202, payload(kind, F.col("html"), F.col("document_text"))))


def start(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """A batch writes to a folder named by its number and replaces what an earlier attempt left there, so that each
    request is in the target once. It ends when all files that are there have been read."""

    def write(batch: DataFrame, number: int) -> None:
        dispatch(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
