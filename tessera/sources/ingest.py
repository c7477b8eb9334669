"""Ingest requests: checks, payloads, pages put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import html_to_text

# The categories that requests may name.
CATEGORIES = ("OWASP", "NIST", "INTERNAL")


def validate(d: DataFrame) -> DataFrame:
    """Adds status and error to requests with category, source_url and document_text. Of the two sources exactly one
    must be there; an empty one counts as absent."""
    url = F.coalesce(F.col("source_url") != "", F.lit(False))
    doc = F.coalesce(F.col("document_text") != "", F.lit(False))
    error = (
        F.when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), F.lit("category"))
        .when(~url & ~doc, F.lit("no source")).when(url & doc, F.lit("two sources"))
    )
    code = F.when(error.isNull(), 202).when(error == "category", 422).otherwise(400)
    return d.withColumn("status", code).withColumn("error", error)


def payload(kind: Column, html: Column, data: Column) -> Column:
    return F.when(kind == "url", html_to_text(html)).otherwise(F.coalesce(data, F.lit("")))


def concat_pages(d: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Pages in order, each followed by a line end."""
    pages = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return d.groupBy(key).agg(pages.alias("__p")).select(key, F.array_join(F.transform("__p", lambda p: F.concat(F.coalesce(p["t"], F.lit("")), F.lit("\n"))), "").alias("text"))
