"""Cleaning a whole table of raw web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.cleaning import clean_html, decode_entities

TITLE = r"(?s)<title[^>]*>(.*?)</title>"


def clean_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, text and its length: one pass, no shuffle."""
    cleaned = pages.select(
        "page_id",
        decode_entities(F.regexp_extract("html", TITLE, 1)).alias("title"),
        clean_html(F.col("html")).alias("text"),
    )
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint"))
