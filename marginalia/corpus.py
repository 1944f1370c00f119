"""The `posts` view over the given tables: documents with their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    seconds = F.lit(1577836800) + (F.col("doc_id") * 37 % 1000) * 86400 + F.col("doc_id") % 86400
    tags = F.array_compact(
        F.array(
            F.col("source"),
            F.when(F.col("quality") == 1, F.lit("quality")),
            F.when(F.col("toxic") == 1, F.lit("toxic")),
        )
    )
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.regexp_extract("text", r"^[^\n]{0,80}", 0).alias("title"),
        F.col("text").alias("content"),
        F.concat(F.lit("https://corpus.example/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.timestamp_seconds(seconds).alias("date"),
        F.col("lang").alias("category"),
        tags.alias("tags"),
    )
