"""A cleaning pipeline over `documents`: quality, near-duplicates, repeated passages, benchmark passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import minhash, packing, quality, spans, tiling
from marginalia.llm.base import flagged, read, saved, text_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and stay inside their group's fences."""
    return quality.judge(docs.select(COLUMNS)).where("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: the smallest id's, of several texts under that id the one whose hash is lowest.

    Rows are told apart by doc_id and text; equal ones count as one, the first by lang, source and length. Rows without id stay unless they
    equal a document that has one.
    """
    judged = saved(minhash.near_duplicates(docs), "judged")
    named = judged.where("kept and doc_id is not null and n_shingles > 0")
    chosen = named.groupBy("component_id").agg(F.min("th").alias("lowest"), F.max("th").alias("highest")).where("lowest < highest")
    beside = named.join(chosen, "component_id").where("th > lowest").select("doc_id", "th")
    gone = saved(judged.where("not kept").select("doc_id", "th").union(beside).distinct(), "gone")
    repeated = judged.where("doc_id is not null").groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "th")

    def at(keys: DataFrame):
        keys = keys.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
        return keys, rows["doc_id"].eqNullSafe(keys["_id"]) & (rows["th"] == keys["_th"])

    rows = docs.select(COLUMNS).withColumn("th", text_key(docs))
    # most rows are seen to stay by a bitmap; only the others are shuffled to decide
    met = flagged(rows, gone, ["doc_id", "th"], ["doc_id", "th"])
    rows = met.where("_likely").drop("_likely")
    left = rows.join(*at(gone), "left_anti").union(met.where("not _likely").drop("_likely"))
    rows = left
    repeated = saved(repeated, "repeated-rows")
    once = left.join(*at(repeated), "left_semi").groupBy("doc_id", "th").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("row"))
    return left.join(*at(repeated), "left_anti").select(COLUMNS).union(once.select("doc_id", "row.*").select(COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without sentences of passages that stand earlier; documents with no text left go."""
    done = spans.remove_repeats(docs, ["lang", "source"])
    text = F.decode("kept", "UTF-8")
    left = done.where((F.col("n_removed") == 0) | (F.trim(text) != "")).withColumn("text", text)
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = tiling.contaminated(docs, read(spark, sf_dir, "benchmark")).where("contaminated")
    found = found.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    same = docs["doc_id"].eqNullSafe(found["_id"]) & (text_key(docs) == found["_th"])
    return docs.select(COLUMNS).join(found, same, "left_anti")


def length_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: bucket, batch and padding."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("length_buckets", length_buckets),
]

#: Near duplicates and tilings are not for SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
