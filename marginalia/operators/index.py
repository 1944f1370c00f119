"""The search index as DataFrames: postings, document frequencies, field statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import token_count
from marginalia.operators import cutting
from marginalia.operators.tokens import token_groups

# Text fields are cut into tokens; exact fields are matched as whole values.
TEXT_FIELDS = ("title", "content")
EXACT_FIELDS = ("tags", "category")


@dataclass(frozen=True)
class Index:
    posts: DataFrame
    postings: DataFrame  # field, bucket, token, doc_id, date, dl, tf, positions
    doc_freq: DataFrame  # field, token, df; a token may have several rows, which add up
    field_stats: DataFrame  # field, n_docs, total_len, avgdl
    days: DataFrame  # day since the epoch, posts of that day; several rows per day add up
    buckets: int = 1  # token buckets the postings are stored in


def text_postings(posts: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Documents, frequency and byte positions per text field and token.

    Put together where the texts lie (`token_groups`). With `vocabulary` (a column `token`) only
    those tokens' rows go on.
    """
    rows = token_groups(posts, "date")
    if vocabulary is not None:
        rows = rows.join(vocabulary.select("token").distinct(), "token", "left_semi")
    return rows.select("field", "token", "doc_id", "date", "dl", "tf", "positions")


def exact_postings(posts: DataFrame) -> DataFrame:
    """The same shape for tags and category, which carry neither frequency nor positions."""
    value = [
        F.transform("tags", lambda t: F.struct(F.lit("tags").alias("field"), t.alias("token"), F.size("tags").alias("dl"))),
        F.array(F.struct(F.lit("category").alias("field"), F.col("category").alias("token"), F.lit(1).alias("dl"))),
    ]
    return posts.select("doc_id", "date", F.explode(F.array_distinct(F.concat(*value))).alias("v")).select(
        "v.field",
        "v.token",
        "doc_id",
        "date",
        F.col("v.dl").cast("bigint").alias("dl"),
        F.lit(1).cast("bigint").alias("tf"),
        F.array().cast("array<bigint>").alias("positions"),
    )


def postings(posts: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    return text_postings(posts, vocabulary).unionByName(exact_postings(posts))


def doc_freq(postings: DataFrame) -> DataFrame:
    """Documents per field and token; one posting row is one document."""
    return postings.groupBy("field", "token").agg(F.count("*").alias("df"))


def stored_sums(posts: DataFrame) -> DataFrame:
    """field_sums() of stored posts, their tokens counted inside tasks a piece at a time."""
    names = ["n_docs", *TEXT_FIELDS, *EXACT_FIELDS]
    rows = posts.select(*TEXT_FIELDS, F.size("tags").alias("tags"), F.lit(1).alias("category"))
    counted = rows.mapInArrow(cutting.token_sums(TEXT_FIELDS), ", ".join(f"{n} bigint" for n in names))
    return counted.agg(*[F.coalesce(F.sum(n), F.lit(0).cast("bigint")).alias(n) for n in names])


def field_sums(posts: DataFrame) -> DataFrame:
    """Corpus size and total field lengths in one row: one pass, no token rows."""
    length = {
        "title": token_count(F.col("title")),
        "content": token_count(F.col("content")),
        "tags": F.size("tags"),
        "category": F.lit(1),
    }
    return posts.agg(
        F.count("*").alias("n_docs"),
        *[F.coalesce(F.sum(c.cast("bigint")), F.lit(0).cast("bigint")).alias(f) for f, c in length.items()],
    )


def field_stats(posts: DataFrame) -> DataFrame:
    """Corpus size, total and average length per field: one row per field."""
    return per_field(field_sums(posts))


def per_field(sums: DataFrame) -> DataFrame:
    """Turn one row of per-field sums into one row per field with its average."""
    rows = [F.struct(F.lit(f).alias("field"), F.col(f).alias("total_len")) for f in TEXT_FIELDS + EXACT_FIELDS]
    return sums.select("n_docs", F.explode(F.array(*rows)).alias("f")).select(
        "f.field", "n_docs", "f.total_len", (F.col("f.total_len") / F.col("n_docs")).alias("avgdl")
    )


def day_counts(posts: DataFrame) -> DataFrame:
    """Posts per UTC day."""
    return posts.groupBy(F.floor(F.unix_timestamp("date") / 86400).alias("day")).agg(F.count("*").alias("n"))


def from_posts(posts: DataFrame, vocabulary: DataFrame | None = None) -> Index:
    """An index derived on the fly; `vocabulary` limits it to the tokens that will be looked up."""
    entries = postings(posts, vocabulary).withColumn("bucket", F.lit(0))
    return Index(posts, entries, doc_freq(entries), field_stats(posts), day_counts(posts))
