"""Posts to token rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.text import cut
from marginalia.operators import cutting

TEXTS = ("title", "content")
TASK_TOKENS = 4_000_000  # tokens whose postings a task of a store build sorts and writes


def _fields(posts: DataFrame, *carry: str) -> DataFrame:
    """One row per post and text field, read in a single scan."""
    pair = [F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in TEXTS]
    return posts.select("doc_id", *carry, F.explode(F.array(*pair)).alias("f")).select(
        "doc_id", *carry, "f.field", "f.text"
    )


def _cut_rows(fields: DataFrame, *carry: str) -> DataFrame:
    """One row per token. The outer explode keeps Spark from cutting each text again just to
    test that it has tokens; the one empty row of a text without tokens is dropped after it."""
    parts = fields.withColumn("parts", cut(F.col("text"))).drop("text").withColumn("dl", F.size("parts").cast("bigint"))
    return parts.select("doc_id", *carry, "field", "dl", F.posexplode_outer("parts").alias("ord", "token")).where(
        "token is not null"
    )


def tokens(posts: DataFrame, *carry: str) -> DataFrame:
    """doc_id, field, dl, ord, token (as written): no shuffle, one pass over the text."""
    return _cut_rows(_fields(posts, *carry), *carry)


def _spread(posts: DataFrame, *carry: str) -> DataFrame:
    """Whole texts, dealt and sorted by doc_id: all that is shuffled for cutting."""
    return posts.select("doc_id", *carry, *TEXTS).repartition("doc_id").sortWithinPartitions("doc_id")


def token_offsets(posts: DataFrame, *carry: str) -> DataFrame:
    """Token rows with byte spans, token lower-cased after cutting.

    The whole texts are spread by doc_id before they are cut, and cut and measured where they lie: no
    token row is shuffled or sorted.
    """
    rows = _spread(posts, *carry)
    kinds = "field string, dl bigint, ord int, token string, byte_from bigint, byte_to bigint"
    return rows.mapInArrow(cutting.token_rows(TEXTS, list(carry), lower_cased(posts.sparkSession)), _schema(rows, ["doc_id", *carry], kinds))


def token_groups(posts: DataFrame, *carry: str) -> DataFrame:
    """field, token, doc_id, what is carried, dl, tf and byte positions: one row per document, field and token, put together where the text lies."""
    rows = _spread(posts, *carry)
    schema = T.StructType([*_schema(rows, [], "field string, token string"), *_schema(rows, ["doc_id", *carry], "dl bigint, tf bigint, positions array<bigint>")])
    return rows.mapInArrow(cutting.grouped(TEXTS, list(carry), lower_cased(posts.sparkSession)), schema)


def token_packs(posts: DataFrame, buckets: int, alone: bool, *carry: str, totals: dict[str, int] | None = None) -> DataFrame:
    """token_groups() with the tokens' bucket, brought together by field and bucket as packed binaries: no row per posting is shuffled.

    `alone`: no two rows share a doc_id, so every text is cut where it is read and none is moved. `totals`: tokens per field, where they were
    counted; a task then gets some TASK_TOKENS of them, so that the sort of its rows, which come in sorted runs already, stays in memory.
    """
    rows = posts.select("doc_id", *carry, *TEXTS) if alone else _spread(posts, *carry)
    run = cutting.packed(TEXTS, list(carry), lower_cased(posts.sparkSession), buckets, totals or {})
    packs = rows.mapInArrow(run, "field string, bucket int, piece int, postings binary")
    kinds = T.StructType([*_schema(rows, [], "field string, token string"), *_schema(rows, ["doc_id", *carry], "dl bigint, tf bigint, positions array<bigint>, bucket int")])
    if totals is None:
        dealt = packs.hint("rebalance", "field", "bucket")
    else:
        dealt = packs.repartition(max(8, sum(totals.values()) // TASK_TOKENS), "field", "bucket", "piece")
    return dealt.mapInArrow(cutting.unpacked(list(carry)), kinds)


def _schema(rows: DataFrame, kept: list[str], more: str) -> T.StructType:
    return T.StructType([*[rows.schema[c] for c in kept], *T.StructType.fromDDL(more)])


def lower_cased(spark: SparkSession) -> dict[str, str]:
    """The characters beyond ASCII that Spark's lower() changes, some 1,400, and what it makes of them."""
    key = spark.sparkContext.applicationId
    if key not in _lower_cased:
        code = F.col("id")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        every = spark.range(128, 0x110000).where(~code.between(0xD800, 0xDFFF)).select(char.alias("c"))
        _lower_cased[key] = {r.c: r.l for r in every.select("c", F.lower("c").alias("l")).where("c <> l").collect()}
    return _lower_cased[key]


_lower_cased: dict[str, dict[str, str]] = {}
