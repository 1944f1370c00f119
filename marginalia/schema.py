"""Declared schemas; nothing is inferred."""

from pyspark.sql import types as T

POSTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("date", T.TimestampType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("tags", T.ArrayType(T.StringType(), False), False),
    ]
)

# One Atom <entry>; attributes carry the XML source's "_" prefix.
FEED_ENTRY = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("link", T.ArrayType(T.StructType([T.StructField("_href", T.StringType())]))),
        T.StructField("category", T.ArrayType(T.StructType([T.StructField("_term", T.StringType())]))),
        T.StructField("published", T.StringType()),
        T.StructField(
            "content",
            T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_type", T.StringType())]),
        ),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.StringType(), False),
        T.StructField("page", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("range", T.ArrayType(T.LongType())),
        T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("q", T.ArrayType(T.StringType())),
    ]
)
