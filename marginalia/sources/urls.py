"""Which urls are stored: a key table in hash buckets, and Bloom filters that say which buckets need not be read.

    urls/load=K/bucket=B/          a load's distinct urls, sorted
    url_filters/load=K/bucket=B/   cell, bits: one bitmap of 4 KB for some two thousand urls

A url's hash names its bucket and its cell; further hashes name its bits in the cell's bitmap. A load asks for the bitmaps
its urls fall into and reads a bucket's urls only where all bits of one are set: of urls that are new about one in a thousand is looked up in vain.
Buckets and cells follow from a load's size, so every bitmap is equally full and every bucket a file of some tens of megabytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.joins import Stage

#: Bits of a bitmap (fixed by Spark's bitmap functions), bits set per url, urls per bitmap and per bucket.
BITS, HASHES, CELL_URLS, BUCKET_URLS = 32768, 6, 2048, 1 << 20
BROADCAST_ROWS = 200_000  # urls of a batch, some tens of megabytes at most with BROADCAST_BYTES
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Shape:
    """How a load's urls are laid out."""

    load: int
    buckets: int
    cells: int  # per bucket


def shape(load: int, urls: int) -> Shape:
    buckets = max(1, -(-urls // BUCKET_URLS))
    return Shape(load, buckets, max(1, -(-urls // (buckets * CELL_URLS))))


def _bucket(buckets: Column) -> Column:
    return F.pmod(F.xxhash64("url"), buckets).cast("int")


def _cell(cells: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), "url"), cells).cast("int")


def _positions() -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(2 + i), "url"), F.lit(BITS)) for i in range(HASHES)])


def _is_set(bits: Column, position: Column) -> Column:
    """Bit p of a bitmap is bit p % 8 of byte p / 8."""
    byte = F.conv(F.hex(F.substr(bits, (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2.0), position % 8)) % 2 == 1


def keyed(posts: DataFrame, layout: Shape) -> DataFrame:
    """A load's distinct urls with their bucket."""
    return (
        posts.select("url").distinct()
        .withColumn("bucket", _bucket(F.lit(layout.buckets)))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "url")
    )


def filters(urls: DataFrame, layout: Shape) -> DataFrame:
    """The bitmaps of stored urls. A cell's urls meet before bits are set, so no bitmap is shuffled."""
    return (
        urls.select("bucket", _cell(F.lit(layout.cells)).alias("cell"), _positions().alias("p"))
        .repartition("bucket", "cell")
        .select("bucket", "cell", F.explode("p").alias("p"))
        .groupBy("bucket", "cell")
        .agg(F.bitmap_construct_agg("p").alias("bits"))
    )


def known(batch: DataFrame, layouts: list[Shape], urls: DataFrame, bitmaps: DataFrame, stage: Stage) -> DataFrame:
    """The urls of `batch` that are stored. `layouts` has a row per live load; `urls` and `bitmaps` are their tables.

    The batch's urls are counted; few of them prune the folders of both tables at run time. Where no bitmap holds one, no url is read.
    """
    nothing = batch.select("url").where("false")
    if not layouts:
        return nothing
    each = F.array(*[F.struct(F.lit(s.load).alias("load"), F.lit(s.buckets).alias("buckets"), F.lit(s.cells).alias("cells")) for s in layouts])
    asked = batch.select("url").distinct().select("url", F.explode(each).alias("s"))
    asked = stage(asked.select("url", "s.load", _bucket(F.col("s.buckets")).alias("bucket"), _cell(F.col("s.cells")).alias("cell")), "asked")
    # a comparison that holds for all rows: Spark prunes folders at run time by a filtered side only
    asked = asked.where("load > 0")
    likely = stage(bitmaps.join(_fitting(asked), ["load", "bucket", "cell"]).where(may_hold()).select("url", "load", "bucket"), "likely")
    if likely.isEmpty():
        return nothing
    return urls.join(_fitting(likely.where("load > 0")), ["load", "bucket", "url"], "left_semi").select("url").distinct()


def may_hold() -> Column:
    return F.forall(_positions(), lambda p: _is_set(F.col("bits"), p))


def _fitting(rows: DataFrame) -> DataFrame:
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("url")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(rows) if size.n <= BROADCAST_ROWS and size.bytes <= BROADCAST_BYTES else rows
