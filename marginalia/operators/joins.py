"""Joins and numbering that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.session import shared_dir


class Stage:
    """Middle results written to the shared folder and read back.

    Later steps then start from files that survive a lost executor, and Spark knows
    the true size when it decides whether the table may be broadcast.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = shared_dir(spark, "stage")
        self.written = 0

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.written += 1
        path = f"{self.path}/{self.written}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete this stage's own folder, once everything read from it is done."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more rows than this is split over several tasks. Of a table in which very many keys are that frequent, the most frequent
#: are split: the table of split keys never has more than SPLIT_KEYS rows, so it may be broadcast.
PIECE_ROWS, SPLIT_KEYS = 200_000, 100_000


def splits(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _pieces): into how many pieces each frequent key is split. `sizes` has `keys`, each once, and `rows`."""
    piece = F.greatest(F.lit(PIECE_ROWS), F.ceil(sizes.select(F.sum("rows")).scalar() / SPLIT_KEYS))
    return sizes.where(F.col("rows") > piece).select(*keys, F.ceil(F.col("rows") / piece).cast("int").alias("_pieces"))


def spread_join(small: DataFrame, big: DataFrame, keys: list[str], spread_by: str, fits: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """Inner join in which `big` may hold a hot key.

    `fits` says that `small` was counted and may be broadcast; hot keys then do not matter.
    Otherwise `sizes` (keys, rows) says how many rows of `big` a key has, at most: those of a frequent one are dealt by `spread_by` over as
    many pieces as their number asks for, and its rows of `small` are repeated once per piece.
    """
    if fits:
        return big.join(F.broadcast(small), keys)
    if sizes is None:
        return big.join(small, keys)
    split = F.broadcast(splits(sizes, keys))
    pieces = F.coalesce("_pieces", F.lit(1))
    dealt = big.join(split, keys, "left").withColumn("_piece", F.pmod(F.xxhash64(spread_by), pieces).cast("int")).drop("_pieces")
    every = F.explode(F.sequence(F.lit(0), pieces - 1))
    return dealt.join(small.join(split, keys, "left").withColumn("_piece", every).drop("_pieces"), [*keys, "_piece"]).drop("_piece")


def slot(c: Column, df: DataFrame) -> Column:
    """A document's slot: the pieces a request's matches are ranked in before the final ranking."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def top_in_slots(matches: DataFrame, order: list[Column], depth: Column) -> DataFrame:
    """Per request the best `depth` rows, numbered in `rank`, with the request's `total`.

    `matches` carries request_id, slot and doc_id and is already spread by request and slot. Each
    slot keeps its own best rows and hands on its row count, so the final numbering of a
    request sees slots x depth rows, never all its matches.
    """
    per_slot = Window.partitionBy("request_id", "slot").orderBy(*order)
    first = (
        matches.withColumn("_n", F.row_number().over(per_slot))
        .withColumn("_size", F.count("*").over(Window.partitionBy("request_id", "slot")))
        .where((F.col("_n") <= depth) | (F.col("_n") == 1))
    )
    return numbered(first, order)


def numbered(first: DataFrame, order: list[Column]) -> DataFrame:
    """The rows of all slots of a request numbered in `rank`, with its `total`; `_n` is a row's number in its slot, `_size` the slot's count."""
    per_request = Window.partitionBy("request_id")
    return (
        first.withColumn("rank", F.row_number().over(per_request.orderBy(*order)).cast("bigint"))
        .withColumn("total", F.sum(F.when(F.col("_n") == 1, F.col("_size"))).over(per_request))
        .drop("_n", "_size")
    )
