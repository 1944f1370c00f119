"""Length buckets that minimise padding, and batches under a token budget inside each bucket.

Lengths are counted over the whole corpus, each length by itself. Dynamic programming over that histogram gives the best `buckets`
bounds; the cost of a bucket is Monge, so each layer is found by halving and takes m log m steps for m lengths. A
bucket's texts, in the order of their ids, form batches of budget // bound texts, one at least. What reaches the driver is one
row per length that occurs, at most as many as the longest text has words.

Null and empty texts have length 0 and share the shortest bucket; a text longer than the budget is a batch of its own; equal
ids are ordered by text; rows without id stand in the order of a hash of their text. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.base import WORD_GAP, saved


def n_words(text: str = "text") -> Column:
    """Words of a text: pieces between gaps, without the empty one a gap at either end leaves."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.size(F.filter(F.split(t, WORD_GAP), lambda w: w != "")).cast("bigint")


def bounds(cells: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Best bucket bounds for (longest, texts, tokens) per cell, ascending: the least sum of bound x texts - tokens."""
    if not cells:
        return []
    top, texts, tokens = (np.array(x, np.int64) for x in zip(*cells))
    texts, tokens = (np.concatenate((np.zeros(1, np.int64), np.cumsum(x))) for x in (texts, tokens))
    m = len(cells)

    def padding(i, j):
        """What a bucket of the cells i to j - 1 wastes."""
        return top[j - 1] * (texts[j] - texts[i]) - (tokens[j] - tokens[i])

    every = np.arange(1, m + 1)
    cost = np.concatenate((np.zeros(1, np.int64), padding(np.zeros(m, np.int64), every)))
    cut = [np.zeros(m + 1, np.int64)]
    for _ in range(min(buckets, m) - 1):
        cost, back = _layer(cost, padding, m)
        cut.append(back)
    out, j = [], m
    for back in reversed(cut):
        if j:
            out.append(int(top[j - 1]))
            j = back[j]
    return sorted(out)


def _layer(cost: np.ndarray, padding, m: int) -> tuple[np.ndarray, np.ndarray]:
    """One bucket more: for every j the least cost[i] + padding(i, j) over i < j, and that i.

    The best i never falls as j grows. So the middle j of each open stretch is tried between its neighbours' i only, all
    stretches of one depth at once.
    """
    new, back = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    lo, hi = np.array([1]), np.array([m])  # stretches of j still open
    least, most = np.array([0]), np.array([m - 1])  # where their i may lie
    while len(lo):
        mid = (lo + hi) // 2
        many = np.minimum(most, mid - 1) - least + 1
        first = np.cumsum(many) - many
        i = np.arange(many.sum()) - np.repeat(first - least, many)
        tries = cost[i] + padding(i, np.repeat(mid, many))
        new[mid] = np.minimum.reduceat(tries, first)
        at = np.where(tries == np.repeat(new[mid], many), i, m)
        back[mid] = best = np.minimum.reduceat(at, first)
        left, right = lo < mid, mid < hi
        lo, hi, least, most = (
            np.concatenate((lo[left], mid[right] + 1)),
            np.concatenate((mid[left] - 1, hi[right])),
            np.concatenate((least[left], best[right])),
            np.concatenate((best[left], most[right])),
        )
    return new, back


def numbered(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """Adds `rank` (from 0) within `by`: rows are dealt by ranges of (by, order), each range counts its own, and what stands in earlier ranges is added."""
    by_range = df.withColumns({f"_o{k}": c for k, c in enumerate(order)})
    keys = [f"_o{k}" for k in range(len(order))]
    ranged = saved(by_range.repartitionByRange(by, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range and bucket
    sizes = sizes.select(by, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range", by).orderBy(*keys)) - 1
    placed = ranged.withColumn("_own", own).join(F.broadcast(sizes), [by, "_range"])
    return placed.withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_range", *keys)


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 8, budget: int = 16384) -> DataFrame:
    """Per row doc_id, n_tokens, bucket (from 0), bucket_length, batch (from 0 within the bucket), padding."""
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select("doc_id", (n_words() if length is None else length).cast("bigint").alias("n_tokens"), text.alias("th"))
    # equal rows are told apart by where they stand, so that they too can be dealt to several ranges
    rows = saved(rows.withColumn("place", F.monotonically_increasing_id()), "lengths")
    n = F.col("n_tokens")
    cells = rows.groupBy("n_tokens").agg(F.count("*").alias("texts")).orderBy("n_tokens").collect()
    best = bounds([(r.n_tokens, r.texts, r.n_tokens * r.texts) for r in cells], buckets)
    bucket = sum(((n > b).cast("int") for b in best[:-1]), F.lit(0))
    bound = F.element_at(F.array(*[F.lit(b).cast("bigint") for b in best or [0]]), F.col("bucket") + 1)
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.col("th"))
    placed = numbered(rows.withColumn("bucket", bucket), "bucket", [order, F.col("th"), F.col("place")]).withColumn("bucket_length", bound)
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1))))
    return placed.select(
        "doc_id", "n_tokens", "bucket", "bucket_length", F.floor(F.col("rank") / per).cast("bigint").alias("batch"), (F.col("bucket_length") - n).alias("padding")
    )
