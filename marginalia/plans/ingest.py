"""Loading posts: only new ones, or everything from scratch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.joins import Stage
from marginalia.sources.feeds import entries_to_posts, loadable, quarantined
from marginalia.sources.store import Store

_ORDER = ["url", "date", "title", "content", "category", "tags"]


def only_new(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Posts whose url is not among the `known` ones (Store.known_urls). Repeats inside the batch all stay."""
    return batch.join(known, "url", "left_anti")


def one_per_url(batch: DataFrame) -> DataFrame:
    """Option: keep one post per url of a batch, the first in loading order.

    A minimum is combined before the shuffle, so a url that fills the batch is no burden.
    """
    return batch.groupBy("url").agg(F.min(F.struct(*_ORDER[1:])).alias("p")).select("url", "p.*")


def number(new: DataFrame, after: int, stage: Stage) -> DataFrame:
    """Give posts their doc_id, counting on from `after` in url order.

    The posts are staged in url ranges first, each sorted and numbered by its own task as it is written; a range's numbers are
    shifted by the sizes of the ranges before it, so no task sees all posts and no text is moved twice.
    """
    ranged = new.repartitionByRange(*_ORDER[:2], "title").sortWithinPartitions(*_ORDER)
    ranged = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "new-posts")  # the range above 33 bits of its rows' numbers
    ranged = ranged.withColumns({"_range": F.shiftright("_at", 33), "_nth": F.col("_at").bitwiseAND((1 << 33) - 1) + 1}).drop("_at")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    # One row per range: as many as there are partitions.
    return (
        ranged.join(F.broadcast(shifts), "_range")
        .withColumn("doc_id", F.lit(after) + F.col("_shift") + F.col("_nth"))
        .drop("_range", "_nth", "_shift")
    )


def append_new(store: Store, batch: DataFrame, dedupe_batch: bool = False, staged: bool = False, source: str | None = None) -> int:
    """Add the batch's new posts and their index entries as one load; returns its number.

    `staged`: the batch is read from files already. A load without new posts leaves a report and nothing else.
    """
    stage = Stage(store.spark)
    try:
        batch = one_per_url(batch) if dedupe_batch else batch
        batch = batch if staged and not dedupe_batch else stage(batch, "batch")
        new = number(only_new(batch, store.known_urls(batch, stage)), store.last_doc_id(), stage)
        return store.report_nothing(source) if new.isEmpty() else store.add(new, source=source, ranged=True)
    finally:
        stage.clear()


def rebuild(store: Store, batch: DataFrame, dedupe_batch: bool = False, source: str | None = None) -> int:
    """Load everything anew; what was stored before stays readable until the new load is committed."""
    stage = Stage(store.spark)
    try:
        return store.add(number(one_per_url(batch) if dedupe_batch else batch, -1, stage), replace=True, source=source, ranged=True)
    finally:
        stage.clear()


def load_feed(
    store: Store, entries: DataFrame, dedupe_batch: bool = False, from_scratch: bool = False, source: str | None = None
) -> int | None:
    """Feed entries to stored posts; returns the load's number. Entries that cannot be loaded are kept in the quarantine.

    A `source` that is committed already (a stream's batch, repeated after a crash) is not looked at again: None.
    """
    if source and store.has_loaded(source):
        return None
    stage = Stage(store.spark)
    try:
        posts = stage(entries_to_posts(entries, raw=True), "feed")
        # before the commit: a load that dies in between is repeated and replaces its own quarantine
        store.set_aside(quarantined(posts), store.next_load())
        if from_scratch:
            return rebuild(store, loadable(posts), dedupe_batch, source)
        return append_new(store, loadable(posts), dedupe_batch, True, source)
    finally:
        stage.clear()


def compact(store: Store) -> int:
    """Fold all loads into one, for a store that many small loads went into; no text is cut again."""
    return store.fold()


def vacuum(store: Store) -> int:
    """Delete what no load that counts needs: loads before the last rebuild, and loads that died. Returns the folders deleted.

    Not while a search or a load is running.
    """
    return store.vacuum()


def load_report(store: Store) -> DataFrame:
    """Time (UTC) and number of newly added posts of each load."""
    return store.loads().select("load", "at", "added")
