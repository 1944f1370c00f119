"""A folder of feed files as a stream of loads into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from marginalia.plans.ingest import load_feed
from marginalia.sources.feeds import cut_entries, stream_feeds
from marginalia.sources.store import Store


def start_ingest(
    store: Store, feed_dir: str, checkpoint: str, interval: str | None = None, dedupe_batch: bool = False
) -> StreamingQuery:
    """Load new posts as feed files arrive; one load per micro-batch.

    With `interval` ("100 seconds") the folder is polled for ever, without it what is
    there now is loaded and the query ends. The checkpoint hands each file on once; a batch that is repeated
    after a crash is known by the stream's id and its number, which the load report holds, and left at once.
    One ingest query per store.
    """

    def load(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")  # kept in the checkpoint
        source = f"{stream}/{number}"
        if not store.has_loaded(source):
            load_feed(store, cut_entries(batch), dedupe_batch, source=source)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        stream_feeds(store.spark, feed_dir)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
