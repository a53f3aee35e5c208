"""Streams of pages and of the question log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.sources.store import PageStore


def upsert_stream(pages: DataFrame, store: PageStore, checkpoint: str, source: str = "stream") -> StreamingQuery:
    """Merges each batch of page records into the store, which writes the buckets that the batch changes. A batch that is
    run again, after a failure, is known by its number and changes nothing; buckets of many parts are written anew, and
    versions but the last two are removed."""

    def merge(batch: DataFrame, number: int) -> None:
        store.merge(batch, f"{source}-{number}")
        store.compact()
        store.vacuum()

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unanswered_rates(log: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window start, reason, n) over the log of unanswered questions(asked_at timestamp, reason, ...); rows that come
    later than `late` are left out once their window is closed."""
    return log.withWatermark("asked_at", late).groupBy(F.window("asked_at", window).alias("w"), "reason").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "reason", "n")
