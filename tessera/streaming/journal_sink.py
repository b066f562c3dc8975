"""Event journal as a stream: projection, first claim within a watermark, windows, and an idempotent sink."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.activity import projected

log = logging.getLogger(__name__)


def deduplicated(events: DataFrame, *, key: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, *, ts: str = "ts", delay: str = "1 hour", size: str = "1 hour", by: str = "event_type") -> DataFrame:
    w = events.withWatermark(ts, delay).groupBy(F.window(ts, size), by).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), by, "events", "total")


def write_journal(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch under its own number, so a batch that is written again replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_journal(events: DataFrame, path: str, checkpoint: str, *, publish: Callable[[DataFrame], None] | None = None, trigger: str | None = None) -> StreamingQuery:
    """Runtime events (event_type, metadata, content, ...) projected to safe activities, written, then published.

    The batch is written under its number before it is published; a publication that fails is logged and never fails the
    journal, as watching a run must not break it.  ``trigger`` is a processing time; without one all that is there is taken.
    """

    def sink(batch: DataFrame, number: int) -> None:
        target = f"{path}/batch={number}"
        projected(batch).write.mode("overwrite").parquet(target)
        if publish is not None:
            try:
                publish(batch.sparkSession.read.parquet(target))
            except Exception:
                log.exception("publication of batch %s failed", number)

    started = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (started.trigger(processingTime=trigger) if trigger else started.trigger(availableNow=True)).start()
