"""Streaming forms: event-time windows, first-seen state and idempotent alert sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.plans.materialize import upsert_alerts


def event_counts(events: DataFrame, size: str = "7 days", slide: str | None = None, late: str = "1 day", ts: str = "ts", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts in tumbling (or, given ``slide``, sliding) windows; rows later than ``late`` are left out of closed windows."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = events.withWatermark(ts, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select("window.start", "window.end", *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions of a key that end after a gap."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, "session_window.start", "session_window.end", "n")


def first_seen(rows: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def read_stream(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def alert_sink(stream: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Upserts each batch of alerts by key; a batch that is run again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        save(upsert_alerts(load(), batch.dropDuplicates(["alert_key"]), number))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
