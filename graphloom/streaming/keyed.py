"""State by key that outlives windows: first sight for good, bursts against trailing windows, and alerts refreshed in place.

The state lies in the RocksDB provider, so it is bounded by the keys of a partition on disk and not in memory; on a restart it comes back from the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """The provider that the queries of this module need; set it before they start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _FirstSeen(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "at timestamp, doc_id string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        # all rows are read, so that the smallest of a batch counts however it is ordered
        first = min((r["at"], r["doc_id"] or "") for r in rows)
        if not self._seen.exists():
            self._seen.update(first)
            yield Row(key=key[0], first_seen=first[0], first_doc_id=first[1] or None)

    def close(self) -> None:
        pass


def first_seen_for_good(rows: DataFrame, key: str, ts: str = "ts", doc: str = "doc_id") -> DataFrame:
    """(key, first_seen, first_doc_id), once for every key: its first sight, of one batch the earliest row.

    A key that was seen is never new again, however late or long after it comes back, and a row that arrives later keeps the stamp
    that is there, even with an earlier time. Rows without a key or time are left out.
    """
    narrow = rows.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("at"), F.col(doc).cast("string").alias("doc_id")).filter("key IS NOT NULL AND at IS NOT NULL")
    return narrow.groupBy("key").transformWithState(_FirstSeen(), "key string, first_seen timestamp, first_doc_id string", "Append", "None")


class _Bursts(StatefulProcessor):
    def __init__(self, width_ms: int, windows: int, min_count: int, ratio: float):
        self._width, self._windows, self._least, self._ratio = width_ms, windows, min_count, ratio

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # events by window, at most ``windows`` + 1 and what the watermark leaves open
        self._counts = handle.getMapState("counts", "window long", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        fresh: dict[int, int] = {}
        for r in rows:
            w = int(r["ms"] // self._width)
            fresh[w] = fresh.get(w, 0) + 1
        for w, n in fresh.items():
            if self._counts.containsKey((w,)):
                n += self._counts.getValue((w,))[0]
            else:
                self._handle.registerTimer((w + 1) * self._width)
            self._counts.updateValue((w,), (n,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        w = expiredTimerInfo.getExpiryTimeInMs() // self._width - 1
        counts = {k[0]: v[0] for k, v in self._counts.iterator()}
        recent, rate = counts.get(w, 0), sum(counts.get(w - i, 0) for i in range(1, self._windows + 1)) / self._windows
        # windows older than any that may still close
        for old in [x for x in counts if x < w - self._windows]:
            self._counts.removeKey((old,))
        score = recent / max(rate, 1.0)
        if recent >= self._least and score >= self._ratio:
            yield Row(entity=key[0], event_type=key[1], window_end_ms=(w + 1) * self._width, recent=recent, baseline_rate=rate, burst_score=score)

    def close(self) -> None:
        pass


def bursts(events: DataFrame, entity: str = "entity", event_type: str = "event_type", event_id: str = "event_id", ts: str = "ts", hours: int = 24, windows: int = 7, min_count: int = 3, ratio: float = 2.0, late: str = "1 hour") -> DataFrame:
    """(entity, event_type, window_end, recent, baseline_rate, burst_score) of every window that closes with a burst.

    ``recent`` counts the different events of the window, ``baseline_rate`` is the mean of the ``windows`` before it, and the
    score is recent / max(baseline_rate, 1). A window closes when the watermark passes its end; rows later than that are left out.
    An event that is repeated for an entity within ``late`` counts once.
    """
    x = events.select(F.col(entity).cast("string").alias("entity"), F.col(event_type).cast("string").alias("event_type"), F.col(event_id).cast("string").alias("event_id"), F.col(ts).cast("timestamp").alias("ts"))
    x = x.filter("entity IS NOT NULL AND ts IS NOT NULL").withColumn("event_type", F.coalesce("event_type", F.lit(""))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["entity", "event_type", "event_id"])
    timed = x.select("entity", "event_type", "ts", F.unix_millis("ts").alias("ms"))
    out = timed.groupBy("entity", "event_type").transformWithState(_Bursts(hours * 3_600_000, windows, min_count, ratio), "entity string, event_type string, window_end_ms long, recent long, baseline_rate double, burst_score double", "Append", "EventTime")
    return out.select("entity", "event_type", F.timestamp_millis("window_end_ms").alias("window_end"), "recent", "baseline_rate", "burst_score")


class _Alerts(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("alert", "created_at int, score double, times long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        first = latest = None
        n = 0
        for r in rows:
            n += 1
            first = r["created_at"] if first is None else min(first, r["created_at"])
            if latest is None or (r["created_at"], r["score"] or 0.0) >= (latest["created_at"], latest["score"] or 0.0):
                latest = r
        old = self._state.get() if self._state.exists() else None
        created, times = (min(old[0], first), old[2] + n) if old else (first, n)
        self._state.update((created, latest["score"], times))
        yield Row(alert_key=key[0], kind=latest["kind"], entity=latest["entity"], detail=latest["detail"], created_at=created, updated_at=latest["created_at"], score=latest["score"], times=times)

    def close(self) -> None:
        pass


def refreshed_alerts(alerts: DataFrame) -> DataFrame:
    """(alert_key, kind, entity, detail, created_at, updated_at, score, times): in update mode, the state of every alert that a batch touches.

    The earliest time stays; the score is that of the latest sight of the batch; ``times`` counts the sights.
    """
    x = alerts.select("alert_key", "kind", "entity", "detail", F.col("created_at").cast("int").alias("created_at"), F.col("score").cast("double").alias("score")).filter("alert_key IS NOT NULL AND created_at IS NOT NULL")
    return x.groupBy("alert_key").transformWithState(_Alerts(), "alert_key string, kind string, entity string, detail string, created_at int, updated_at int, score double, times long", "Update", "None")
