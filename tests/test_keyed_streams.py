from datetime import datetime, timedelta

import pytest

from graphloom.streaming import keyed as K
from graphloom.streaming import windows as W

T0 = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def provider(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    K.use_keyed_state(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


class Feed:
    """Files that come one after the other, and a query over them that is started again for each."""

    def __init__(self, spark, tmp_path, schema, make, mode):
        self._spark, self._dir, self._schema, self._make, self._mode, self._n = spark, tmp_path, schema, make, mode, 0

    def __call__(self, *rows):
        self._n += 1
        self._spark.createDataFrame(list(rows), self._schema).coalesce(1).write.mode("append").parquet(f"{self._dir}/in")
        got = []

        def keep(batch, _):
            got.extend(tuple(r) for r in batch.collect())

        out = self._make(W.read_stream(self._spark, f"{self._dir}/in", self._spark.createDataFrame([], self._schema).schema))
        # each call is a restart from the checkpoint
        q = out.writeStream.foreachBatch(keep).outputMode(self._mode).option("checkpointLocation", f"{self._dir}/state").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert not q.isActive
        return sorted(got, key=str)


def day(d, h=0):
    return T0 + timedelta(days=d, hours=h)


def test_first_sight_is_for_good(spark, tmp_path):
    feed = Feed(spark, tmp_path, "name string, ts timestamp, doc_id string", lambda s: K.first_seen_for_good(s, "name"), "append")
    assert feed(("a", day(3, 5), "d2"), ("a", day(3), "d1"), ("b", day(4), None), (None, day(1), "x")) == [("a", day(3), "d1"), ("b", day(4), None)]
    # after a restart, ten years on, and with an earlier time: still known
    assert feed(("a", day(3650), "d9"), ("b", day(1), "d0"), ("c", day(2), "d3")) == [("c", day(2), "d3")]


def test_bursts_against_trailing_windows(spark, tmp_path):
    feed = Feed(spark, tmp_path, "event_id long, entity string, event_type string, ts timestamp", lambda s: K.bursts(s, windows=2, min_count=3, ratio=2.0), "append")
    # one event a day, then five on day 2 (one of them twice); other keys stay below
    calm = [(1, "e", "x", day(0, 1)), (2, "e", "x", day(1, 1)), (3, "f", "x", day(2, 1))]
    burst = [(10 + i, "e", "x", day(2, 2 + i)) for i in range(5)]
    assert feed(*calm, *burst, burst[0]) == []
    # restart: the watermark closes day 2; a row for it that comes too late changes nothing
    assert feed((50, "g", "y", day(4))) == [("e", "x", day(3), 5, 1.0, 5.0)]
    assert feed((60, "e", "x", day(2, 3)), *[(70 + i, "e", "x", day(4, 1)) for i in range(3)]) == []
    # against two windows with 5 and 0 events, three are no burst
    assert feed((90, "g", "y", day(8))) == []


def test_alerts_are_refreshed_in_place(spark, tmp_path):
    feed = Feed(spark, tmp_path, "alert_key string, kind string, entity string, detail string, created_at int, score double", K.refreshed_alerts, "update")
    assert feed(("k", "burst", "e", "d", 10, 1.0), ("k", "burst", "e", "d", 12, 2.0), ("m", "new", "f", "d", 11, 1.0)) == [("k", "burst", "e", "d", 10, 12, 2.0, 2), ("m", "new", "f", "d", 11, 11, 1.0, 1)]
    assert feed(("k", "burst", "e", "d", 15, 0.5)) == [("k", "burst", "e", "d", 10, 15, 0.5, 3)]
