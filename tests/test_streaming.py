from pyspark.sql import functions as F

from graphloom.streaming import windows as W


def test_stream_windows_and_first_seen(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i // 4:02d} 00:{i:02d}:00", "k" if i % 2 else "l", float(i)) for i in range(12)]
    d = spark.createDataFrame(rows, "event_id long, t string, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = W.read_stream(spark, f"{tmp_path}/in", d.schema)
    q = W.event_counts(s, "1 day").writeStream.format("memory").queryName("w_counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination(120)
    batch = {(r["start"], r["event_type"]): r["n"] for r in W.event_counts(d, "1 day").collect()}
    assert {(r["start"], r["event_type"]): r["n"] for r in spark.table("w_counts").collect()} == batch and sum(batch.values()) == 12
    q = W.first_seen(s, "event_type").writeStream.format("memory").queryName("w_first").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    q.awaitTermination(120)
    assert spark.table("w_first").count() == 2
