from __future__ import annotations

from pyspark.sql import functions as F

from ophelion.streaming import events

ROWS = [(1, "2024-01-01 00:00:10", 1.0), (1, "2024-01-01 00:01:00", 3.0), (1, "2024-01-01 02:00:00", 5.0), (2, "2024-01-01 00:00:20", 7.0), (2, "2024-01-01 00:00:20", 7.0)]


def run(spark, tmp_path, name, f):
    src = str(tmp_path / "in")
    spark.createDataFrame(ROWS, "k int, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k int, ts timestamp, v double").parquet(src)
    q = f(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_windows(spark, tmp_path):
    rows = run(spark, tmp_path, "w", lambda s: events.windowed_stats(s, ["k"], "ts", "v").select("k", "samples", "mean"))
    assert sorted(rows) == [(1, 2, 2.0), (2, 2, 7.0)]  # the last window is still open


def test_once(spark, tmp_path):
    assert len(run(spark, tmp_path, "o", lambda s: events.once(s, ["k", "ts"], "ts"))) == 4


def test_recordings(spark, tmp_path):
    rows = run(spark, tmp_path, "r", lambda s: events.recordings(s, ["k"], "ts").select("k", "samples"))
    assert sorted(rows) == [(1, 2), (2, 2)]
