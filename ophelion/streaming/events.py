"""Continuous versions of the per-series statistics, for sample streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(stream: DataFrame, keys: list[str], time: str, value: str, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Count, mean, least and greatest value per key and time window; samples later
    than ``late`` are dropped and their windows' state is freed."""
    rows = stream.withWatermark(time, late)
    out = rows.groupBy(F.window(time, width, slide or width), *keys).agg(F.count(F.lit(1)).alias("samples"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "samples", "mean", "least", "most")


def once(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first arrival of each key; repeats within the watermark are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def recordings(stream: DataFrame, keys: list[str], time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Start, end and samples of each run of samples without a gap that long."""
    rows = stream.withWatermark(time, late)
    out = rows.groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("samples"))
    return out.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "samples")
