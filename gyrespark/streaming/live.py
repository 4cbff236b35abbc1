"""Streaming forms of the batch operators that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def gap_sessions(points: DataFrame, key: str, time: str, max_gap: str, lateness: str) -> DataFrame:
    """Live tracks as sessions that close after ``max_gap`` without a point."""
    live = points.withWatermark(time, lateness)
    return live.groupBy(key, F.session_window(time, max_gap).alias("_w")).agg(
        F.count(F.lit(1)).alias("n_points"), F.min(time).alias("first_time"), F.max(time).alias("last_time")
    ).drop("_w")


def windowed_density(points: DataFrame, time: str, x: F.Column, y: F.Column, width: str, lateness: str) -> DataFrame:
    """Points per cell and time window."""
    live = points.withWatermark(time, lateness)
    return live.groupBy(F.window(time, width).alias("_w"), x.alias("x_bin"), y.alias("y_bin")).agg(
        F.count(F.lit(1)).alias("density")).select(F.col("_w.start").alias("window_start"), "x_bin", "y_bin", "density")


def write_by_batch(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append finished rows to parquet with exactly-once file commits."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
