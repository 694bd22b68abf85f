"""Event-time windows for batch and streaming frames alike (an extension: the batch engine has no streams of its own)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, width: str, by: Sequence[str], value: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count and sum by window; `late` is the watermark of a stream."""
    df = df.withWatermark(time, late) if late and df.isStreaming else df
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = df.groupBy(w.alias("w_"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w_.start").alias("window_start"), F.col("w_.end").alias("window_end"), *by, "n", "total")


def sessions(df: DataFrame, time: str, gap: str, by: Sequence[str], value: str, late: str | None = None) -> DataFrame:
    """Count, sum and length of runs of events with no gap over `gap`."""
    df = df.withWatermark(time, late) if late and df.isStreaming else df
    out = df.groupBy(F.session_window(time, gap).alias("w_"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w_.start").alias("session_start"), F.col("w_.end").alias("session_end"), *by, "n", "total")
