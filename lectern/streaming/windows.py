"""Event-time windows; the same functions serve batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TIME = "yyyy-MM-dd HH:mm:ss"


def with_event_time(df: DataFrame, column: str = "ts", delay: str | None = None) -> DataFrame:
    """Timestamps with a zone, which watermarks need; late rows beyond ``delay`` are dropped in a stream."""
    out = df.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, delay) if delay else out


def windowed(df: DataFrame, size: str, slide: str | None, by: list[str], value: str) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = df.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.date_format("w.start", _TIME).alias("window_start"), *by, "n", F.round("total", 4).alias("total"))


def sessions(df: DataFrame, gap: str, by: list[str]) -> DataFrame:
    out = df.groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.date_format("w.start", _TIME).alias("session_start"), *by, "n")
