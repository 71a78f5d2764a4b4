"""Streams of observations. An extension: the batch operators' meaning over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, ts: str, by: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum per window and group; rows later than ``late`` are dropped and state is bounded by it."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def latest(stream: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The newest value per key as the stream goes on (update mode)."""
    return stream.groupBy(key).agg(F.max(ts).alias(ts), F.max_by(value, ts).alias(value))


def once(write: Callable[[DataFrame, str], None], folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch under its number, so a batch that runs again replaces itself."""
    return lambda df, batch: write(df, f"{folder}/batch={batch}")
