"""Event streams: the batch statistics over tumbling, sliding and session windows with watermarks (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(events: DataFrame, ts: str, value: str, width: str, slide: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    """(start, keys, n, mean, std, min, max) of time windows; works on batches and streams alike."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, width, slide or width).alias("w"), *keys)
    return g.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")).select(F.col("w.start").alias("start"), *keys, "n", "mean", "std", "min", "max")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of sessions that end after a gap."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
    return g.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
