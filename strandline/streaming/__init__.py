"""Streaming forms of the operators that have one: sessions of intervals, mates within a watermark, running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], watermark: str) -> DataFrame:
    """merge_within over time: keys, start, end, n of sessions with gaps under `gap`."""
    timed = events.withWatermark(time, watermark)
    out = timed.groupBy(F.session_window(time, gap).alias("s"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def mates(first: DataFrame, second: DataFrame, time: str, within: str) -> DataFrame:
    """Equi-join of two streams on qname and hi, with state for mates that are at most `within` apart."""
    a = first.withWatermark(time, within).alias("a")
    b = second.withWatermark(time, within).alias("b")
    near = F.col(f"b.{time}").between(F.col(f"a.{time}") - F.expr(f"interval {within}"), F.col(f"a.{time}") + F.expr(f"interval {within}"))
    return a.join(b, (F.col("a.qname") == F.col("b.qname")) & (F.col("a.hi") == F.col("b.hi")) & near)


def window_counts(events: DataFrame, time: str, window: str, slide: str | None, keys: list[str], watermark: str) -> DataFrame:
    """Counts in tumbling or sliding windows, with late events dropped after the watermark."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    out = events.withWatermark(time, watermark).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
