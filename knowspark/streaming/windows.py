"""Event-time windows over event tables and streams: additions of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str, keys: list[str], ts: str = "ts", late: str | None = None) -> DataFrame:
    """Counts and sums per window and keys; ``late`` sets a watermark on streams."""
    if late:
        events = events.withWatermark(ts, late)
    out = events.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "events", "total")


def sliding(events: DataFrame, size: str, step: str, keys: list[str], ts: str = "ts", late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark(ts, late)
    out = events.groupBy(F.window(ts, size, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "events")


def sessions(events: DataFrame, gap: str, key: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    """Sessions of a key: runs of events less than ``gap`` apart."""
    if late:
        events = events.withWatermark(ts, late)
    out = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def rate_limited(events: DataFrame, most: int, key: str, ts: str = "ts", seconds: int = 60, tie: str | None = None) -> DataFrame:
    """Events with ``allowed``: whether they are among the key's first ``most`` in their window.

    Windows of ``seconds`` start at whole multiples of it since 1970; every event counts, refused ones too. Within one
    second ``tie`` gives the order.
    """
    from pyspark.sql import Window

    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    order = [F.col(ts)] + ([F.col(tie)] if tie else [])
    so_far = Window.partitionBy(key, "_window").orderBy(*order)
    rows = events.withColumn("_window", F.floor(at / seconds))
    return rows.withColumn("allowed", F.row_number().over(so_far) <= most).drop("_window")
