"""Validity and versions.

Validity is half open, ``[from, to)`` in epoch milliseconds, with null for no bound. Versions carry ``commit_ts``, which
is ``millis << 16 | counter``; a snapshot at t holds what was committed at ``commit_ts <= t << 16``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_at(start: Column, end: Column, at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return (start.isNull() | (start <= at)) & (end.isNull() | (end > at))


def overlaps(start: Column, end: Column, a: int, b: int) -> Column:
    """Whether ``[start, end)`` meets ``[a, b)``; an empty validity (start = end) meets nothing."""
    return (start.isNull() | (start < b)) & (end.isNull() | (end > a)) & (start.isNull() | end.isNull() | (start < end))


def commit_ts(millis: Column, counter: Column) -> Column:
    return F.shiftleft(millis.cast("bigint"), 16).bitwiseOR(counter.cast("bigint"))


def latest(versions: DataFrame, key: str = "ko.koid", order: str = "ko.commit_ts") -> DataFrame:
    """The newest row of each key: one aggregation with a partial step, so a key's history is never gathered."""
    rows = versions.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*versions.columns), F.col(order)).alias("_row"))
    return rows.select("_row.*")


def heads(versions: DataFrame) -> DataFrame:
    return latest(versions).where(F.col("ko.state") != "deleted")


def as_of(versions: DataFrame, millis: int) -> DataFrame:
    return latest(versions.where(F.col("ko.commit_ts") <= millis << 16)).where(F.col("ko.state") != "deleted")


def history(versions: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """Every version that is not a deletion, oldest first, of all objects or of those in ``scanned``."""
    own = versions.where(F.col("ko.state") != "deleted")
    if scanned is not None:
        ids = scanned.select(F.col("ko.koid").alias("_koid")).distinct()
        own = own.join(ids, F.col("ko.koid") == F.col("_koid"), "left_semi")
    return own.orderBy("ko.koid", "ko.commit_ts")


def closed(start: Column, end: Column, at: int) -> Column:
    """The end of a validity that is closed at ``at``; one that has not begun collapses to nothing."""
    return F.when(start > at, start).otherwise(F.least(end, F.lit(at)))
