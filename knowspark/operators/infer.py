"""Constraint inference from data: NOT NULL, UNIQUE and RANGE, all of a table's columns in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(property, rows, present, distinct, low, high); low and high of numbers only."""
    num = [isinstance(df.schema[c].dataType, T.NumericType) for c in columns]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"p{i}"), F.countDistinct(c).alias(f"d{i}")]
        aggs += [(f(F.col(c)) if num[i] else F.max(F.lit(None))).cast("double").alias(f"{n}{i}") for f, n in ((F.min, "l"), (F.max, "h"))]
    rows = [F.struct(F.lit(c).alias("property"), F.col("n").alias("rows"), F.col(f"p{i}").alias("present"), F.col(f"d{i}").alias("distinct"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high")) for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def not_null(profiled: DataFrame, share: float = 0.9) -> DataFrame:
    out = profiled.select("property", (F.col("present") / F.col("rows")).alias("confidence"))
    return out.where(F.col("confidence") >= share)


def unique(profiled: DataFrame, least: float = 0.9) -> DataFrame:
    """Confidence = 1 - surplus rows of repeated values / rows that have one; at least two are needed."""
    out = profiled.where("present >= 2").select("property", (F.col("distinct") / F.col("present")).alias("confidence"))
    return out.where(F.col("confidence") >= least)


def value_range(profiled: DataFrame) -> DataFrame:
    return profiled.where("low is not null and low < high").select("property", "low", "high")
