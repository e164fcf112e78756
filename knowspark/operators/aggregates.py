"""Grouped counts over objects, and the conventional analytics beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extended states count as draft in the metrics.
MAIN_STATES = ("active", "archived", "deleted", "draft", "verified", "superseded")


def count_by_type(v: DataFrame) -> DataFrame:
    return v.where(F.col("ko.state") != "deleted").groupBy(F.col("ko.type_name").alias("type_name")).agg(F.count(F.lit(1)).alias("objects"))


def lifecycle_metrics(v: DataFrame) -> DataFrame:
    state = F.when(F.col("ko.state").isin(list(MAIN_STATES)), F.col("ko.state")).otherwise("draft")
    return v.groupBy(F.col("ko.type_name").alias("type_name"), state.alias("state")).agg(F.count(F.lit(1)).alias("objects"))


def retention_summary(v: DataFrame, now: int, soon: int) -> DataFrame:
    """Objects without an end, with one ahead, with one within ``soon`` milliseconds, and past it."""
    end = F.col("ko.valid_to")
    return v.agg(
        F.count_if(end.isNull()).alias("unlimited"), F.count_if(end > now).alias("limited"),
        F.count_if((end > now) & (end <= now + soon)).alias("expiring"), F.count_if(end <= now).alias("expired"),
    )


def audit_report(v: DataFrame) -> DataFrame:
    """(type_name, state, objects, with_evidence, verified) inventory."""
    return v.groupBy(F.col("ko.type_name").alias("type_name"), F.col("ko.state").alias("state")).agg(
        F.count(F.lit(1)).alias("objects"), F.count_if(F.size("ko.evidence") > 0).alias("with_evidence"), F.count_if(F.col("ko.epistemic_status") == "verified").alias("verified")
    )


def sum_by(df: DataFrame, key: str, value: Column) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias("total"))


def p95_exact(df: DataFrame, key: str, value: str, p: float = 0.95) -> DataFrame:
    """The value of rank floor(n p) from 0 of each group."""
    from .evals import nearest_rank_rows

    return nearest_rank_rows(df, value, p, [key], share_of_n=True)


def p95_approx(df: DataFrame, key: str, value: str, p: float = 0.95, accuracy: int = 10_000) -> DataFrame:
    return df.groupBy(key).agg(F.percentile_approx(value, p, accuracy).alias(value))
