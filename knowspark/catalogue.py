"""All named queries of the engine, the SQL that gives the same rows, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .queries import ORACLE, QUERIES, analysis, analytics, documents, language

__all__ = ["ORACLE", "QUERIES", "analysis", "analytics", "documents", "flagship", "language"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid recall in the query language: filtered, ranked by text and by vector, fused."""
    q = f'MATCH Hybrid WHERE doc_id >= 0 SIMILAR TO "{language.WORDS}" USING EMBEDDING bench LIMIT 10 RETURN doc_id'
    return language.engine(spark, sf_dir).run(q)
