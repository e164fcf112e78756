"""Entities, relations, facts and dates from text by patterns; native columns over sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Verbs that relate a subject to an object.
VERBS = (("depends on", "depends_on"), ("uses", "uses"), ("implements", "implements"), ("contains", "contains"), ("is tested by", "tested_by"), ("owns", "owns"), ("is part of", "part_of"))
NAME = r"\p{Lu}[\p{L}\p{N}_]*(?: \p{Lu}[\p{L}\p{N}_]*)*"


def sentences(text: Column) -> Column:
    """Sentences with their end mark, trimmed, without empty ones."""
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\x01"), "\x01")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def facts(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """(document, fact, statement, entities, confidence): sentences that name something."""
    rows = df.select(F.col(key).alias("document"), F.posexplode(sentences(F.col(text_col))).alias("position", "statement"))
    found = F.array_distinct(F.regexp_extract_all("statement", F.lit(rf"(?<=\s){NAME}|{NAME}(?= )"), F.lit(0)))
    rows = rows.withColumn("entities", found).where(F.size("entities") > 0)
    return rows.select("document", F.concat_ws("/", F.col("document").cast("string"), F.col("position").cast("string")).alias("fact"), "statement", "entities", F.lit(0.8).alias("confidence"))


def entities(found: DataFrame) -> DataFrame:
    """(document, name, type_hint, mentions, confidence) of facts."""
    rows = found.select("document", F.explode("entities").alias("name"), "statement")
    hint = F.when(F.col("name").rlike(r"(?i)service|system|engine"), "System").when(F.col("name").rlike(r"(?i)inc|corp|gmbh|ltd|company"), "Organization").otherwise("Concept")
    return rows.groupBy("document", "name").agg(F.first(hint).alias("type_hint"), F.array_sort(F.collect_set("statement")).alias("mentions"), F.lit(0.7).alias("confidence"))


def relations(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """(document, subject, predicate, object, confidence) of sentences with a known verb."""
    rows = df.select(F.col(key).alias("document"), F.explode(sentences(F.col(text_col))).alias("s"))
    found = []
    for verb, predicate in VERBS:
        pattern = rf"({NAME}) {verb} (?:the )?({NAME})"
        found.append(F.when(F.col("s").rlike(pattern), F.struct(F.regexp_extract("s", pattern, 1).alias("subject"), F.lit(predicate).alias("predicate"), F.regexp_extract("s", pattern, 2).alias("object"))))
    out = rows.select("document", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("r"))
    return out.select("document", "r.subject", "r.predicate", "r.object", F.lit(0.7).alias("confidence"))


def temporal(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """(document, statement, at): sentences with a date."""
    rows = df.select(F.col(key).alias("document"), F.explode(sentences(F.col(text_col))).alias("statement"))
    rows = rows.select("document", "statement", F.explode(tx.dates(F.col("statement"))).alias("date"))
    return rows.select("document", "statement", tx.iso_millis(F.col("date")).alias("at")).where("at is not null")


def findings(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """(key, one count for each kind of secret, instruction, injection)."""
    text = F.col(text_col)
    return df.select(key, *tx.secret_counts(text), tx.is_instruction(text).alias("instruction"), tx.is_injection(text).alias("injection"))
