"""From documents to knowledge: blocks, facts, entities, relations, merged and chunked; and only what has changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..lang import tree as t
from ..operators import resolution
from . import chunk, extract
from .blocks import explode_blocks


@dataclass
class Compiled:
    """Lazy results of one compilation."""

    blocks: DataFrame
    facts: DataFrame
    entities: DataFrame
    relations: DataFrame
    dates: DataFrame
    chunks: DataFrame


def compile_documents(docs: DataFrame, text_col: str = "text", key: str = "doc_id", most: int = chunk.MOST) -> Compiled:
    """Secrets are taken out first; everything else is derived from the redacted text."""
    clean = docs.select(key, tx.redact(F.col(text_col)).alias(text_col))
    facts = extract.facts(clean, text_col, key)
    return Compiled(
        explode_blocks(clean, text_col, key), facts, resolution.merge_entities(extract.entities(facts)),
        resolution.merge_relations(extract.relations(clean, text_col, key)), extract.temporal(clean, text_col, key), chunk.chunk_documents(clean, text_col, key, most),
    )


def changes(old: DataFrame, new: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, change): new, changed or gone documents, by hash; unchanged ones are left out."""
    a = new.select(key, F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("_n"))
    b = old.select(key, F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("_o"))
    kind = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "gone").when(F.col("_o") != F.col("_n"), "changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("change")).where("change is not null")


def compile_changed(old: DataFrame, new: DataFrame, key: str = "doc_id", text_col: str = "text") -> Compiled:
    """Only what is new or changed, compiled again."""
    todo = changes(old, new, key, text_col).where("change <> 'gone'").select(key)
    return compile_documents(new.join(todo, key, "left_semi"), text_col, key)


def compile_source(spark: SparkSession, s: t.Ingest) -> DataFrame:
    """The INGEST statement over a file or folder: a row for each thing found."""
    from ..sources.documents import read_documents

    docs = read_documents(spark, s.source)
    out = compile_documents(docs, "text", "path")
    parts = [out.facts.select(F.lit("fact").alias("kind"), F.col("document").alias("source"), F.col("statement").alias("item"))]
    if s.tables:
        parts.append(out.blocks.where("kind = 'table'").select(F.lit("table").alias("kind"), F.lit(s.source).alias("source"), F.col("text").alias("item")))
    if s.entities:
        parts.append(out.entities.select(F.lit("entity").alias("kind"), F.col("document").alias("source"), F.col("name").alias("item")))
    if s.relationships:
        parts.append(out.relations.select(F.lit("relation").alias("kind"), F.lit(s.source).alias("source"), F.concat_ws(" ", "subject", "predicate", "object").alias("item")))
    total = parts[0]
    for p in parts[1:]:
        total = total.unionAll(p)
    return total
