"""What databases and figures tell: schema metadata as entities and relations, figures and images as records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def schema_entities(columns: DataFrame) -> DataFrame:
    """(document, name, type_hint, mentions, confidence) of tables, from (table_name, column_name, data_type)."""
    return columns.groupBy(F.col("table_name").alias("name")).agg(F.array_sort(F.collect_set("column_name")).alias("mentions")).select(
        F.lit("schema").alias("document"), "name", F.lit("Table").alias("type_hint"), "mentions", F.lit(1.0).alias("confidence")
    )


def schema_relations(columns: DataFrame) -> DataFrame:
    """(subject, predicate, object) between tables: a column ``x_id`` or ``x_key`` that another table's name explains."""
    names = columns.select(F.lower("table_name").alias("t"), F.col("table_name").alias("object")).distinct()
    refs = columns.select(F.col("table_name").alias("subject"), F.regexp_extract(F.lower("column_name"), r"^(?:\w_)?(\w+?)_?(?:id|key)$", 1).alias("stem")).where("stem <> ''")
    own = F.regexp_replace(F.col("t"), "s$", "")
    return refs.join(names, refs.stem == own).where("subject <> object").select("subject", F.lit("references").alias("predicate"), "object").distinct()


def value_kinds(values: DataFrame) -> DataFrame:
    """(property, kind): date, number or text, by what at least nine in ten of the values (property, value) look like."""
    share = lambda p: F.avg(F.col("value").rlike(p).cast("int")) >= 0.9
    kind = F.when(share(r"^\d{4}-\d{2}-\d{2}(?:[T ].*)?$"), "date").when(share(r"^[-+]?\d+(?:[.,]\d+)?$"), "number").otherwise("text")
    return values.where(F.col("value").isNotNull()).groupBy("property").agg(kind.alias("kind"))


def visual_index(blocks: DataFrame, key: str) -> DataFrame:
    """(key, figure, page, caption, link) of figure blocks."""
    own = blocks.where("kind = 'figure'")
    caption = F.trim(F.coalesce(F.nullif(F.regexp_extract("text", r"!\[([^\]]*)\]", 1), F.lit("")), F.regexp_replace("text", r"!\[[^\]]*\]\([^)]*\)", "")))
    return own.select(key, F.concat(F.col(key).cast("string"), F.lit("/figure-"), F.col("position").cast("string")).alias("figure"), "page", caption.alias("caption"), F.nullif(F.regexp_extract("text", r"\]\(([^)]*)\)", 1), F.lit("")).alias("link"))


def similar_figures(figures: DataFrame, query: str) -> DataFrame:
    """Figures whose captions share a word with the query."""
    words = F.array(*[F.lit(w) for w in tx.query_tokens(query)]).cast("array<string>")
    return figures.where(F.arrays_overlap(tx.tokens(F.col("caption")), words))
