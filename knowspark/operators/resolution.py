"""Entity resolution and merging of extracted knowledge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import cosine

NAME_LEAST, NAME_GAP = 0.5, 0.15
VECTOR_LEAST, VECTOR_GAP = 0.4, 0.1
#: Type hints that mean the same.
ALIASES = (("person", "people"), ("organization", "company"), ("organization", "org"), ("location", "place"), ("document", "doc"), ("service", "system"))


def compatible(a: Column, b: Column) -> Column:
    """Whether two type hints may be of one entity: equal, one inside the other, or aliases; no hint fits all."""
    x, y = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    out = (x == "") | (y == "") | x.contains(y) | y.contains(x)
    for p, q in ALIASES:
        out = out | ((x == p) & (y == q)) | ((x == q) & (y == p))
    return out


def name_blocks(name: Column) -> Column:
    """Keys on which similar names meet: each word."""
    return F.array_distinct(tx.space_words(F.lower(name)))


GRAMS = (1, 2, 4, 8)


def _start(n: Column) -> Column:
    """The longest start of a name that ``_pieces`` of a name around it holds."""
    size = F.lit(GRAMS[0])
    for g in GRAMS[1:]:
        size = F.when(F.length(n) >= g, g).otherwise(size)
    return F.substring(n, F.lit(1), size)


def _pieces(n: Column) -> Column:
    """All pieces of a name of the lengths in GRAMS."""
    at = lambda g: F.transform(F.sequence(F.lit(1), F.length(n) - (g - 1)), lambda i: F.substring(n, i, F.lit(g)))
    return F.array_distinct(F.concat(*[F.when(F.length(n) >= g, at(g)).otherwise(F.array().cast("array<string>")) for g in GRAMS]))


def _decide(scored: DataFrame, least: float, gap: float, key: str) -> DataFrame:
    """Best candidate per key, with the verdict: matched, ambiguous (the second is near), unmatched."""
    order = Window.partitionBy(key).orderBy(F.col("score").desc_nulls_last(), "candidate")
    top = scored.withColumn("_r", F.row_number().over(order)).where("_r <= 2")
    out = top.groupBy(key).agg(F.max(F.when(F.col("_r") == 1, F.struct("score", "candidate"))).alias("_b"), F.max(F.when(F.col("_r") == 2, F.col("score"))).alias("_s"))
    score = F.col("_b.score")
    verdict = F.when(score.isNull() | (score < least), "unmatched").when(F.coalesce(score - F.col("_s") < gap, F.lit(False)), "ambiguous").otherwise("matched")
    return out.select(key, F.when(verdict != "unmatched", F.col("_b.candidate")).alias("candidate"), F.coalesce(score, F.lit(0.0)).alias("score"), verdict.alias("verdict"))


def _two(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """The first two rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n <= 2").drop("_n")


def resolve_names(mentions: DataFrame, known: DataFrame, least: float = NAME_LEAST, gap: float = NAME_GAP) -> DataFrame:
    """(mention, candidate, score, verdict) of mentions (mention, name, type_hint) against known (koid, name, type_hint).

    Names meet on shared words, and where one lies within the other, also inside a word: every pair with a name
    similarity above 0, but that an empty name is within none. Mentions with equal name and hint are compared once, and
    of known entities that share both, the two with the smallest ids: no others can be first or second.
    """
    rows = mentions.select("mention", F.col("name").alias("mn"), F.col("type_hint").alias("mt"))
    m = rows.where("mn is not null").select("mn", "mt").distinct()
    k = known.select(F.col("koid").alias("candidate"), F.col("name").alias("kn"), F.col("type_hint").alias("kt")).where("kn is not null").distinct()
    k = _two(k, ("kn", "kt"), F.col("candidate"))
    shared = m.withColumn("b", F.explode(name_blocks(F.col("mn")))).join(k.withColumn("b", F.explode(name_blocks(F.col("kn")))), "b")
    pairs = shared.unionByName(_inside(m, k)).where(compatible(F.col("mt"), F.col("kt"))).select("mn", "mt", "candidate", "kn").distinct()
    scored = pairs.select(F.col("mn").alias("n"), F.col("mt").alias("t"), "candidate", tx.name_similarity(F.col("mn"), F.col("kn")).alias("score"))
    best = _two(scored, ("n", "t"), F.col("score").desc(), F.col("candidate"))
    return _decide(rows.join(best, (F.col("mn") == F.col("n")) & F.col("mt").eqNullSafe(F.col("t")), "left"), least, gap, "mention")


def _inside(m: DataFrame, k: DataFrame) -> DataFrame:
    """Pairs of rows of m (mn, mt) and k (candidate, kn, kt), with a key b, of which one lower-case name contains the other."""
    x, y = F.lower("mn"), F.lower("kn")
    m, k = m.where("mn <> ''"), k.where("kn <> ''")
    around = m.withColumn("b", F.explode(_pieces(x))).join(k.withColumn("b", _start(y)), "b").where(x.contains(y))
    within = m.withColumn("b", _start(x)).join(k.withColumn("b", F.explode(_pieces(y))), "b").where(y.contains(x))
    return around.unionByName(within)


def resolve_vectors(mentions: DataFrame, known: DataFrame, least: float = VECTOR_LEAST, gap: float = VECTOR_GAP) -> DataFrame:
    """The same by cosine of (mention, block, vector) and (koid, block, vector) within blocks; a zero vector is unmatched."""
    k = known.select(F.col("koid").alias("candidate"), "block", F.col("vector").alias("kv"))
    scored = mentions.join(k, "block").select("mention", "candidate", cosine(F.col("vector"), F.col("kv")).alias("score"))
    return _decide(mentions.select("mention").join(scored, "mention", "left"), least, gap, "mention")


def merge_entities(entities: DataFrame) -> DataFrame:
    """Entities (document, name, type_hint, mentions, confidence) by document and normalised name.

    Mentions are united, confidences added up to 1; of the names and hints the least stays.
    """
    key = tx.normalize_name(F.col("name")).alias("key")
    return entities.groupBy("document", key).agg(
        F.min("name").alias("name"), F.min("type_hint").alias("type_hint"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("mentions")))).alias("mentions"), F.least(F.sum("confidence"), F.lit(1.0)).alias("confidence"),
    )


def merge_facts(facts: DataFrame) -> DataFrame:
    """Facts (statement, entities, confidence, trust) by statement; the most trusted source counts."""
    return facts.groupBy("statement").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("entities")))).alias("entities"), F.least(F.sum("confidence"), F.lit(1.0)).alias("confidence"), F.max("trust").alias("trust")
    )


def merge_relations(relations: DataFrame) -> DataFrame:
    return relations.groupBy("subject", "predicate", "object").agg(F.least(F.sum("confidence"), F.lit(1.0)).alias("confidence"))


def commit_plan(merged: DataFrame, resolved: DataFrame, stored: DataFrame) -> DataFrame:
    """What to do with each merged entity: create, update, skip or review; a type that differs blocks.

    merged (mention, name, type_hint, confidence), resolved (mention, candidate, verdict), stored (koid, type_hint, confidence).
    """
    own = merged.join(resolved.select("mention", "candidate", "verdict"), "mention", "left")
    own = own.join(stored.select(F.col("koid").alias("candidate"), F.col("type_hint").alias("st"), F.col("confidence").alias("sc")), "candidate", "left")
    clash = (F.col("verdict") == "matched") & ~compatible(F.col("type_hint"), F.col("st"))
    action = (
        F.when(clash | (F.col("verdict") == "ambiguous"), "review").when(F.coalesce(F.col("verdict") != "matched", F.lit(True)), "create")
        .when(F.col("confidence") > F.coalesce("sc", F.lit(0.0)), "update").otherwise("skip")
    )
    return own.select("mention", "candidate", action.alias("action"), F.when(clash, "blocking").when(F.col("verdict") == "ambiguous", "warning").alias("conflict"))


def import_merge(stored: DataFrame, incoming: DataFrame, run: str, source: str) -> DataFrame:
    """Rows of an import run (koid, payload_hash) against what the source stored before: new, changed, same or gone."""
    a, b = incoming.select("koid", F.col("payload_hash").alias("n")), stored.select("koid", F.col("payload_hash").alias("o"))
    both = a.join(b, "koid", "full_outer")
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "gone").when(F.col("n") != F.col("o"), "changed").otherwise("same")
    return both.select("koid", change.alias("change"), F.lit(run).alias("run"), F.lit(source).alias("source"))
