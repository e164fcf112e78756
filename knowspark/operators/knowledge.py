"""Questions over extracted knowledge: entities, facts (fact, statement, entities, confidence, ...) and relations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Phrases and what negates them, and words of which only one of two contradicting statements has one.
NEGATIONS = (("must", "must not"), ("shall", "shall not"), ("should", "should not"), ("always", "never"), ("required", "optional"), ("enabled", "disabled"), ("sync", "async"))
CONTRARIES = ("not ", "no longer", "instead of", "rather than")


def facts_of(facts: DataFrame, name: str) -> DataFrame:
    return facts.where(F.array_contains("entities", name))


def by_entity(facts: DataFrame) -> DataFrame:
    """A row for each fact and entity that it names: the equi-join form of 'contains'."""
    return facts.select(F.explode("entities").alias("entity"), *[c for c in facts.columns if c != "entities"])


def explain_component(name: str, facts: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of sorted arrays: facts, dependencies, dependents, decisions and tests of a component."""
    own = facts_of(facts, name).agg(
        F.array_sort(F.collect_set("statement")).alias("facts"),
        F.array_sort(F.collect_set(F.when(F.lower("statement").rlike("decid|chose|decision"), F.col("statement")))).alias("decisions"),
    )
    rel = relations.agg(
        F.array_sort(F.collect_set(F.when((F.col("subject") == name) & (F.col("predicate") == "depends_on"), F.col("object")))).alias("dependencies"),
        F.array_sort(F.collect_set(F.when((F.col("object") == name) & (F.col("predicate") == "depends_on"), F.col("subject")))).alias("dependents"),
        F.array_sort(F.collect_set(F.when((F.col("subject") == name) & (F.col("predicate") == "tested_by"), F.col("object")))).alias("tests"),
    )
    return own.join(F.broadcast(rel))  # one row


def explain_decision(docs: DataFrame, text: Column, key: Column) -> DataFrame:
    """(id, section, body): the sections Status, Context, Decision and Consequences of decision records."""
    out = None
    for s in ("Status", "Context", "Decision", "Consequences"):
        body = F.regexp_replace(F.regexp_extract(text, rf"(?ms)^#+\s*{s}\s*$\n(.*?)(?=^#|\z)", 1), r"^\s+|\s+$", "")
        part = docs.select(key.alias("id"), F.lit(s).alias("section"), body.alias("body")).where("body <> ''")
        out = part if out is None else out.unionAll(part)
    return out


def trace_requirement(requirement: str, facts: DataFrame, relations: DataFrame, hops: int = 3) -> DataFrame:
    """(hop, entity, statement): facts of the requirement's entities, then of what those relate to."""
    frontier = by_entity(facts).where(F.lower("statement").contains(requirement.lower())).select("entity").distinct()
    steps = relations.select(F.col("subject").alias("entity"), F.col("object").alias("to"))
    out, seen = None, frontier
    for hop in range(hops):
        rows = by_entity(facts).join(frontier, "entity").select(F.lit(hop).alias("hop"), "entity", "statement").distinct()
        out = rows if out is None else out.unionAll(rows)
        frontier = frontier.join(steps, "entity").select(F.col("to").alias("entity")).distinct().join(seen, "entity", "left_anti")
        seen = seen.unionAll(frontier)
    return out


def fact_pairs(facts: DataFrame) -> DataFrame:
    """Pairs of facts about one entity, each pair once per entity."""
    own = by_entity(facts).select("entity", "fact", "statement", "confidence")
    pairs = own.alias("a").join(own.alias("b"), (F.col("a.entity") == F.col("b.entity")) & (F.col("a.fact") < F.col("b.fact")))
    return pairs.select(
        F.col("a.entity").alias("entity"), F.col("a.fact").alias("a"), F.col("b.fact").alias("b"), F.col("a.statement").alias("sa"), F.col("b.statement").alias("sb"),
        F.col("a.confidence").alias("ca"), F.col("b.confidence").alias("cb"),
    )


def negates(a: Column, b: Column) -> Column:
    """Whether one statement has a phrase, the other its negation, and what is left is of one topic."""
    x, y = F.lower(a), F.lower(b)
    out = F.lit(False)
    for plain, negated in NEGATIONS:
        for p, q in ((plain, negated), (negated, plain)):
            topic = tx.space_jaccard(F.replace(x, F.lit(p), F.lit("")), F.replace(y, F.lit(q), F.lit("")), 1.0)
            out = out | (x.contains(p) & y.contains(q) & (topic > 0.4))
    return out


def contradicts(a: Column, b: Column) -> Column:
    """Whether only one of two statements has a contrary, or both say that different things are used."""
    x, y = F.lower(a), F.lower(b)
    out = F.lit(False)
    for word in CONTRARIES:
        out = out | (x.contains(word) != y.contains(word))
    used = lambda t: F.trim(F.get(F.split(t, "uses"), F.lit(1)))
    both = x.contains("uses") & y.contains("uses") & (used(x) != "") & (used(y) != "") & (used(x) != used(y))
    return out | F.coalesce(both, F.lit(False))


def find_conflicts(facts: DataFrame) -> DataFrame:
    """(entity, a, b, kind): statements on one topic that negate each other, and such as say nearly the same in other words.

    A pair may be both.
    """
    near = tx.space_jaccard(F.col("sa"), F.col("sb"), 1.0)
    kinds = F.array(F.when(negates(F.col("sa"), F.col("sb")), "conflict"), F.when((near > 0.7) & (near < 0.95), "ambiguous"))
    return fact_pairs(facts).select("entity", "a", "b", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


def find_stale(documented: DataFrame, coded: DataFrame) -> DataFrame:
    """(entity, kind): entities that only documents or only code know; both have an entity column."""
    a, b = documented.select("entity").distinct().withColumn("d", F.lit(1)), coded.select("entity").distinct().withColumn("c", F.lit(1))
    both = a.join(b, "entity", "full_outer")
    return both.where("d is null or c is null").select("entity", F.when(F.col("c").isNull(), "documented only").otherwise("undocumented").alias("kind"))


def uncorroborated(documented: DataFrame, coded: DataFrame, most: float = 0.3) -> DataFrame:
    """(entity, fact): documented facts of an entity that no fact from code resembles."""
    a = by_entity(documented).select("entity", "fact", tx.tokens(F.col("statement")).alias("w"))
    b = by_entity(coded).select("entity", tx.tokens(F.col("statement")).alias("v"))
    near = a.join(b, "entity", "left").groupBy("entity", "fact").agg(F.max(F.coalesce(tx.jaccard(F.col("w"), F.col("v")), F.lit(0.0))).alias("best"))
    return near.where(F.col("best") <= most).select("entity", "fact")


def detect_staleness(facts: DataFrame, most: float = 0.85) -> DataFrame:
    """(entity, stale, current, kind) of differing facts on one entity: the surer one is current."""
    low = F.lower("sa"), F.lower("sb")
    pairs = fact_pairs(facts).where((low[0] != low[1]) & (tx.space_jaccard(*low, 0.0) <= most))
    first = F.col("ca") >= F.col("cb")
    kind = F.when(contradicts(F.col("sa"), F.col("sb")), "conflict").otherwise("divergence")
    return pairs.select("entity", F.when(first, F.col("b")).otherwise(F.col("a")).alias("stale"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("current"), kind.alias("kind"))


def validate_change(entities: DataFrame, files: DataFrame) -> DataFrame:
    """(file, affected, score, risk): entities (name, mentions) that a changed file (file, text) names or whose mentions it shares."""
    names = entities.select("name", F.explode(F.array_union(F.array("name"), F.coalesce("mentions", F.array().cast("array<string>")))).alias("m"))
    words = files.select("file", F.explode(tx.tokens(F.col("text"))).alias("w"))
    hits = words.join(names.withColumn("w", F.lower("m")), "w").select("file", "name", F.when(F.lower("name") == F.col("w"), 0.9).otherwise(0.6).alias("s"))
    best = hits.groupBy("file", "name").agg(F.max("s").alias("s"))
    out = best.groupBy("file").agg(F.count(F.lit(1)).alias("affected"), F.max("s").alias("score"))
    return out.withColumn("risk", F.when(F.col("affected") > 10, "high").when(F.col("affected") > 5, "medium").otherwise("low"))


def reconcile(changed: DataFrame, sources: DataFrame, relations: DataFrame) -> DataFrame:
    """(entity, impact): direct where a changed file (file) is an entity's source (entity, file), indirect one hop on."""
    direct = sources.join(changed.select("file").distinct(), "file", "left_semi").select("entity").distinct()
    both = relations.select(F.col("subject").alias("entity"), F.col("object").alias("to")).unionAll(relations.select(F.col("object").alias("entity"), F.col("subject").alias("to")))
    indirect = both.join(direct, "entity", "left_semi").select(F.col("to").alias("entity")).distinct().join(direct, "entity", "left_anti")
    return direct.withColumn("impact", F.lit("direct")).unionAll(indirect.withColumn("impact", F.lit("indirect")))


#: Proposals move along these steps only.
STEPS: Mapping[str, Sequence[str]] = {"PROPOSED": ("VALIDATED", "REJECTED"), "VALIDATED": ("ACCEPTED", "REJECTED"), "ACCEPTED": (), "REJECTED": ()}


def propose(conflicts: DataFrame) -> DataFrame:
    """A proposal for each conflict (entity, a, b, kind); a pair of two kinds has two."""
    pid = F.substring(F.sha2(F.concat_ws("|", "entity", "a", "b", "kind"), 256), 1, 16)
    return conflicts.select(pid.alias("proposal"), "entity", "a", "b", F.when(F.col("kind") == "conflict", "supersede").otherwise("merge").alias("action"), F.lit("PROPOSED").alias("status"))


def advance(proposals: DataFrame, wanted: DataFrame) -> DataFrame:
    """Moves proposals to the wanted (proposal, to) status where that is a legal step; ``moved`` tells whether it was."""
    legal = F.array(*[F.lit(f"{a}>{b}") for a, to in STEPS.items() for b in to])
    out = proposals.join(wanted, "proposal", "left")
    ok = F.coalesce(F.array_contains(legal, F.concat(F.col("status"), F.lit(">"), F.col("to"))), F.lit(False))
    return out.withColumn("moved", ok).withColumn("status", F.when(ok, F.col("to")).otherwise(F.col("status"))).drop("to")


def expand_entity(name: str, facts: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, item): the entity's facts and relations."""
    own = facts_of(facts, name).select(F.lit("fact").alias("kind"), F.col("statement").alias("item"))
    rel = relations.where((F.col("subject") == name) | (F.col("object") == name))
    return own.unionAll(rel.select(F.lit("relation").alias("kind"), F.concat_ws(" ", "subject", "predicate", "object").alias("item")))


def expand_source(document: str, entities: DataFrame, facts: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, item): all that came from a document."""
    parts = ((entities, "entity", F.col("name")), (facts, "fact", F.col("statement")), (relations, "relation", F.concat_ws(" ", "subject", "predicate", "object")))
    out = None
    for df, kind, item in parts:
        part = df.where(F.col("document") == document).select(F.lit(kind).alias("kind"), item.alias("item"))
        out = part if out is None else out.unionAll(part)
    return out


# Rules, reasoning and prediction


def fire_rules(v: DataFrame, rules: Sequence[tuple[str, Mapping[str, object], str]]) -> DataFrame:
    """(rule, koid, conclusion) for rules (name, equalities that must all hold, conclusion), in one scan of the view."""
    fired = []
    for name, conditions, conclusion in rules:
        holds = F.lit(True)
        for prop, value in conditions.items():
            holds = holds & (F.coalesce(F.col(prop) == F.lit(value), F.lit(False)) if prop in v.columns else F.lit(False))
        fired.append(F.when(holds, F.struct(F.lit(name).alias("rule"), F.lit(conclusion).alias("conclusion"))))
    rows = v.select(F.col("ko.koid").alias("koid"), F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull())).alias("r"))
    return rows.select("r.rule", "koid", "r.conclusion")


def predict(ranked: DataFrame, properties: Sequence[str]) -> DataFrame:
    """One row: each property's value in the best-ranked object (koid, score, properties) that has one."""
    order = F.struct((-F.col("score")).alias("s"), F.col("koid").alias("k"))
    return ranked.agg(*[F.min_by(F.col(p), F.when(F.col(p).isNotNull(), order)).alias(p) for p in properties])


def neighbours(scored: DataFrame, links: DataFrame, cap: int = 5, share: float = 0.65) -> DataFrame:
    """Scores (name, score) after each positive anchor lifts its best ``cap`` neighbours (a, b) to a share of its own."""
    pairs = links.join(scored.select(F.col("name").alias("a"), F.col("score").alias("sa")), "a").where("sa > 0")
    pairs = pairs.join(scored.select(F.col("name").alias("b"), F.col("score").alias("sb")), "b")
    best = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.col("sb").desc(), "b"))).where(F.col("_r") <= cap)
    lift = best.groupBy(F.col("b").alias("name")).agg(F.max(F.col("sa") * share).alias("lift"))
    return scored.join(lift, "name", "left").select("name", F.greatest("score", F.coalesce("lift", F.lit(0.0))).alias("score"))
