"""Context for a task: score units of knowledge against its words, then pack the best into a token budget.

Scoring is columns over all units; packing is a sequence of decisions over what scored above zero and could still fit,
and runs per task.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Words of a question that earn no credit.
STOPWORDS = ("the", "and", "for", "are", "was", "were", "who", "what", "when", "where", "which", "how", "does", "did", "that", "this", "with", "from", "into")


def task_words(task: str) -> list[str]:
    return [w for w in tx.query_tokens(task) if len(w) >= 3 and w not in STOPWORDS]


def words_of(text: Column) -> Column:
    """The words of a text, those of joined names (camelCase) one by one."""
    return tx.tokens(F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2"))


def keyword_score(own: Column, words: Sequence[str]) -> Column:
    """A point for each task word among a text's words, 0.3 for one that only shares its first four letters."""
    score = F.lit(0.0)
    for w in words:
        near = F.exists(own, _starts(w[:4])) if len(w) >= 4 else F.lit(False)
        score = score + F.when(F.array_contains(own, w), 1.0).when(near, 0.3).otherwise(0.0)
    return score


def _starts(prefix: str):
    return lambda x: x.startswith(prefix)


def prepared(units: DataFrame) -> DataFrame:
    """units (unit, kind, name, text, mentions) with their words, which all tasks share."""
    entity = F.col("kind") == "entity"
    return units.select(
        "unit", "kind", "name", "text", "mentions", F.when(entity, words_of(F.col("name"))).alias("_name"), F.when(entity, words_of(F.concat_ws(" ", "mentions"))).alias("_mentions"),
        F.when(~entity, words_of(F.col("text"))).alias("_text"), F.when(entity, False).otherwise(tx.is_injection(F.col("text"))).alias("_injected"),
    )


def score_units(units: DataFrame, words: Sequence[str]) -> DataFrame:
    """units (unit, kind, name, text, mentions) with a score: names count whole, mentions half, with a bonus for many."""
    own = units if "_injected" in units.columns else prepared(units)
    return own.withColumn("score", _score(words)).drop("_name", "_mentions", "_text", "_injected")


def _score(words: Sequence[str]) -> Column:
    bonus = 1 + F.least(0.1 * F.size(F.coalesce("mentions", F.array().cast("array<string>"))), F.lit(0.5))
    entity = (keyword_score(F.col("_name"), words) + 0.5 * keyword_score(F.col("_mentions"), words)) * bonus
    other = F.when(F.col("_injected"), 0.0).otherwise(keyword_score(F.col("_text"), words))
    return F.when(F.col("kind") == "entity", entity).otherwise(other)


ORDER = {"entity": 0, "fact": 1, "relation": 2}


def pack(rows: pd.DataFrame, budget: int) -> pd.DataFrame:
    """The rows that fit, by kind and score. Entities may take half of the budget, a tie that does not fit whole is left
    out as ambiguous, facts that do not fit are skipped, relations stop at the first that does not, or below half of the
    best. A budget of 0 has no limit."""
    used, out = 0, []
    rows = rows.assign(tokens=[-(-len(t.encode()) // 4) for t in rows["text"]], rank=rows["kind"].map(ORDER))
    rows = rows.drop_duplicates(["kind", "text"])
    for kind, part in rows[rows["score"] > 0].sort_values(["rank", "score", "text"], ascending=[True, False, True]).groupby("kind", sort=False):
        limit = budget // 2 if kind == "entity" else budget
        top = part["score"].max()
        groups = part.groupby("score", sort=False) if kind == "entity" else [(s, part.iloc[[i]]) for i, s in enumerate(part["score"])]
        for s, group in groups:
            if kind == "relation" and s < top / 2:
                break
            need = int(group["tokens"].sum())
            if budget and used + need > limit:
                if kind == "fact":
                    continue
                break
            used += need
            out.append(group)
    return pd.concat(out) if out else rows.iloc[:0]


PARTS = 64


def _top(rows: DataFrame, by: Sequence[str], holds: Column) -> DataFrame:
    """The rows of each group whose number ``_n`` by score and text holds; found in parts first, so that no group is one task's."""
    for part in ([F.pmod(F.xxhash64("unit"), F.lit(PARTS))], []):
        order = Window.partitionBy(*by, *part).orderBy(F.col("score").desc(), "text")
        rows = rows.withColumn("_n", F.row_number().over(order)).where(holds).drop("_n")
    return rows


def reduced(rows: DataFrame, budget: int) -> DataFrame:
    """Of distinct scored rows (task, unit, kind, text, score, tokens) those that ``pack`` can still reach; it packs them the same.

    Only an empty text needs no token, so entities and relations, which stop at what does not fit, end before
    ``budget`` + 2. Facts are skipped, but where one does not fit, no later one of its size does: of a size, at most as
    many as the budget holds are taken, and those are the first.
    """
    fact = F.col("kind") == "fact"
    facts = _top(rows.where(fact & (F.col("tokens") <= budget)), ("task", "tokens"), F.col("_n") * F.greatest("tokens", F.lit(1)) <= max(budget, 1))
    return _top(rows.where(~fact), ("task", "kind"), F.col("_n") <= budget + 2).unionByName(facts)


def compile_context(units: DataFrame, tasks: DataFrame, budget: int = 300) -> DataFrame:
    """(task, unit, kind, text, score, tokens) for tasks (task, question).

    Tasks are few and known to the caller, and all are scored in one scan. Of copies of a text within a kind the best
    counts. Packing gets every unit that could still fit; without a budget nothing has to be packed.
    """
    asked = [F.struct(F.lit(r.task).alias("task"), _score(task_words(r.question)).alias("score")) for r in tasks.collect()]  # one for each question that was asked
    scored = prepared(units).select("unit", "kind", "text", F.explode_outer(F.array(*asked)).alias("_s"))  # outer: else the optimiser scores twice
    scored = scored.select("_s.task", "unit", "kind", "text", "_s.score").where("score > 0")
    best = scored.groupBy("task", "kind", "text").agg(F.min(F.struct((-F.col("score")).alias("s"), "unit")).alias("_b"))
    rows = best.select("task", "_b.unit", "kind", "text", (-F.col("_b.s")).alias("score"), tx.token_estimate(F.col("text")).alias("tokens"))
    if not budget:
        most = F.max("score").over(Window.partitionBy("task", "kind"))
        relations = rows.where("kind = 'relation'").withColumn("_most", most).where("score >= _most / 2").drop("_most")
        return rows.where("kind <> 'relation'").unionByName(relations)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pack(pdf, budget)[["task", "unit", "kind", "text", "score", "tokens"]]

    return reduced(rows, budget).groupBy("task").applyInPandas(run, f"task {kinds['task']}, unit {kinds['unit']}, kind string, text string, score double, tokens long")
