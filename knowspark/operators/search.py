"""Similarity search and rank fusion over views. Every ranking ends in the id, so it is a total order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx


def top(df: DataFrame, k: int, score: str = "score", key: str = "koid") -> DataFrame:
    """The k best rows: a heap in each task, then one merge. A score that is no number ranks last."""
    return df.orderBy(F.nanvl(F.col(score), F.lit(float("-inf"))).desc(), F.col(key)).limit(k)


def ann(df: DataFrame, vector: Column, query: Sequence[float], k: int, key: Column, keep: Sequence[Column] = ()) -> DataFrame:
    """Exact top k by cosine, of rows that have a vector."""
    scored = df.where(vector.isNotNull() & (F.size(vector) > 0))
    return top(scored.select(key.alias("koid"), vx.cosine(vector, vx.literal(query)).alias("score"), *keep), k)


def text_jaccard(df: DataFrame, text: Column, query: str, k: int, key: Column, keep: Sequence[Column] = ()) -> DataFrame:
    """Top k by Jaccard similarity of token sets; rows that score 0 are ranked too.

    Only texts that hold a query word somewhere are cut into words: the others score 0.
    """
    asked = tx.query_tokens(query)
    words = F.array(*[F.lit(w) for w in asked]).cast("array<string>")
    own = df.select(key.alias("koid"), F.when(_holds_any(text, asked), tx.tokens(text)).alias("_words"), *keep)  # a column of its own, so that it is made once
    score = F.when(F.col("_words").isNotNull(), tx.jaccard(F.col("_words"), words)).otherwise(0.0)
    return top(own.select("koid", score.alias("score"), *[c for c in own.columns if c not in ("koid", "_words")]), k)


def _holds_any(text: Column, words: Sequence[str]) -> Column:
    """Whether a text holds one of the words, if only within another."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words], F.lit(False))


K1, B = 1.2, 0.75


def text_bm25(df: DataFrame, text: Column, query: str, k: int, key: Column, keep: Sequence[Column] = ()) -> DataFrame:
    """Top k by BM25 over token sets (each word counts once, length = distinct words), of rows that share a word.

    Document counts come from one aggregation to a single row, which is joined back as a constant; nothing is exploded.
    To be scored, only texts that hold a query word somewhere are cut into words again.
    """
    words = tx.query_tokens(query)
    own = df.select(key.alias("koid"), tx.tokens(text).alias("_words"), *keep)
    if not words:
        return own.where("false").select("koid", F.lit(0.0).alias("score"), *[c for c in own.columns if c not in ("koid", "_words")])
    has = [F.array_contains("_words", w) for w in words]
    counts = own.agg(F.count(F.lit(1)).alias("_n"), F.avg(F.size("_words")).alias("_avg"), *[F.count_if(h).alias(f"_df{i}") for i, h in enumerate(has)])
    own = df.select(key.alias("koid"), F.when(_holds_any(text, words), tx.tokens(text)).alias("_words"), *keep).join(F.broadcast(counts))  # one row
    norm = F.lit(K1 + 1) / (1 + K1 * (1 - B + B * F.size("_words") / F.col("_avg")))
    idf = [F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)) for i in range(len(words))]
    score = sum((F.when(h, x * norm).otherwise(0.0) for h, x in zip(has, idf)), F.lit(0.0))
    kept = [c for c in own.columns if c not in ("koid", "_words", "_n", "_avg") and not c.startswith("_df")]
    # a shared word scores above 0; a filter before the ranking would be pushed down and split the text twice
    return top(own.select("koid", score.alias("score"), *kept), k).where("score > 0")


def token_index(df: DataFrame, text: Column, key: Column) -> DataFrame:
    """The inverted index: a row for each token of each object."""
    return df.select(key.alias("koid"), F.explode(tx.tokens(text)).alias("token"))


def candidates(index: DataFrame, query: str) -> DataFrame:
    """Objects that share a token with the query, and how many."""
    return index.where(F.col("token").isin(tx.query_tokens(query))).groupBy("koid").agg(F.count(F.lit(1)).alias("shared"))


#: Two rank formulas are in use: ranks from 1 within ``k0 + 1 + rank``, and ranks from 0 (the recall path).
RRF_QUERY, RRF_RECALL = 1, 0


def ranked(side: DataFrame, name: str) -> DataFrame:
    """Rank from 1 within a search side, which is a top-k list; only scores above 0 take part."""
    order = Window.orderBy(F.col("score").desc(), F.col("koid"))
    return side.where("score > 0").select("koid", F.row_number().over(order).alias(name))


def fuse_rrf(a: DataFrame, b: DataFrame, k0: int = 60, mode: int = RRF_QUERY) -> DataFrame:
    both = ranked(a, "ra").join(ranked(b, "rb"), "koid", "full_outer")
    part = [F.coalesce(1 / (F.lit(float(k0 + 1)) + F.col(r) - (0 if mode == RRF_QUERY else 1)), F.lit(0.0)) for r in ("ra", "rb")]
    return both.select("koid", (part[0] + part[1]).alias("score")).orderBy(F.col("score").desc(), "koid")


def fuse_weighted(a: DataFrame, b: DataFrame, wa: float, wb: float) -> DataFrame:
    """Weighted sum; a side without the object gives 0."""
    both = a.select("koid", F.col("score").alias("sa")).join(b.select("koid", F.col("score").alias("sb")), "koid", "full_outer")
    score = wa * F.coalesce("sa", F.lit(0.0)) + wb * F.coalesce("sb", F.lit(0.0))
    return both.select("koid", score.alias("score")).orderBy(F.col("score").desc(), "koid")


def fuse_one(side: DataFrame) -> DataFrame:
    return side.orderBy(F.col("score").desc(), "koid")


def recall_similar(v: DataFrame, allowed: Column, vector: Sequence[float] | None, text: str | None, k: int, now: int, mode: str = "rrf", weights: tuple[float, float] = (0.5, 0.5), required: Column | None = None) -> DataFrame:
    """Hybrid recall over a view: readable, live, valid now and as required first, then ranked by one or both sides."""
    from .temporal import valid_at

    own = v.where(allowed & (F.col("ko.state") != "deleted") & valid_at(F.col("ko.valid_from"), F.col("ko.valid_to"), now))
    if required is not None:
        own = own.where(required)
    key, deep = F.col("ko.koid"), max(4 * k, 50)
    a = ann(own, F.col("ko.embedding"), vector, deep, key) if vector is not None else None
    b = text_jaccard(own, tx.object_text(v), text, deep, key) if text is not None else None
    if a is None or b is None or mode in ("vector", "text"):
        side = (a if b is None or mode == "vector" and a is not None else b) if a is not None else b
        return fuse_one(side).limit(k)
    fused = fuse_rrf(a, b, mode=RRF_RECALL) if mode == "rrf" else fuse_weighted(a, b, *weights)
    return fused.orderBy(F.col("score").desc(), "koid").limit(k)


def experiences(v: DataFrame, conditions: Column, outcome: Column, task: str, k: int) -> DataFrame:
    """Past experiences whose reuse conditions all appear in the task, by confidence times word overlap."""
    words = F.array(*[F.lit(w) for w in tx.query_tokens(task)]).cast("array<string>")
    fits = F.size(F.array_except(tx.tokens(F.concat_ws(" ", conditions)), words)) == 0
    overlap = F.size(F.array_intersect(tx.tokens(outcome), words)) / F.greatest(F.size(words), F.lit(1))
    scored = v.where(fits).select(F.col("ko.koid").alias("koid"), (F.coalesce(F.col("ko.confidence.score"), F.lit(0.5)) * overlap).alias("score"))
    return top(scored.where("score > 0"), k)


def memory_search(df: DataFrame, name: Column, description: Column, body: Column, query: str, k: int, key: Column) -> DataFrame:
    """Files by shares of the query's words: three times in the name, twice in the description, half in the body."""
    words = F.array(*[F.lit(w) for w in tx.query_tokens(query)]).cast("array<string>")
    share = [F.size(F.array_intersect(tx.tokens(c), words)) / F.greatest(F.size(words), F.lit(1)) for c in (name, description, body)]
    scored = df.select(key.alias("koid"), (3 * share[0] + 2 * share[1] + 0.5 * share[2]).alias("score"))
    return top(scored.where("score > 0"), k)


def ann_approximate(df: DataFrame, vector: Column, query: Sequence[float], k: int, key: Column, tables: int = 8, bucket: float = 0.7, seed: int = 7) -> DataFrame:
    """Top k by cosine of unit vectors within buckets of random projections; may miss some. Exact search is :func:`ann`."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    own = df.where(vx.norm(vector) > 0).select(key.alias("koid"), vector.alias("_v"))
    unit = own.select("koid", array_to_vector(F.transform("_v", lambda x: x.cast("double") / vx.norm(F.col("_v")))).alias("features"))
    size = sum(x * x for x in query) ** 0.5
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(unit)
    near = model.approxNearestNeighbors(unit, Vectors.dense([x / size for x in query]), k, distCol="_d")
    return top(near.select("koid", (1 - F.col("_d") * F.col("_d") / 2).alias("score")), k)
