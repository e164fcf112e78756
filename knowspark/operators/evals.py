"""Evaluation: recall, staleness, contradictions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at_k(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(query, expected, hits, recall) from expected (query, koid) and found (query, koid)."""
    hits = expected.join(found.select("query", "koid").distinct().withColumn("_hit", F.lit(1)), ["query", "koid"], "left")
    out = hits.groupBy("query").agg(F.count(F.lit(1)).alias("expected"), F.count("_hit").alias("hits"))
    return out.withColumn("recall", F.col("hits") / F.col("expected"))


def nearest_rank(values: Column, p: float) -> Column:
    """The element of a sorted array at floor((n - 1) p); no interpolation."""
    return F.element_at(F.array_sort(values), F.floor((F.size(values) - 1) * p).cast("int") + 1)


SMALL = 10_000


def nearest_rank_rows(df: DataFrame, value: str, p: float, by: list[str], share_of_n: bool = False, band: float = 0.001) -> DataFrame:
    """The same by counting instead of gathering, exact at any size of group.

    A quantile sketch gives each group a narrow band that holds the rank; values below it are only counted, those above
    dropped, so what has to be sorted is a thousandth or so of the group; groups up to SMALL are sorted whole. The rank is floor((n - 1) p), or floor(n p)
    with ``share_of_n``; both from 0.
    """
    from pyspark.sql import Window

    own = df.where(F.col(value).isNotNull()).select(F.struct(*by).alias("_g") if by else F.lit(0).alias("_g"), F.col(value).alias("_v"))
    edges = F.percentile_approx("_v", F.array(F.lit(max(0.0, p - band)), F.lit(min(1.0, p + band))), 10_000)
    bounds = own.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), edges.alias("_b"))
    bounds = bounds.withColumn("_b", F.when(F.col("_n") > SMALL, F.col("_b")))
    rows = own.join(bounds, own["_g"].eqNullSafe(bounds["_g"])).drop(bounds["_g"]).where(F.coalesce(F.col("_v") <= F.col("_b")[1], F.lit(True)))
    inside = F.when(F.coalesce(F.col("_v") >= F.col("_b")[0], F.lit(True)), F.col("_v"))
    counts = rows.groupBy("_g", "_n", inside.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    up = Window.partitionBy("_g").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum("_c").over(up))
    rank = F.floor(F.col("_n") * p) if share_of_n else F.floor((F.col("_n") - 1) * p)
    good = F.col("_v").isNotNull() & (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)
    return counts.where(good).select(*[F.col("_g")[c].alias(c) for c in by], F.col("_v").alias(value))


def staleness(df: DataFrame, age: str, p: float = 0.95) -> DataFrame:
    """(objects, mean, most, p): truncated mean, maximum and nearest-rank percentile of an integer age."""
    total = df.agg(F.count(age).alias("objects"), F.floor(F.avg(age)).alias("mean_age"), F.max(age).alias("max_age"))
    rank = nearest_rank_rows(df, age, p, []).select(F.col(age).alias("p_age"))
    return total.join(F.broadcast(rank))  # one row


CHUNK, STRIP = 8192, 256


def contradictions(v: DataFrame, vector: Column, value: Column, block: Column, threshold: float, key: Column) -> DataFrame:
    """(a, b, similarity): all pairs of one block (the type) with similar vectors and different values, a < b.

    A block's vectors are dealt into chunks, and each two chunks meet in one task as matrix products, so a block may be
    of any size and no pair is left out. Pairs near the threshold are computed again term by term, as ``cosine`` does.
    """
    whole = F.when(~F.exists(vector, lambda x: x.isNull()), F.transform(vector, lambda x: x.cast("double")))
    own = v.select(key.alias("k"), whole.alias("v"), value.alias("x"), block.alias("g")).where("g is not null")
    most = own.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    n = -(-most // CHUNK) or 1
    chunk = F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.struct(F.least(c, chunk).alias("i"), F.greatest(c, chunk).alias("j"), (chunk > c).alias("right")))
    rows = own.withColumn("_m", F.explode(meets)).select("g", "_m.i", "_m.j", "_m.right", "k", "v", "x")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}

    def run(rows: pa.Table) -> pa.Table:
        right = rows.column("right").to_numpy()
        sides = [np.flatnonzero(~right), np.flatnonzero(right)]
        same = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
        vectors = [None if x is None else np.array(x) for x in rows.column("v").to_numpy()]
        first, second = sides[0], sides[0] if same else sides[1]
        lefts, rights, scores = [], [], []
        for at in range(0, len(first), STRIP):
            for a, b, s in _near(vectors, first[at : at + STRIP], second, threshold):
                keep = a < b if same else slice(None)
                lefts.append(a[keep])
                rights.append(b[keep])
                scores.append(s[keep])
        a, b = (np.concatenate(x) if x else np.array([], int) for x in (lefts, rights))
        one, two = rows.select(["k", "x"]).take(pa.array(a)), rows.select(["k", "x"]).take(pa.array(b))
        return pa.table([one.column(0), two.column(0), one.column(1), two.column(1), pa.array(np.concatenate(scores) if scores else np.array([], float))], names=["ka", "kb", "xa", "xb", "similarity"])

    pairs = rows.groupBy("g", "i", "j").applyInArrow(run, f"ka {kinds['k']}, kb {kinds['k']}, xa {kinds['x']}, xb {kinds['x']}, similarity double")
    return pairs.where(~F.col("xa").eqNullSafe(F.col("xb")) & (F.col("ka") != F.col("kb"))).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "similarity")


def _near(vectors: list, first: np.ndarray, second: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (of first, of second) with a cosine of at least the threshold, and the cosine; 0 between different lengths."""
    by: list[dict[int, list[int]]] = [{}, {}]
    for out, part in zip(by, (first, second)):
        for i in part:
            out.setdefault(0 if vectors[i] is None else len(vectors[i]), []).append(i)
    for d, a in by[0].items():
        for e, b in by[1].items():
            a, b = np.array(a), np.array(b)
            if d != e or not d:
                x, y = (np.repeat(a, len(b)), np.tile(b, len(a))) if threshold <= 0 else (a[:0], b[:0])
                yield x, y, np.zeros(len(x))
                continue
            m, n = np.stack([vectors[i] for i in a]), np.stack([vectors[i] for i in b])
            sizes = [np.sqrt(np.add.accumulate(t * t, axis=1)[:, -1]) for t in (m, n)]
            with np.errstate(all="ignore"):
                rough = (m @ n.T) / np.outer(*sizes)
                x, y = np.nonzero(~(rough < threshold - 1e-6))
                for at in range(0, len(x), 1 << 16):
                    i, j = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
                    size = sizes[0][i] * sizes[1][j]
                    score = np.add.accumulate(m[i] * n[j], axis=1)[:, -1] / size
                    score[size == 0] = 0.0
                    good = ~(score < threshold)
                    yield a[i[good]], b[j[good]], score[good]
