"""Vector expressions. Products are taken in double precision."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null, empty or zero, or the lengths differ."""
    size = norm(a) * norm(b)
    good = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0)
    return F.when(F.coalesce(good, F.lit(False)), dot(a, b) / size).otherwise(0.0)


def literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


DIMENSIONS = 128


def trigram_vector(text: str | None) -> list[float]:
    """Counts of character trigrams of the lower-case text, padded by two spaces, by a 64-bit djb2 hash modulo 128, to
    length 1; nothing for a text whose letters and digits have fewer than two bytes."""
    import math

    out = [0.0] * DIMENSIONS
    text = text or ""
    if len("".join(c for c in text if c.isalnum()).encode("utf-8", "surrogatepass")) < 2:
        return out
    padded = f"  {text.lower()}  "
    for i in range(len(padded) - 2):
        h = 5381
        for byte in padded[i : i + 3].encode("utf-8", "surrogatepass"):
            h = (h * 33 + byte) & (1 << 64) - 1
        out[h % DIMENSIONS] += 1
    size = math.sqrt(sum(x * x for x in out))
    return [x / size for x in out]


@F.pandas_udf(T.ArrayType(T.FloatType()))
def trigram_embedding(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Embeds texts by their trigrams; each distinct text of a batch once."""
    for s in batches:
        known = {t: trigram_vector(t) for t in s.unique()}
        yield s.map(known)
