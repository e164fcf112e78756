"""Hashes that identify objects and chain events."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fnv1a(raw: bytes) -> int:
    """FNV-1a, 64 bits."""
    h = 0xCBF29CE484222325
    for b in raw:
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return h


@F.pandas_udf(T.StringType())
def fnv1a_hex(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None else f"{fnv1a(t.encode()):016x}")


def hmac_sha256(key: bytes):
    """A column function: HMAC-SHA256 in hex of a text under ``key``."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest())

    return run


def stable_id(*parts: Column) -> Column:
    """A 32-digit id of a source's key columns; the same row gives the same id in every import."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)
