"""Lineage, journal and the audit chain.

A journal row's hash covers the previous row's hash, so a row can be checked by itself once its predecessor's is at hand.
Chains run per object: building one is a fold over the object's own events, and objects are folded side by side.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
FIELDS = ("prev_hash", "seq", "koid", "version", "kind", "ts", "payload_hash", "signature", "actor", "note")


def own_hash(prev: Column | None = None) -> Column:
    """The chain hash of a journal row: SHA-256 of its fields behind the previous hash."""
    parts = [prev if n == "prev_hash" and prev is not None else F.col(n) for n in FIELDS]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]), 256)


def chain(journal: DataFrame, start: str | None = None) -> DataFrame:
    """The journal with prev_hash and own_hash built, object by object in the order of seq.

    Column ``start`` holds the hash before an object's first row here; without it chains begin.
    """
    cols = [c for c in journal.columns if c not in ("prev_hash", "own_hash", start)]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq").reset_index(drop=True)
        prev, before, own = rows[start][0] if start else GENESIS, [], []
        text = {n: ["-" if pd.isna(x) else str(x) for x in rows[n]] if n in rows else ["-"] * len(rows) for n in FIELDS[1:]}
        for i in range(len(rows)):
            before.append(prev)
            prev = hashlib.sha256("|".join([prev, *(text[n][i] for n in FIELDS[1:])]).encode()).hexdigest()
            own.append(prev)
        return rows[cols].assign(prev_hash=before, own_hash=own)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in journal.select(*cols).schema) + ", prev_hash string, own_hash string"
    return journal.select(*cols, *([start] if start else [])).groupBy("koid").applyInPandas(fold, schema)


def prove(journal: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """(koid, seq, problem) for rows that break the chain, its own hash, or do not match their payload.

    ``payloads`` (koid, version, payload_hash) are recomputed hashes of stored versions; a version that is gone needs a
    journal row of kind ``erased``.
    """
    order = Window.partitionBy("koid").orderBy("seq")
    rows = journal.withColumn("_before", F.coalesce(F.lag("own_hash").over(order), F.lit(GENESIS)))
    fields = [n for n in FIELDS if n not in journal.columns]
    for n in fields:
        rows = rows.withColumn(n, F.lit(None).cast("string"))
    checks = [F.when(F.col("prev_hash") != F.col("_before"), "broken link"), F.when(F.col("own_hash") != own_hash(), "altered")]
    if payloads is not None:
        rows = rows.join(payloads.select("koid", "version", F.col("payload_hash").alias("_payload")), ["koid", "version"], "left")
        rows = rows.withColumn("_erased", F.max(F.when(F.col("kind") == "erased", 1)).over(Window.partitionBy("koid")))
        checks += [F.when(F.col("_payload").isNull() & F.col("_erased").isNull(), "missing payload"), F.when(F.col("_payload") != F.col("payload_hash"), "payload differs")]
    return rows.select("koid", "seq", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("problem"))


def payload_hash(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in columns]), 256)


def trace(versions: DataFrame, journal: DataFrame, koids: DataFrame) -> DataFrame:
    """Versions and events of the given objects (koid), in order."""
    own = versions.join(koids.select(F.col("koid").alias("_k")), F.col("ko.koid") == F.col("_k"), "left_semi")
    own = own.select(F.col("ko.koid").alias("koid"), F.col("ko.version").alias("version"), F.col("ko.origin").alias("origin"), F.col("ko.evidence").alias("evidence"))
    events = journal.join(koids.select("koid"), "koid", "left_semi").select("koid", "version", "seq", "kind", "actor", "ts")
    return own.join(events, ["koid", "version"], "left").orderBy("koid", "version", "seq")


def after(journal: DataFrame, seq: int, koids: DataFrame | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Journal rows after ``seq``, of some objects or kinds."""
    out = journal.where(F.col("seq") > seq)
    if koids is not None:
        out = out.join(koids.select("koid"), "koid", "left_semi")
    return out.where(F.col("kind").isin(list(kinds))) if kinds else out


def independent_sources(v: DataFrame, group: Column, least: int = 2) -> DataFrame:
    """Groups backed by at least ``least`` distinct artifacts of current evidence."""
    rows = v.where(F.col("ko.epistemic_status").isNull() | ~F.col("ko.epistemic_status").isin("superseded", "contradicted"))
    rows = rows.select(group.alias("group"), F.explode("ko.evidence").alias("e"))
    return rows.groupBy("group").agg(F.countDistinct("e.source_artifact").alias("sources")).where(F.col("sources") >= least)


def lineage(edges: DataFrame, start: DataFrame, depth: int = 6) -> DataFrame:
    """What the given objects were derived from."""
    from .graph import traverse

    return traverse(edges, start, depth, "out", "DERIVED_FROM")
