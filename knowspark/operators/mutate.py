"""Mutations as pure functions from heads and a request to new versions; the store appends what they return.

Heads and results are open-world rows of :data:`knowspark.schema.VERSIONS`. A request that finds its object changed, or
asks for an illegal transition, shows in ``problems`` and changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AUTHORITIES, PROPERTIES, SYSTEM, tagged
from .graph import traverse

# The legal steps of epistemic statuses and lifecycle states.
STATUS_STEPS: Mapping[str, Sequence[str]] = {
    "observed": ("asserted", "inferred", "verified", "contradicted", "superseded", "unknown"),
    "asserted": ("verified", "contradicted", "superseded", "unknown"),
    "inferred": ("asserted", "verified", "contradicted", "superseded", "unknown"),
    "verified": ("contradicted", "superseded"),
    "contradicted": ("asserted", "verified", "superseded"),
    "superseded": (),
    "unknown": ("observed", "asserted", "inferred", "verified", "contradicted", "superseded"),
}
STATUS_OF_ORIGIN = {"reason": "inferred", "human": "asserted", "agent": "asserted", "system": "observed", "enrichment": "observed"}


def rank(authority: Column) -> Column:
    """Rank of an authority level, 0 the highest; null where it is not one."""
    at = F.array_position(F.array(*[F.lit(a) for a in AUTHORITIES]), authority)
    return F.when(at > 0, at - 1)


def versioned(rows: DataFrame, at: int, counter: int = 0, **changes: Column) -> DataFrame:
    """The next version of each row, committed at ``at`` milliseconds, with some fields changed."""
    changes = {"version": F.col("version") + 1, "commit_ts": F.lit(at << 16 | counter)} | changes
    return rows.select(*[changes.get(n, F.col(n)).cast(k).alias(n) for n, k in SYSTEM.items()], changes.get("properties", F.col("properties")).cast(PROPERTIES).alias("properties"))


def remember(requests: DataFrame, heads: DataFrame, at: int, seen_keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New versions and problems for requests: rows of VERSIONS with ``expected`` (version, or null) and ``idempotency``.

    An idempotency key that was seen, or comes twice in the batch, writes once. A stale expected version is a problem.
    """
    from pyspark.sql import Window

    if seen_keys is not None:
        requests = requests.join(seen_keys.select(F.col("idempotency").alias("_k")), F.col("idempotency") == F.col("_k"), "left_anti")
    first = Window.partitionBy("idempotency").orderBy("koid")
    requests = requests.withColumn("_n", F.row_number().over(first)).where("idempotency is null or _n = 1").drop("_n")
    now = heads.select(F.col("koid").alias("_koid"), F.col("version").alias("_v"))
    both = requests.join(now, F.col("koid") == F.col("_koid"), "left")
    stale = F.col("expected").isNotNull() & (F.col("expected") != F.coalesce("_v", F.lit(0)))
    good = both.where(~stale).withColumn("version", F.coalesce("_v", F.lit(0)))
    status = F.coalesce("epistemic_status", *[F.when(F.col("origin") == o, s) for o, s in STATUS_OF_ORIGIN.items()])
    bad = both.where(stale).select("koid", F.concat(F.lit("expected version "), F.col("expected"), F.lit(", found "), F.coalesce("_v", F.lit(0))).alias("problem"))
    return versioned(good, at, epistemic_status=status, state=F.coalesce("state", F.lit("active"))), bad


def evolve(heads: DataFrame, koid: str, values: Mapping[str, object], at: int) -> DataFrame:
    """The object with some properties set."""
    new = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), tagged(v))]) if values else F.create_map()
    old = F.map_filter("properties", lambda k, v: ~k.isin(list(values)) if values else F.lit(True))
    return versioned(heads.where(F.col("koid") == koid), at, properties=F.map_concat(old, new.cast(PROPERTIES)))


def transition(heads: DataFrame, koid: str | DataFrame, status: str, at: int) -> tuple[DataFrame, DataFrame]:
    """One object, or those of a frame (koid), moved to a status where that is legal, and the problems of the others."""
    own = heads.where(F.col("koid") == koid) if isinstance(koid, str) else heads.join(koid.select("koid"), "koid", "left_semi")
    now = F.coalesce("epistemic_status", F.lit("unknown"))
    legal = now.isin([a for a, to in STATUS_STEPS.items() if status in to])
    return versioned(own.where(legal), at, epistemic_status=F.lit(status)), own.where(~legal).select("koid", F.concat(now, F.lit(f" to {status}")).alias("problem"))


def tombstone(heads: DataFrame, koids: DataFrame, at: int) -> DataFrame:
    """A deleted version; history stays."""
    return versioned(heads.join(koids.select("koid"), "koid", "left_semi"), at, state=F.lit("deleted"))


def erase(versions: DataFrame, koids: DataFrame) -> DataFrame:
    """The versions that remain when the given objects are erased; the journal keeps their hashes."""
    return versions.join(koids.select("koid"), "koid", "left_anti")


def derive(heads: DataFrame, sources: Sequence[str], koid: str, type_name: str, values: Mapping[str, object], operation: str, actor: str, at: int, evidence: Column | None = None) -> DataFrame:
    """A new object derived from others: confidence is the mean of theirs, evidence theirs unless given."""
    own = heads.where(F.col("koid").isin(list(sources)))
    one = own.agg(
        F.coalesce(F.avg("confidence.score"), F.lit(0.0)).alias("s"), F.count("confidence.score").alias("n"),
        F.flatten(F.array_sort(F.collect_list("evidence"))).alias("e"),
    )
    props = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), tagged(v))]) if values else F.create_map()
    fields = {
        "koid": F.lit(koid), "type_name": F.lit(type_name), "version": F.lit(1), "commit_ts": F.lit(at << 16), "state": F.lit("active"), "epistemic_status": F.lit("inferred"),
        "confidence": F.struct(F.col("s").alias("score"), F.col("n").alias("confirmations"), F.lit(at).alias("last_verified"), F.array().cast("array<string>").alias("keys")),
        "evidence": evidence if evidence is not None else F.col("e"),
        "relationships": F.array(*[F.struct(F.lit("DERIVED_FROM").alias("rel_type"), F.lit(s).alias("target"), F.lit("in").alias("direction")) for s in sources]),
        "derivation": F.struct(F.lit(operation).alias("operation"), F.lit(actor).alias("actor"), F.lit(None).cast("string").alias("model"), F.lit(at).alias("timestamp"), F.array(*[F.lit(s) for s in sources]).alias("sources"), F.lit(None).cast("string").alias("reason")),
    }
    return one.select(*[fields.get(n, F.lit(None)).cast(k).alias(n) for n, k in SYSTEM.items()], props.cast(PROPERTIES).alias("properties"))


def verify(heads: DataFrame, koid: str, verifier: str, artifacts: Sequence[str], score: float, at: int) -> DataFrame:
    """Raises the confidence; a verifier's evidence counts once as a confirmation."""
    if not artifacts or not 0 <= score <= 1:
        raise ValueError("evidence is needed, and a score from 0 to 1")
    keys = F.array(*[F.lit(f"{verifier}|{a}") for a in artifacts])
    old = F.coalesce("confidence.keys", F.array().cast("array<string>"))
    new = F.array_except(keys, old)
    confidence = F.struct(
        F.greatest(F.coalesce("confidence.score", F.lit(0.0)), F.lit(score)).alias("score"), (F.coalesce("confidence.confirmations", F.lit(0)) + F.size(new)).alias("confirmations"),
        F.lit(at).alias("last_verified"), F.array_union(old, keys).alias("keys"),
    )
    evidence = F.transform(F.array(*[F.lit(a) for a in artifacts]), lambda a: F.struct(a.alias("source_artifact"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("revision"), F.lit("verification").alias("method"), F.lit(0.8).alias("confidence")))
    own = heads.where(F.col("koid") == koid)
    return versioned(own, at, confidence=confidence, epistemic_status=F.lit("verified"), evidence=F.array_distinct(F.concat(F.coalesce("evidence", F.array().cast(SYSTEM["evidence"])), evidence.cast(SYSTEM["evidence"]))))


def dependents(edges: DataFrame, koid: str, spark) -> DataFrame:
    """(koid): what was derived from the object, at any distance. Edges run from the derived to its source."""
    start = spark.createDataFrame([(koid,)], "koid string")
    return traverse(edges, start, None, "in", "DERIVED_FROM").select("koid")


def invalidate(heads: DataFrame, edges: DataFrame, koid: str, actor: str, reason: str, at: int) -> DataFrame:
    """The object and its dependents, contradicted where that is legal, and valid no longer than now."""
    spark = heads.sparkSession
    ids = dependents(edges, koid, spark).unionAll(spark.createDataFrame([(koid,)], "koid string")).distinct()
    return invalidated(heads.join(ids, "koid", "left_semi"), actor, reason, at)


def invalidated(own: DataFrame, actor: str, reason: str, at: int) -> DataFrame:
    """Objects that were not yet, contradicted where that is legal, valid no longer, and stamped."""
    own = own.where("invalidation is null")
    legal = F.coalesce("epistemic_status", F.lit("unknown")).isin([a for a, to in STATUS_STEPS.items() if "contradicted" in to])
    end = F.when(F.col("valid_from") > at, F.col("valid_from")).otherwise(F.least("valid_to", F.lit(at)))
    stamp = F.struct(F.lit(at).alias("at"), F.lit(actor).alias("actor"), F.lit(reason).alias("reason"))
    return versioned(own, at, epistemic_status=F.when(legal, "contradicted").otherwise(F.col("epistemic_status")), valid_to=end, invalidation=stamp)


def supersede(heads: DataFrame, old: str, new: str, at: int) -> DataFrame:
    """The old object superseded and closed, with a SUPERSEDES edge on the new one."""
    edge = F.array(F.struct(F.lit("SUPERSEDES").alias("rel_type"), F.lit(old).alias("target"), F.lit("out").alias("direction")))
    gone = versioned(heads.where(F.col("koid") == old), at, epistemic_status=F.lit("superseded"), state=F.lit("superseded"), valid_to=F.least("valid_to", F.lit(at)))
    kept = versioned(heads.where(F.col("koid") == new), at, relationships=F.array_union(F.coalesce("relationships", F.array().cast(SYSTEM["relationships"])), edge.cast(SYSTEM["relationships"])))
    return gone.unionByName(kept)


def merge_properties(heads: DataFrame, koids: Sequence[str], how: str = "newest") -> DataFrame:
    """(name, value, koid): for each property the value of the newest, or of the highest authority, object that has it."""
    own = heads.where(F.col("koid").isin(list(koids))).select("koid", "commit_ts", "authority", F.explode("properties").alias("name", "value"))
    order = F.struct((-F.coalesce(rank(F.col("authority")), F.lit(99))).alias("r"), "commit_ts", "koid") if how == "authority" else F.struct("commit_ts", "koid")
    return own.groupBy("name").agg(F.max_by("value", order).alias("value"), F.max_by("koid", order).alias("koid"))


def merge(heads: DataFrame, koids: Sequence[str], into: str, at: int, how: str = "newest", manual: Mapping[str, object] | None = None) -> DataFrame:
    """One object with the merged properties; the others are superseded."""
    picked = merge_properties(heads, koids, how).where(~F.col("name").isin(list(manual or {}) or [""]))
    props = picked.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("_p"))
    extra = F.create_map(*[x for k, v in (manual or {}).items() for x in (F.lit(k), tagged(v))]).cast(PROPERTIES) if manual else F.create_map().cast(PROPERTIES)
    kept = heads.where(F.col("koid") == into).join(F.broadcast(props))  # one row
    kept = versioned(kept, at, properties=F.map_concat("_p", extra))
    gone = [k for k in koids if k != into]
    return kept.unionByName(versioned(heads.where(F.col("koid").isin(gone)), at, epistemic_status=F.lit("superseded"), state=F.lit("superseded")))


def _among(names: Sequence[str]):
    return lambda name, value: name.isin(list(names))


def split(heads: DataFrame, koid: str, parts: Mapping[str, Sequence[str]], at: int) -> DataFrame:
    """New objects, each with some of the properties, and the old one superseded."""
    own = heads.where(F.col("koid") == koid)
    news = [versioned(own, at, koid=F.lit(k), version=F.lit(1), properties=F.map_filter("properties", _among(names))) for k, names in parts.items()]
    gone = versioned(own, at, epistemic_status=F.lit("superseded"), state=F.lit("superseded"))
    return reduce(lambda a, b: a.unionByName(b), [gone, *news])


def contradict(heads: DataFrame, koid: str, conflict: str, prop: str, counter: object, actor: str, at: int) -> tuple[DataFrame, DataFrame]:
    """A conflict object that holds both sides; a counter-claim that says the same, or a closed target, is a problem."""
    own = heads.where(F.col("koid") == koid)
    claim = tagged(counter)
    same = F.col("properties")[prop].eqNullSafe(claim.cast(SYSTEM_VALUE)) | F.coalesce(F.col("epistemic_status").isin("superseded", "contradicted"), F.lit(False))
    props = F.map_from_arrays(F.array(*[F.lit(n) for n in ("target", "property", "claimed", "countered", "actor", "target_authority")]), F.array(tagged(koid), tagged(prop), F.col("properties")[prop], claim, tagged(actor), F.struct(F.lit("text").alias("t"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("f"), F.col("authority").alias("s"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("string").alias("j"))))
    out = versioned(own.where(~same), at, koid=F.lit(conflict), type_name=F.lit("Conflict"), version=F.lit(1), properties=props, epistemic_status=F.lit("asserted"))
    return out, own.where(same).select("koid", F.lit("nothing to contradict").alias("problem"))


SYSTEM_VALUE = "struct<t:string,i:bigint,f:double,s:string,b:boolean,j:string>"


def resolve_by_authority(heads: DataFrame, a: str, b: str, at: int) -> tuple[DataFrame, DataFrame]:
    """The lower authority of two is contradicted; a missing or equal rank is a problem."""
    own = heads.where(F.col("koid").isin(a, b)).withColumn("_r", rank(F.col("authority")))
    both = own.agg(F.count("_r").alias("_n"), F.min("_r").alias("_lo"), F.max("_r").alias("_hi"))
    rows = own.join(F.broadcast(both))  # one row
    open_ = (F.col("_n") == 2) & (F.col("_lo") != F.col("_hi"))
    loser = versioned(rows.where(open_ & (F.col("_r") == F.col("_hi"))), at, epistemic_status=F.lit("contradicted"), valid_to=F.least("valid_to", F.lit(at)))
    return loser, rows.where(~open_).select("koid", F.lit("no higher authority").alias("problem"))


def migrate(heads: DataFrame, type_name: str, renames: Mapping[str, str], defaults: Mapping[str, object], at: int) -> DataFrame:
    """Objects of a type under a new schema: properties renamed, missing ones given their default."""
    own = heads.where(F.col("type_name") == type_name)
    old, new = [F.lit(k) for k in renames], [F.lit(v) for v in renames.values()]
    names = F.map_from_arrays(F.array(*old), F.array(*new)) if renames else None
    props = F.transform_keys("properties", lambda k, v: F.coalesce(names[k], k)) if renames else F.col("properties")
    extra = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), tagged(v))]).cast(PROPERTIES) if defaults else F.create_map().cast(PROPERTIES)
    props = F.map_concat(F.map_filter(extra, lambda k, v: ~F.array_contains(F.map_keys(props), k)), props)
    return versioned(own, at, properties=props)


def retain(heads: DataFrame, koid: str, ttl: int, at: int) -> DataFrame:
    """Gives the object an end of validity ``ttl`` milliseconds from now."""
    return versioned(heads.where(F.col("koid") == koid), at, valid_to=F.lit(at + ttl))
