"""Claims with evidence: observations, assertions, experiences, and what becomes of two claims in conflict.

All are columns over any number of rows: rows in, new versions and problems out; the store appends what they return.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AUTHORITIES, PROPERTIES, SYSTEM, tag_column, tagged
from .mutate import STATUS_STEPS, dependents, invalidated, versioned

# Days that an experience holds, and how sure it is, unless said otherwise.
EXPERIENCE_DAYS, EXPERIENCE_SCORE = 30, 0.5
DECISIONS = ("a_preferred", "b_preferred", "both_valid", "replaced")


def claims(rows: DataFrame, type_name: str, key: Column, properties: Sequence[str], evidence: Column, at: int, good: Column | None = None, **system: Column) -> tuple[DataFrame, DataFrame]:
    """First versions of objects from rows, and (koid, problem) of rows without evidence or that ``good`` does not hold for.

    Properties are the named columns; ``system`` sets fields of :data:`knowspark.schema.SYSTEM`.
    """
    backed = F.coalesce(F.size(evidence) > 0, F.lit(False))
    fields = {"koid": key, "type_name": F.lit(type_name), "version": F.lit(1), "commit_ts": F.lit(at << 16), "state": F.lit("active"), "evidence": evidence, "valid_from": F.lit(at)} | system
    pairs = [x for p in properties for x in (F.lit(p), tag_column(rows, p))]
    props = (F.create_map(*pairs) if pairs else F.create_map()).cast(PROPERTIES)
    fit = F.coalesce(good, F.lit(False)) if good is not None else F.lit(True)
    out = rows.where(backed & fit).select(*[fields.get(n, F.lit(None)).cast(k).alias(n) for n, k in SYSTEM.items()], props.alias("properties"))
    problem = F.when(~backed, "no evidence").when(~fit, "not a valid claim")
    return out, rows.select(key.alias("koid"), problem.alias("problem")).where("problem is not null")


def observe(rows: DataFrame, type_name: str, key: Column, properties: Sequence[str], evidence: Column, at: int, valid_from: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """What a system saw: observed, valid from when it was unless told."""
    start = F.coalesce(valid_from, F.lit(at)) if valid_from is not None else F.lit(at)
    return claims(rows, type_name, key, properties, evidence, at, epistemic_status=F.lit("observed"), origin=F.lit("system"), valid_from=start)


def assert_claims(rows: DataFrame, type_name: str, key: Column, properties: Sequence[str], evidence: Column, authority: Column, at: int, valid_from: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """What an agent says: asserted, with an authority that must be one of the known levels."""
    start = F.coalesce(valid_from, F.lit(at)) if valid_from is not None else F.lit(at)
    return claims(rows, type_name, key, properties, evidence, at, authority.isin(list(AUTHORITIES)), epistemic_status=F.lit("asserted"), origin=F.lit("agent"), authority=authority, valid_from=start)


def record_experiences(rows: DataFrame, key: Column, evidence: Column, at: int, days: float = EXPERIENCE_DAYS, score: Column | None = None, shared_with: Column | None = None, owner: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """What an agent's run came to: rows with goal, action and outcome, and whatever else they tell, for a limited time.

    ``shared_with`` (an array of principals) may read it, besides the owner.
    """
    told = F.lit(True)
    for name in ("goal", "action", "outcome"):
        told = told & F.coalesce(F.trim(F.col(name)) != "", F.lit(False))
    confidence = F.struct(F.coalesce(score if score is not None else F.lit(None).cast("double"), F.lit(EXPERIENCE_SCORE)).alias("score"), F.lit(0).alias("confirmations"), F.lit(None).alias("last_verified"), F.array().cast("array<string>").alias("keys"))
    fields = {"epistemic_status": F.lit("asserted"), "origin": F.lit("agent"), "authority": F.lit("agent_derived"), "valid_to": F.lit(at + int(days * 86_400_000)), "confidence": confidence}
    if owner is not None:
        fields["owner"] = owner
    if shared_with is not None:
        fields["acl"] = F.transform(shared_with, lambda p: F.struct(p.alias("principal"), F.lit("read").alias("action"), F.lit("allow").alias("effect")))
    known = ("actor", "goal", "action", "outcome", "preconditions", "causal_explanation", "lesson", "reuse_conditions")
    return claims(rows, "Experience", key, [c for c in known if c in rows.columns], evidence, at, told, **fields)


def _legally(own: DataFrame, status: str, at: int, **changes: Column) -> DataFrame:
    """The next versions of those that may take the status; the others stay as they are."""
    legal = F.coalesce("epistemic_status", F.lit("unknown")).isin([a for a, to in STATUS_STEPS.items() if status in to])
    return versioned(own.where(legal), at, epistemic_status=F.lit(status), **changes)


def resolve_conflict(heads: DataFrame, edges: DataFrame, conflict: str, a: str, b: str, decision: str, rationale: str, at: int, replacement: str | None = None, split_at: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What a decision on two claims changes, with the conflict object that records it; and problems.

    The claim that loses is contradicted, where that is legal. Two valid claims may share time out at ``split_at``. Both
    replaced are superseded by the replacement, and all that was derived from them is invalidated. A conflict that is
    resolved already, or is none, is a problem and changes nothing.
    """
    if decision not in DECISIONS or not rationale.strip():
        raise ValueError("a decision and its rationale are needed")
    if (decision == "replaced") != (replacement is not None) or split_at is not None and decision != "both_valid":
        raise ValueError("a replacement belongs to replaced claims, a split to valid ones")
    about = heads.where(F.col("koid") == conflict).select("type_name", F.col("properties")["resolution"].isNotNull().alias("done")).first()  # one row
    problem = "not found" if about is None else "not a conflict" if about.type_name != "Conflict" else "already resolved" if about.done else None
    none = heads.sparkSession.createDataFrame([], "koid string, problem string")
    if problem:
        return versioned(heads.where("false"), at), heads.sparkSession.createDataFrame([(conflict, problem)], none.schema)
    note = {"resolution": decision, "rationale": rationale} | ({"replacement": replacement} if replacement else {}) | ({"split_at": split_at} if split_at is not None else {})
    extra = F.create_map(*[x for k, v in note.items() for x in (F.lit(k), tagged(v))]).cast(PROPERTIES)
    out = versioned(heads.where(F.col("koid") == conflict), at, properties=F.map_concat(F.map_filter("properties", lambda k, v: ~k.isin(list(note))), extra))
    claim = lambda k: heads.where(F.col("koid") == k)
    if decision in ("a_preferred", "b_preferred"):
        out = out.unionByName(_legally(claim(b if decision == "a_preferred" else a), "contradicted", at))
    elif decision == "both_valid" and split_at is not None:
        out = out.unionByName(versioned(claim(a), at, valid_to=F.lit(split_at))).unionByName(versioned(claim(b), at, valid_from=F.lit(split_at)))
    elif decision == "replaced":
        both = heads.where(F.col("koid").isin(a, b))
        out = out.unionByName(_legally(both, "superseded", at, state=F.lit("superseded")))
        swept = dependents(edges, a, heads.sparkSession).unionAll(dependents(edges, b, heads.sparkSession)).where(~F.col("koid").isin(a, b)).distinct()
        out = out.unionByName(invalidated(heads.join(swept, "koid", "left_semi"), "system", f"replaced by {replacement}", at))
    return out, none
