"""Row-level access as predicates.

Order: another tenant's rows are closed even to owners and administrators; then owner or administrator; then the object's
access list, where a denial wins and ``admin`` entries match every action; then the type's policy; then closed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import closure


@dataclass(frozen=True)
class Subject:
    """Who asks: a principal, its roles (closed over inheritance), its tenant; ``admin`` opens the own tenant."""

    name: str
    roles: tuple[str, ...] = ()
    tenant: str | None = None
    admin: bool = False


@dataclass(frozen=True)
class Policies:
    """For types: principals allowed or denied an action. ``default`` speaks where nothing else does."""

    allow: Mapping[tuple[str, str], Sequence[str]] = field(default_factory=dict)
    deny: Mapping[tuple[str, str], Sequence[str]] = field(default_factory=dict)
    default: bool = False


def roles_of(grants: DataFrame, inherits: DataFrame) -> DataFrame:
    """(principal, role): granted roles and all that they inherit, from (principal, role) and (role, parent)."""
    up = closure(inherits.select(F.col("role").alias("src"), F.col("parent").alias("dst"))).select("src", "dst")
    more = grants.join(up, F.col("role") == F.col("src")).select("principal", F.col("dst").alias("role"))
    return grants.select("principal", "role").unionAll(more).distinct()


def may(subject: Subject, action: str = "read", policies: Policies = Policies(), ko: str = "ko") -> Column:
    """Whether the subject may do ``action`` to a row of a view."""
    who = F.array(*[F.lit(p) for p in (subject.name, *subject.roles)])
    col = lambda n: F.col(f"{ko}.{n}")
    fits = lambda e, effect: F.array_contains(who, e["principal"]) & e["action"].isin(action, "admin") & (e["effect"] == effect)
    denied = F.coalesce(F.exists(col("acl"), lambda e: fits(e, "deny")), F.lit(False))
    allowed = F.coalesce(F.exists(col("acl"), lambda e: fits(e, "allow")), F.lit(False))
    named = {subject.name, *subject.roles}

    def listed(table) -> Column:
        types = [t for (t, a), who_ in table.items() if a == action and named & set(who_)]
        return col("type_name").isin(types) if types else F.lit(False)

    same = col("tenant").isNull() if subject.tenant is None else col("tenant").isNull() | (col("tenant") == subject.tenant)
    own = F.coalesce(col("owner") == subject.name, F.lit(False)) | F.lit(subject.admin)
    rest = F.when(denied, False).when(allowed, True).when(listed(policies.deny), False).when(listed(policies.allow), True).otherwise(policies.default)
    return same & (own | rest)


def first_match(df: DataFrame, rules: Sequence[tuple[str, Column, str]], default: str = "deny") -> tuple[Column, Column]:
    """For ordered rules (name, condition, effect): the name and the effect of the first that holds for a row."""
    name, effect = F.lit(None).cast("string"), F.lit(default)
    for rule, condition, says in reversed(rules):
        holds = F.coalesce(condition, F.lit(False))
        name, effect = F.when(holds, rule).otherwise(name), F.when(holds, says).otherwise(effect)
    return name, effect
