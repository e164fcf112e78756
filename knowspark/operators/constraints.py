"""Constraint evaluation: violations as rows, one for each object and broken rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import check, in_domain, kind_of
from .ontology import Ontology


def violations(df: DataFrame, key: Column, rules: Mapping[str, Column], changed: Sequence[str] | None = None, uses: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(koid, rule) for each rule (name: condition that must hold) that a row breaks, in one scan.

    With ``changed``, only rules that use a changed property (``uses``) are evaluated.
    """
    if changed is not None and uses is not None:
        rules = {n: c for n, c in rules.items() if set(uses.get(n, changed)) & set(changed)}
    broken = [F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]
    if not broken:
        return df.select(key.alias("koid"), F.lit("").alias("rule")).where("false")
    names = F.filter(F.array(*broken), lambda x: x.isNotNull())
    return df.select(key.alias("koid"), F.explode(names).alias("rule"))


def check_rules(df: DataFrame, sources: Mapping[str, str]) -> dict[str, Column]:
    """CHECK expressions as conditions."""
    return {n: check(df, s) for n, s in sources.items()}


def domain_rules(df: DataFrame, domains: Mapping[str, tuple]) -> dict[str, Column]:
    """``{property: (rule, *arguments)}`` as conditions."""
    return {f"{n}:{rule[0]}": in_domain(df, n, *rule) for n, rule in domains.items()}


def schema_rules(df: DataFrame, required: Sequence[str], kinds: Mapping[str, str]) -> dict[str, Column]:
    """Required properties, and the kinds that properties must have."""
    has = set(df.columns)
    rules = {f"required:{n}": F.col(n).isNotNull() if n in has else F.lit(False) for n in required}
    odd = [n for n, kind in kinds.items() if n in has and kind_of(df.schema[n].dataType) != kind]
    return rules | {f"kind:{n}": F.col(n).isNull() for n in odd} | {f"unknown:{n}": F.col(n).isNull() for n in sorted(has - set(kinds) - {"ko"})}


def duplicates(df: DataFrame, columns: Sequence[str], scope: Sequence[Column] = ()) -> DataFrame:
    """Keys that more than one object has, and how many; rows with a null in the key do not count.

    ``scope`` narrows it: nothing for the type, the tenant's column for each tenant.
    """
    full = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    return full.groupBy(*scope, *columns).agg(F.count(F.lit(1)).alias("objects")).where("objects > 1")


def unique_violations(stored: DataFrame, batch: DataFrame, columns: Sequence[str], id_col: str | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """Rows of a batch whose key another object has, in the batch or stored.

    With ``id_col`` a row does not clash with the stored version of its own object, nor with other rows of it in the
    batch. ``scope`` names columns that must be equal too: the type's and the tenant's, the type's alone, or, for a key
    that is unique globally, none.
    """
    keys = [*scope, *columns]
    if id_col is None:
        twice = duplicates(batch, keys).select(*keys)
        taken = stored.select(*keys).distinct()
        return batch.join(twice, keys, "left_semi").unionByName(batch.join(taken, keys, "left_semi")).distinct()
    every = batch.select(*keys, id_col).unionByName(stored.select(*keys, id_col))
    every = every.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys]))
    taken = every.groupBy(*keys).agg(F.min(id_col).alias("_least"), F.max(id_col).alias("_most")).where("_least <> _most")
    return batch.join(taken.select(*keys), keys, "left_semi")


def relationship_violations(edges: DataFrame, objects: DataFrame, ontology: Ontology, strict: bool = True) -> DataFrame:
    """(src, rel_type, dst, rule): ends that do not exist, wrong domain or range, more targets than allowed."""
    ends = objects.select("koid", "type_name")
    both = edges.join(ends.select(F.col("koid").alias("src"), F.col("type_name").alias("_d")), "src", "left")
    both = both.join(ends.select(F.col("koid").alias("dst"), F.col("type_name").alias("_r")), "dst", "left")
    rules = []
    if strict:
        rules += [F.when(F.col("_d").isNull() | F.col("_r").isNull(), "missing")]
    for r in ontology.relationships:
        own = F.col("rel_type") == r.name
        for side, name, rule in (("_d", r.domain, "domain"), ("_r", r.range, "range")):
            fits = [name, *ontology.descendants(name)]
            rules.append(F.when(own & F.col(side).isNotNull() & ~F.col(side).isin(fits), rule))
    out = both.select("src", "rel_type", "dst", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("rule")) if rules else None
    for r in ontology.relationships:
        most = 1 if r.cardinality == "one" else r.most
        if most is not None:
            many = edges.where(F.col("rel_type") == r.name).groupBy("src", "rel_type").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
            more = many.select("src", "rel_type", F.lit(None).cast("string").alias("dst"), F.lit("cardinality").alias("rule"))
            out = more if out is None else out.unionByName(more)
    return out if out is not None else edges.withColumn("rule", F.lit("")).where("false")
