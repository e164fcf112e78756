"""Ontology: classes with one parent, relationships, property definitions and physical names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relationship:
    name: str
    domain: str
    range: str
    cardinality: str = "many"
    most: int | None = None


@dataclass(frozen=True)
class Ontology:
    parents: Mapping[str, str | None] = field(default_factory=dict)
    relationships: Sequence[Relationship] = ()
    properties: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    physical: Mapping[str, tuple[str, Mapping[str, str]]] = field(default_factory=dict)  # class: type, and new names by old

    def ancestors(self, name: str) -> list[str]:
        out: list[str] = []
        while (name := self.parents.get(name)) and name not in out:
            out.append(name)
        return out

    def descendants(self, name: str) -> list[str]:
        return sorted(c for c in self.parents if name in self.ancestors(c))

    def expand(self, name: str) -> list[str]:
        """The class, its ancestors and its descendants: whose types a scan of it covers."""
        return [name, *self.ancestors(name), *self.descendants(name)]

    def is_a(self, name: str, other: str) -> bool:
        return name == other or other in self.ancestors(name)


def union_types(views: Sequence[DataFrame]) -> DataFrame:
    """Views of several types as one; a property that a type lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), views)


def conform(v: DataFrame, ontology: Ontology, name: str) -> DataFrame:
    """A physical view under the class's property names, with the class as a tag."""
    _, renames = ontology.physical.get(name, (name, {}))
    out = v.withColumnsRenamed(dict(renames))
    tags = F.array_union(F.coalesce(F.col("ko.tags"), F.array().cast("array<string>")), F.array(F.lit(name)))
    return out.withColumn("ko", F.col("ko").withField("tags", tags))


def discover_types(opened: DataFrame) -> DataFrame:
    """(type_name, objects) of open-world rows."""
    return opened.groupBy("type_name").agg(F.count(F.lit(1)).alias("objects"))


def discover_properties(opened: DataFrame) -> DataFrame:
    """(type_name, property, kind, objects): each type's properties; the kind is that of the first object that has one."""
    pairs = opened.select("type_name", "koid", F.explode("properties").alias("property", "value"))
    return pairs.groupBy("type_name", "property").agg(F.min_by(F.col("value.t"), F.when(F.col("value.t") != "null", F.col("koid"))).alias("kind"), F.count(F.lit(1)).alias("objects"))


def discover_relationships(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """(rel_type, domain, range, edges) by the types at both ends; ``objects`` has koid and type_name."""
    ends = objects.select("koid", "type_name")
    out = edges.join(ends.select(F.col("koid").alias("src"), F.col("type_name").alias("domain")), "src")
    out = out.join(ends.select(F.col("koid").alias("dst"), F.col("type_name").alias("range")), "dst")
    return out.groupBy("rel_type", "domain", "range").agg(F.count(F.lit(1)).alias("edges"))


def propose(entities: DataFrame) -> DataFrame:
    """Classes from extracted entities (name, type_hint, confidence): members and mean confidence of each hint."""
    hint = F.coalesce(F.nullif(F.trim("type_hint"), F.lit("")), F.lit("Concept"))
    return entities.groupBy(hint.alias("class")).agg(F.countDistinct("name").alias("members"), F.avg("confidence").alias("confidence"))
