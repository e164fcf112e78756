"""From statements to DataFrames. There is no plan of our own beside Catalyst's: each clause is a transformation.

Order: scan (with access and, unless a temporal clause speaks, validity now), temporal, status, source, conditions,
then ranking, then hops, projection, paging. Filters always come before ranking, which Catalyst would not move them past.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.values import kind_of
from ..lang import tree as t
from ..lang.parser import parse
from ..operators import graph, mutate, search, temporal
from ..operators.ontology import Ontology, union_types
from ..operators.security import Policies, Subject, may
from ..schema import tagged

K = 10

MOST_BROADCAST = 10_000


@dataclass
class Catalog:
    """What queries run on: views of heads and of all versions by type, edges, and what gives names their meaning."""

    heads: Mapping[str, DataFrame]
    versions: Mapping[str, DataFrame] = field(default_factory=dict)
    edges: DataFrame | Callable[[], DataFrame] | None = None
    ontology: Ontology | None = None
    policies: Policies = field(default_factory=Policies)
    embed: Callable[[str], Sequence[float]] | None = None

    def types(self, name: str) -> list[str]:
        """The physical types that a name covers."""
        names = self.ontology.expand(name) if self.ontology else [name]
        names = [self.ontology.physical[n][0] if self.ontology and n in self.ontology.physical else n for n in names]
        found = [n for n in dict.fromkeys(names) if n in self.heads]
        if not found:
            raise t.QueryError(t.UNKNOWN_TYPE, f"unknown type {name!r}")
        return found


class Engine:
    def __init__(self, catalog: Catalog, subject: Subject | None = None, now: int = 0, strict_types: bool = False, default_allow: bool = True) -> None:
        self.catalog, self.subject, self.now, self.strict = catalog, subject, now, strict_types
        self.open = default_allow and subject is None

    # Statements

    def run(self, query: str | t.Statement) -> DataFrame:
        """The result of a MATCH; of a mutation the versions to append."""
        s = parse(query) if isinstance(query, str) else query
        if isinstance(s, t.Match):
            return self.match(s)
        if isinstance(s, t.Create):
            return self.create(s)
        if isinstance(s, t.Update | t.Delete):
            heads = self._opened(s.entity)
            if isinstance(s, t.Update):
                return mutate.evolve(heads, s.koid, dict(s.values), self.now)
            return mutate.tombstone(heads, heads.sparkSession.createDataFrame([(s.koid,)], "koid string"), self.now)
        from ..pipeline.compile import compile_source

        return compile_source(next(iter(self.catalog.heads.values())).sparkSession, s)

    def steps(self, query: str | t.Match) -> list[str]:
        """The operators of a query, without running it."""
        m = parse(query) if isinstance(query, str) else query
        out = [f"scan {n}" for n in self.catalog.types(m.entity)] if m.entity else []
        if m.span:
            out.append(f"temporal {m.span.kind}")
        out += ["epistemic " + ", ".join(m.statuses)] * bool(m.statuses) + [f"source {m.source}"] * (m.source is not None)
        out += [f"filter {n}" for n in sorted(t.names(m.where))]
        if m.similar:
            vector, text = self._sides(m)
            out += ["vector search"] * vector + ["text search" + " bm25" * m.similar.bm25] * text + [f"fuse {m.similar.fuse}"] * (vector and text)
        out += [f"traverse {m.hop.relation or '*'} depth {m.hop.depth}"] if m.hop else []
        out += ["project " + ", ".join(m.fields)] if m.fields else []
        return out + [f"limit {m.limit} offset {m.offset}"] * (m.limit is not None)

    # Parts of MATCH

    def _allowed(self) -> Column:
        return F.lit(True) if self.open else may(self.subject or Subject(""), "read", self.catalog.policies)

    def scan(self, m: t.Match) -> DataFrame:
        names = self.catalog.types(m.entity)
        heads = union_types([self._needed(self.catalog.heads[n], m) for n in names]).where((F.col("ko.state") != "deleted") & self._allowed())
        kind = m.span.kind if m.span else ""
        if kind in ("as_of", "historical"):
            missing = [n for n in names if n not in self.catalog.versions]
            if missing:
                raise t.QueryError(t.UNKNOWN_TYPE, f"no versions of {missing[0]!r}")
            versions = union_types([self._needed(self.catalog.versions[n], m) for n in names]).where(self._allowed())
            rows = temporal.as_of(versions, m.span.start) if kind == "as_of" else temporal.history(versions, heads)
        elif kind == "between":
            rows = heads.where(temporal.overlaps(F.col("ko.valid_from"), F.col("ko.valid_to"), m.span.start, m.span.end))
        else:
            rows = heads.where(temporal.valid_at(F.col("ko.valid_from"), F.col("ko.valid_to"), self.now))
        if m.statuses:
            state = F.when(F.col("ko.state").isin("verified", "extracted"), F.col("ko.state")).otherwise("observed")
            rows = rows.where(F.coalesce("ko.epistemic_status", state).isin(list(m.statuses)))
        if m.source is not None:
            rows = rows.where(F.coalesce(F.exists("ko.evidence", lambda e: e["source_artifact"] == m.source), F.lit(False)))
        return rows.where(self.condition(rows, m.where)) if m.where is not None else rows

    def _needed(self, v: DataFrame, m: t.Match) -> DataFrame:
        """Only the properties that the query uses: Catalyst cannot prune columns inside the newest-version aggregate."""
        if m.fields is None or m.similar:
            return v
        used = set(m.fields) | t.names(m.where)
        return v.select("ko", *[c for c in v.columns if c != "ko" and c in used])

    def condition(self, df: DataFrame, c: t.Condition) -> Column:
        if isinstance(c, t.Both):
            return self.condition(df, c.left) & self.condition(df, c.right)
        if isinstance(c, t.Either):
            return self.condition(df, c.left) | self.condition(df, c.right)
        return self.compare(df, c)

    def compare(self, df: DataFrame, c: t.Compare) -> Column:
        """Typed comparison: a missing property or another kind of value equals nothing and is in no range; numbers promote.

        A null result counts as false (conditions have no NOT), so plain comparisons reach the scan.
        """
        if c.name not in df.columns or c.name == "ko":
            return F.lit(c.op == "!=")
        col, kind = F.col(c.name), kind_of(df.schema[c.name].dataType)
        if c.value is None:
            return {"==": col.isNull(), "!=": col.isNotNull()}.get(c.op, F.lit(False))
        says = {bool: "bool", int: "int", float: "float", str: "text"}.get(type(c.value), "list")
        value: Column = F.lit(c.value) if says != "list" else F.lit(None)
        if isinstance(df.schema[c.name].dataType, T.TimestampType | T.TimestampNTZType | T.DateType) and says == "text":
            value, says, kind = F.lit(c.value).cast(df.schema[c.name].dataType), "time", "time"
        fits = kind == says or {kind, says} == {"int", "float"} and not self.strict
        if not fits:
            return F.lit(c.op == "!=")
        if c.op == "==":
            return col == value
        if c.op == "!=":
            return ~col.eqNullSafe(value)
        return {"<": col < value, "<=": col <= value, ">": col > value, ">=": col >= value}[c.op]

    def _sides(self, m: t.Match) -> tuple[bool, bool]:
        """Whether the vector and the text side of a search run. Temporal and epistemic clauses keep it to text."""
        s = m.similar
        relational = bool(m.span or m.statuses)
        vector = s.vector is not None or s.model is not None and self.catalog.embed is not None and not relational
        return vector, s.text is not None and s.fuse != "vector"

    def search(self, rows: DataFrame, m: t.Match) -> DataFrame:
        s, key = m.similar, F.col("ko.koid")
        k = s.k or K
        vector, text = self._sides(m)
        sides = []
        if vector:
            own = rows.where(F.col("ko.embedding_model") == s.model) if s.model else rows
            query = s.vector if s.vector is not None else self.catalog.embed(s.text)
            sides.append(search.ann(own, F.col("ko.embedding"), query, k, key))
        if text:
            rank = search.text_bm25 if s.bm25 else search.text_jaccard
            sides.append(rank(rows, tx.object_text(rows), s.text, k, key))
        if len(sides) == 1 or s.fuse in ("vector", "text"):
            ranked = sides[0] if s.fuse != "text" or len(sides) == 1 else sides[1]
        else:
            ranked = search.fuse_rrf(*sides) if s.fuse == "rrf" else search.fuse_weighted(*sides, 0.5, 0.5)
        ranked = ranked.select(F.col("koid").alias("_koid"), F.col("score").alias("_score"))
        small = F.broadcast(ranked) if k <= MOST_BROADCAST else ranked  # it has at most 2 k rows
        return rows.join(small, key == F.col("_koid")).drop("_koid")

    def match(self, m: t.Match) -> DataFrame:
        if m.explain:
            spark = self.catalog.heads[self.catalog.types(m.entity)[0]].sparkSession
            return spark.createDataFrame(list(enumerate(self.steps(m))), "step int, operator string")
        if m.entity is None:
            return self._walk(m, None)
        rows = self.scan(m)
        if m.similar:
            rows = self.search(rows, m)
        if m.hop:
            return self._walk(m, rows)
        scored = m.similar is not None
        props = [c for c in rows.columns if c not in ("ko", "_score")]
        if m.fields:
            props = [c for c in m.fields if c in props]
        identity = [F.col("ko.koid").alias("koid"), F.col("ko.type_name").alias("type_name"), F.col("ko.version").alias("version")]
        order = [F.col("_score").desc()] if scored else []
        order += [F.col("ko.koid"), F.col("ko.commit_ts")]
        out = rows.orderBy(*order) if scored or m.limit is not None else rows
        if m.limit is not None:
            out = out.offset(m.offset).limit(m.limit)
        taken = {"koid", "type_name", "version"} | ({"score"} if scored else set())  # these names are the result's own
        return out.select(*identity, *([F.col("_score").alias("score")] if scored else []), *[c for c in props if c not in taken])

    def _walk(self, m: t.Match, rows: DataFrame | None) -> DataFrame:
        if self.catalog.edges is None:
            raise t.QueryError(t.UNKNOWN_RELATIONSHIP, "there are no edges")
        known = {r.name for r in self.catalog.ontology.relationships} if self.catalog.ontology else set()
        if known and m.hop.relation and m.hop.relation not in known:
            raise t.QueryError(t.UNKNOWN_RELATIONSHIP, f"unknown relationship {m.hop.relation!r}")
        edges = self.catalog.edges() if callable(self.catalog.edges) else self.catalog.edges
        spark = edges.sparkSession
        starts = rows.select(F.col("ko.koid").alias("koid")) if rows is not None else spark.createDataFrame([(m.hop.start,)], "koid string")
        out = graph.traverse(edges, starts, m.hop.depth, "out", m.hop.relation)
        return out.orderBy("koid").offset(m.offset).limit(m.limit) if m.limit is not None else out

    def analyse(self, query: str | t.Match) -> None:
        """Raises for a type, property or relationship that the catalogue does not know."""
        m = parse(query) if isinstance(query, str) else query
        have = set().union(*(self.catalog.heads[n].columns for n in self.catalog.types(m.entity)))
        for n in sorted((t.names(m.where) | set(m.fields or ())) - have):
            raise t.QueryError(t.UNKNOWN_PROPERTY, f"{m.entity} has no {n!r}")
        if m.hop and self.catalog.ontology and m.hop.relation not in {r.name for r in self.catalog.ontology.relationships}:
            raise t.QueryError(t.UNKNOWN_RELATIONSHIP, f"unknown relationship {m.hop.relation!r}")

    # Mutations

    def _opened(self, entity: str) -> DataFrame:
        from ..schema import opened

        return union_types([opened(self.catalog.heads[n]) for n in self.catalog.types(entity)]).where(F.col("state") != "deleted")

    def create(self, s: t.Create) -> DataFrame:
        """One new version; its id comes from the type, the values and the time."""
        from ..schema import PROPERTIES, SYSTEM

        spark = next(iter(self.catalog.heads.values())).sparkSession
        koid = F.substring(F.sha2(F.lit(f"{s.entity}|{s.values!r}|{self.now}"), 256), 1, 32)
        given = {"koid": koid, "type_name": F.lit(s.entity), "version": F.lit(1), "commit_ts": F.lit(self.now << 16), "state": F.lit("active"), "epistemic_status": F.lit("asserted")}
        props = F.create_map(*[x for k, v in s.values for x in (F.lit(k), tagged(v))]) if s.values else F.create_map()
        return spark.range(1).select(*[given.get(n, F.lit(None)).cast(k).alias(n) for n, k in SYSTEM.items()], props.cast(PROPERTIES).alias("properties"))
