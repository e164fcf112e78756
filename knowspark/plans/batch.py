"""Several operations as one set of new versions: all of them or none."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mutate import versioned
from ..schema import PROPERTIES, SYSTEM, VERSIONS, tagged

REFERENCE = re.compile(r"\$(\d+)\.koid")


def _put(x: object, koids: Sequence[str]) -> object:
    if isinstance(x, str):
        return REFERENCE.sub(lambda m: koids[int(m[1]) - 1], x)
    if isinstance(x, Mapping):
        return {k: _put(v, koids) for k, v in x.items()}
    return [_put(v, koids) for v in x] if isinstance(x, list | tuple) else x


def batch(heads: DataFrame, operations: Sequence[Mapping[str, object]], at: int, new_koid: Callable[[], str] = lambda: uuid.uuid4().hex) -> tuple[DataFrame, list[str]]:
    """The versions that a batch writes, one for each object that it touches, and the object of each operation.

    Operations are ``{"remember": {"type", "properties", "koid" (optional)}}``, ``{"relate": {"from", "rel", "to"}}`` and
    ``{"forget": {"koid"}}``; ``$N.koid`` in any text stands for the object of the N-th one, counted from 1. A batch that
    names an operation still to come, or an object that is not there, writes nothing and raises.
    """
    koids: list[str] = []
    values: dict[str, dict[str, object]] = {}
    kinds: dict[str, str] = {}
    edges: dict[str, list[tuple[str, str]]] = {}
    gone: set[str] = set()
    for op in operations:
        if late := [n for n in map(int, REFERENCE.findall(str(op))) if not 0 < n <= len(koids)]:
            raise ValueError(f"${late[0]} is not there yet")
        (name, body), = _put(op, koids).items()
        if name == "remember":
            k = body.get("koid") or new_koid()
            values.setdefault(k, {}).update(body.get("properties", {}))
            kinds.setdefault(k, body["type"])
        elif name == "relate":
            k = body["from"]
            edges.setdefault(k, []).append((body["rel"], body["to"]))
        elif name == "forget":
            k = body["koid"]
            gone.add(k)
        else:
            raise ValueError(f"unknown operation {name!r}")
        koids.append(k)
    spark = heads.sparkSession
    named = set(koids) | {to for pairs in edges.values() for _, to in pairs}
    known = {r.koid for r in heads.where(F.col("koid").isin(sorted(named))).select("koid").collect()}  # of the objects that the caller named
    if missing := sorted(named - known - set(kinds)):
        raise KeyError(f"no object {', '.join(missing)}")
    out = spark.createDataFrame([], VERSIONS)
    for k in dict.fromkeys(koids):
        props = F.create_map(*[x for n, v in values.get(k, {}).items() for x in (F.lit(n), tagged(v))]).cast(PROPERTIES) if values.get(k) else F.create_map().cast(PROPERTIES)
        new = F.array(*[F.struct(F.lit(r).alias("rel_type"), F.lit(to).alias("target"), F.lit("out").alias("direction")) for r, to in edges.get(k, [])]).cast(SYSTEM["relationships"])
        state = F.lit("deleted" if k in gone else "active")
        if k in known:
            old = F.map_filter("properties", lambda n, _: ~n.isin([*values.get(k, {}), ""]))  # noqa: B023
            links = F.array_union(F.coalesce("relationships", F.array().cast(SYSTEM["relationships"])), new)
            rows = versioned(heads.where(F.col("koid") == k), at, properties=F.map_concat(old, props), relationships=links, **({"state": state} if k in gone else {}))
        else:
            fields = {"koid": F.lit(k), "type_name": F.lit(kinds[k]), "version": F.lit(1), "commit_ts": F.lit(at << 16), "state": state, "origin": F.lit("agent"), "epistemic_status": F.lit("asserted"), "relationships": new}
            rows = spark.range(1).select(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in SYSTEM.items()], props.alias("properties"))
        out = out.unionByName(rows)
    return out, koids
