"""Graph operators over an edge table (src, rel_type, dst)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

LAZY, RENEW = 3, 16


def oriented(edges: DataFrame, direction: str = "out", relation: str | None = None) -> DataFrame:
    """(a, rel_type, b): edges as steps from a to b in the direction asked for."""
    if relation is not None:
        edges = edges.where(F.col("rel_type") == relation)
    out = edges.select(F.col("src").alias("a"), "rel_type", F.col("dst").alias("b"))
    back = edges.select(F.col("dst").alias("a"), "rel_type", F.col("src").alias("b"))
    return {"out": out, "in": back, "both": out.unionAll(back)}[direction]


def traverse(edges: DataFrame, starts: DataFrame, depth: int | None, direction: str = "out", relation: str | None = None, alive: DataFrame | None = None) -> DataFrame:
    """(koid, rel_type, depth): what ``starts`` (koid) reach in at most ``depth`` steps, or in any number, at the least depth.

    All starts expand; of several last steps at one depth the least relation is given. ``alive`` (koid) limits what may
    be reached. A few levels stay one lazy plan; deeper walks cut the lineage at each level and stop when nothing is new.
    """
    if depth is not None and depth <= 0:
        return starts.select("koid", F.lit(None).cast("string").alias("rel_type"), F.lit(0).alias("depth")).where("false")
    steps = oriented(edges, direction, relation)
    if alive is not None:
        steps = steps.join(alive.select(F.col("koid").alias("b")), "b", "left_semi")
    seen = starts.select("koid").distinct()
    frontier = seen
    found = None
    for level in count(1) if depth is None else range(1, depth + 1):
        nxt = frontier.join(steps, F.col("koid") == F.col("a")).groupBy(F.col("b").alias("koid")).agg(F.min("rel_type").alias("rel_type"))
        nxt = nxt.join(seen, "koid", "left_anti").withColumn("depth", F.lit(level))
        if depth is None or depth > LAZY:
            nxt = cut(nxt)
            if nxt.isEmpty():
                break
        found = nxt if found is None else found.unionAll(nxt)
        frontier = nxt.select("koid")
        seen = seen.unionAll(frontier)
        if level % RENEW == 0:  # else the plan grows with the depth
            seen, found = cut(seen), cut(found)
    return found if found is not None else nxt


def closure(edges: DataFrame, child: str = "src", parent: str = "dst") -> DataFrame:
    """(src, dst, depth): the transitive closure of a small hierarchy, each pair at its least depth."""
    base = edges.select(F.col(child).alias("src"), F.col(parent).alias("dst")).distinct()
    out, level, frontier = base.withColumn("depth", F.lit(1)), 1, base
    while True:
        level += 1
        nxt = frontier.alias("f").join(base.alias("e"), F.col("f.dst") == F.col("e.src")).select("f.src", "e.dst").distinct()
        frontier = cut(nxt.join(out, ["src", "dst"], "left_anti"))
        if frontier.isEmpty():
            break
        out = cut(out.unionAll(frontier.withColumn("depth", F.lit(level))))
    return out


def paths(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(path, relations): every path without a repeated node of 1 to ``depth`` steps from ``start``, either way along edges."""
    steps = oriented(edges, "both")
    front = steps.where(F.col("a") == start).select(F.array("a", "b").alias("path"), F.array("rel_type").alias("relations")).where("path[0] <> path[1]")
    out = front
    for _ in range(depth - 1):
        front = front.join(steps, F.element_at("path", -1) == F.col("a")).where(~F.array_contains("path", F.col("b")))
        front = front.select(F.concat("path", F.array("b")).alias("path"), F.concat("relations", F.array("rel_type")).alias("relations"))
        out = out.unionAll(front)
    return out


def relate(edges: DataFrame, new: DataFrame, objects: DataFrame) -> DataFrame:
    """The edges of ``new`` that are not there yet and whose ends are live objects (koid)."""
    live = objects.select("koid")
    own = new.select("src", "rel_type", "dst").distinct()
    for end in ("src", "dst"):
        own = own.join(live.withColumnRenamed("koid", end), end, "left_semi")
    return own.join(edges, ["src", "rel_type", "dst"], "left_anti").select("src", "rel_type", "dst")


def impact(edges: DataFrame, changed: DataFrame, relation: str = "depends_on", depth: int = 6) -> DataFrame:
    """What depends on the changed objects, directly or through others."""
    return traverse(edges, changed, depth, "in", relation)


def snapshot_edges(versions: DataFrame, millis: int) -> DataFrame:
    """(src, rel_type, dst) as the versions of a view held them at an instant."""
    from .temporal import as_of

    rows = as_of(versions, millis).select("ko.koid", F.explode("ko.relationships").alias("r"))
    inward = F.col("r.direction") == "in"
    return rows.select(F.when(inward, F.col("r.target")).otherwise(F.col("koid")).alias("src"), "r.rel_type", F.when(inward, F.col("koid")).otherwise(F.col("r.target")).alias("dst")).distinct()


def add_dependency(edges: DataFrame, new: DataFrame, v: DataFrame) -> DataFrame:
    """DEPENDS_ON edges for (src, dst) between objects that are both active."""
    active = v.where(F.col("ko.state") == "active").select("ko.koid")
    return relate(edges, new.select("src", F.lit("DEPENDS_ON").alias("rel_type"), "dst"), active)
