"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells, one representative kept.

Centroids are fitted on a bounded sample (``SAMPLE`` distinct vectors with the smallest hashes, ``SAMPLE_BYTES`` at most). They only divide the
work: a vector lives in the cell of its nearest centroid and visits every other cell that may hold a partner, so no pair
is lost. Let y live at c' and a partner x, within the angle t of y, at c. Then x lies on c's side of the plane between
c and c', and y at most sin t beyond it: y (c' - c) <= sin t |c' - c|. All other cells are skipped.

Of two chunks only one is visited by the other's vectors, so each pair meets once, and both get the link.

Equal vectors are one from the start, with their number as weight. A cell's residents are cut into chunks by a hash of
their ids. A chunk holds as many vectors as ``CHUNK_BYTES`` allow, fewer where that leaves cores idle, so a vector is
copied to few places even on data without structure, where the bound excludes nothing: the shuffle grows with the number
of chunks reached, the products with the square. Within a chunk its residents are clustered once more, and blocks of
visitors meet only the clusters that the triangle inequality leaves, one matrix product each. Products are taken in single
precision, and those near the threshold again in double. A block yields at once the numbers of links of its visitors and
one spanning edge for each; a chunk keeps only its residents' counts and components, so its memory is bounded.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with nothing; vectors of
other lengths link only among themselves; rows are vectors of their own even where they repeat an id; a row with a null
id links with nothing, has no component and stays; ids are whole numbers, or text that reads as one; vectors have any
length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release
from .components import connected_components
from .words import mix

THRESHOLD = 0.95
SAMPLE, SAMPLE_BYTES, MOST_CELLS, TURNS = 20_000, 32 << 20, 1_024, 8
CHUNK, CHUNK_BYTES, BLOCK = 1_024, 16 << 20, 2 << 20  # least and most of a chunk; products in a block
NESTED, WORTH = 128, 0.5


def usable(vector: Column) -> Column:
    """Whether a vector can link: it has components, all finite, and not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, turns: int = TURNS, seed: int = 5) -> np.ndarray:
    """k unit centroids of unit vectors; one that loses all its vectors stays where it was."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(turns):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        cells, first = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], first)
        size = np.sqrt((sums * sums).sum(1))
        good = size > 1e-12
        c[cells[good]] = sums[good] / size[good, None]
    return c


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one vector length at a time, and their matrix."""
    lengths = column.value_lengths().to_numpy()
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), n)


def _cells(centroids: np.ndarray, reach: float, chunks: dict[int, int] | None):
    """Home cell of each vector; with ``chunks`` (number of each cell's), for each chunk the vectors that go there.

    Role 0 are a chunk's own residents, role 1 all others that it must meet. Places (cell, chunk) are in an order in
    which every second distance counts the other way, so that no place has all the visits.
    """
    apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
    first: dict[int, int] = {}
    places: list[int] = []
    for cell, n in sorted((chunks or {}).items()):
        first[cell] = len(places)
        places += [cell] * n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                ids, weights = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for rows, x in _by_length(batch.column(2)):
                    common = x.shape[1] == centroids.shape[1]
                    if common:
                        s = unit(x) @ centroids.T
                        home = s.argmax(1).astype(np.int64)
                    else:
                        home = np.full(len(rows), -x.shape[1], np.int64)
                    if chunks is None:
                        yield pa.RecordBatch.from_arrays([pa.array(home)], ["home"])
                        continue
                    size = np.array([chunks[h] for h in home.tolist()], np.uint64)
                    at = np.array([first[h] for h in home.tolist()]) + (mix(ids[rows].astype(np.uint64)) % size).astype(np.int64)
                    if common:
                        goes = s.max(1, keepdims=True) - s <= reach * apart[home] + 1e-9
                        goes[np.arange(len(rows)), home] = True
                    out = []
                    for place, cell in enumerate(places):
                        there = goes[:, cell] if common and cell >= 0 else home == cell
                        met = np.where((at + place) % 2 == 0, at > place, at < place)
                        for role, who in ((0, np.flatnonzero(at == place)), (1, np.flatnonzero(there & met))):
                            if len(who):
                                out.append((place, role, ids[rows[who]].tobytes(), weights[rows[who]].tobytes(), x[who].tobytes()))
                    if out:
                        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["place", "role", "ids", "weights", "vectors"])

    return run


class Chunk:
    """The residents of one chunk, gathered first, then compared with block after block of others."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, raw: np.ndarray, threshold: float) -> None:
        x = unit(raw)
        k = len(ids) // NESTED
        self.centres = spherical_kmeans(x[: 16 * k], k, 3) if k > 1 else None
        if self.centres is not None:  # residents in the order of their clusters
            near = np.concatenate([(x[a : a + 4096] @ self.centres.T).argmax(1) for a in range(0, len(x), 4096)])
            order = np.argsort(near, kind="stable")
            ids, weights, raw, x, near = ids[order], weights[order], raw[order], x[order], near[order]
            self.edges = np.searchsorted(near, np.arange(k + 1))
            wide = np.minimum(1, np.einsum("ij,ij->i", x, self.centres[near]))
            least = np.ones(k)
            np.minimum.at(least, near, wide)
            self.radius = np.arccos(np.maximum(-1, least))
        self.ids, self.weights, self.raw, self.unit, self.threshold = ids, weights, raw, x, threshold
        self.single = x.astype(np.float32)
        self.links = np.zeros(len(ids))
        self.part = np.arange(len(ids))  # by place, the component
        self.step = max(16, BLOCK // max(1, len(ids)))
        for a in range(0, len(ids), self.step):
            for _ in self.meet(ids[a : a + self.step], weights[a : a + self.step], raw[a : a + self.step], own=a):
                pass

    def _linked(self, raw: np.ndarray, x: np.ndarray, a: int, z: int) -> np.ndarray:
        """Which of some vectors are linked to which residents from a to z."""
        g = x.astype(np.float32) @ self.single[a:z].T
        linked = g >= self.threshold
        i, j = np.nonzero(np.abs(g - np.float32(self.threshold)) < 1e-5)
        for b in range(0, len(i), 65536):  # single precision cannot tell
            p, q = i[b : b + 65536], j[b : b + 65536]
            cosine = np.einsum("ij,ij->i", x[p], self.unit[a + q])
            linked[p, q] = cosine >= self.threshold
            for k in np.flatnonzero(np.abs(cosine - self.threshold) < 1e-12):  # rounding decides: once more by the plain formula
                u, v = raw[p[k]].astype(np.float64), self.raw[a + q[k]].astype(np.float64)
                linked[p[k], q[k]] = math.fsum(u * v) / (math.sqrt(math.fsum(u * u)) * math.sqrt(math.fsum(v * v))) >= self.threshold
        return linked

    def _meetings(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        """Rows of ``x`` and the residents from, to that they may be linked to."""
        if self.centres is not None:
            angle = np.arccos(np.clip(x @ self.centres.T, -1, 1))
            near = angle <= self.radius + math.acos(self.threshold) + 1e-6
            if near.mean() < WORTH:
                for j in np.flatnonzero(near.any(0)):
                    yield np.flatnonzero(near[:, j]), int(self.edges[j]), int(self.edges[j + 1])
                return
        yield np.arange(len(x)), 0, len(self.ids)

    def meet(self, ids: np.ndarray, weights: np.ndarray, raw: np.ndarray, own: int = -1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Counts the residents' links and joins their components; yields ids, links and a linked resident of the others.

        With ``own`` the others are the residents from that place on.
        """
        x = unit(raw)
        links, some = np.zeros(len(ids)), np.full(len(ids), -1)
        for who, a, z in self._meetings(x):
            linked = self._linked(raw[who], x[who], a, z)
            if own >= 0:
                linked &= ids[who][:, None] != self.ids[None, a:z]
            rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
            if not len(rows):
                continue
            m, who = linked[np.ix_(rows, cols)], who[rows]
            self.links[a + cols] += weights[who].astype(float) @ m.astype(np.float64)
            if own < 0:
                links[who] += m.astype(np.float64) @ self.weights[a + cols].astype(float)
            label = np.zeros(len(cols), np.int64) if m.all() else self._labels(m)
            self._join(a + cols, a + cols[label])
            hit = a + cols[m.argmax(1)]
            before = some[who]
            self._join(hit[before >= 0], before[before >= 0])
            some[who] = hit
        hit = np.flatnonzero(some >= 0)
        if own >= 0:
            self._join(own + hit, some[hit])
        elif len(hit):
            yield ids[hit], links[hit].astype(np.int64), self.ids[some[hit]]

    @staticmethod
    def _labels(m: np.ndarray) -> np.ndarray:
        """For each column of a table of links the first column that it hangs together with."""
        label = np.arange(m.shape[1])
        while True:
            low = np.where(m, label, m.shape[1]).min(1)
            new = np.minimum(label, np.where(m, low[:, None], m.shape[1]).min(0))
            if (new == label).all():
                return label
            label = new

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        part = self.part
        apart = part[a] != part[b]
        if not apart.any():
            return
        up: dict[int, int] = {}

        def find(n: int) -> int:
            while n in up:
                n = up[n]
            return n

        for p, q in set(zip(part[a[apart]].tolist(), part[b[apart]].tolist())):
            p, q = find(p), find(q)
            if p != q:
                up[max(p, q)] = min(p, q)
        old = np.array(list(up))
        to = np.arange(len(part))
        to[old] = [find(n) for n in old.tolist()]
        self.part = to[part]

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, links and a resident of the same component, of the residents that have links."""
        some = np.flatnonzero(self.links)
        return self.ids[some], self.links[some].astype(np.int64), self.ids[self.part[some]]


def _compare(threshold: float, kind: type):
    """Rows sorted by place and role: (id, links, other) for vectors that have links, with a vector of the same component."""

    def rows(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["id", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, chunk = None, [], None

        def begin() -> Chunk:
            out = Chunk(*(np.concatenate(x) for x in zip(*held)), threshold)
            held.clear()
            return out

        for batch in batches:
            for n in range(batch.num_rows):
                place, role, ids, weights, vectors = (c[n].as_py() for c in batch.columns)
                if place != now:
                    if held and chunk is None:
                        chunk = begin()
                    if chunk is not None:
                        yield rows(chunk.own())
                    now, chunk = place, None
                ids, weights = np.frombuffer(ids, np.int64), np.frombuffer(weights, np.int64)
                raw = np.frombuffer(vectors, kind).reshape(len(ids), -1)
                if role == 0:
                    held.append((ids, weights, raw))
                elif held or chunk is not None:
                    chunk = chunk or begin()
                    for i in range(0, len(ids), chunk.step):
                        for found in chunk.meet(ids[i : i + chunk.step], weights[i : i + chunk.step], raw[i : i + chunk.step]):
                            yield rows(found)
        if held and chunk is None:
            chunk = begin()
        if chunk is not None:
            yield rows(chunk.own())
        release()

    return run


def embedding_groups(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each row: vec_id, n_links, component_id, kept."""
    own = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    own = own.withColumn("v", F.when(usable(F.col("v")) & F.col("vec_id").isNotNull(), F.col("v")))
    keys = [F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(seed), F.col("v"))).alias(name) for seed, name in ((1, "k1"), (2, "k2"))]
    keyed = own.select("vec_id", "v", *keys)
    distinct = keyed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"))
    distinct = cut(distinct.withColumn("node", F.monotonically_increasing_id()))
    vectors = distinct.select("node", "weight", "v")
    n, longest = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    kind = np.float32 if "float" in own.schema["v"].dataType.simpleString() else np.float64
    wanted = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * (longest or 1))))
    sample = distinct.select(F.xxhash64("id").alias("h"), "id", "v").orderBy("h", "id").limit(wanted).select("v").toArrow()["v"].combine_chunks()
    by = {x.shape[1]: x for _, x in _by_length(sample)} if len(sample) else {}
    x = max(by.values(), key=len).astype(np.float64) if by else np.zeros((0, 1))
    parallel = df.sparkSession.sparkContext.defaultParallelism
    size = max(CHUNK, min(CHUNK_BYTES // (4 * (longest or 1)), -(-n // (2 * parallel))))
    k = max(1, min(MOST_CELLS, n // size, len(x)))
    centroids = spherical_kmeans(unit(x), k) if len(x) else np.ones((1, 1))
    reach = math.sqrt(1 - threshold * threshold)
    # one row for each cell, of which there are at most MOST_CELLS and one more for each vector length
    residents = {r.home: r["count"] for r in vectors.mapInArrow(_cells(centroids, reach, None), "home long").groupBy("home").count().collect()}
    chunks = {cell: -(-number // size) for cell, number in residents.items()}
    rows = vectors.mapInArrow(_cells(centroids, reach, chunks), "place long, role int, ids binary, weights binary, vectors binary")
    found = rows.repartition("place").sortWithinPartitions("place", "role").mapInArrow(_compare(threshold, kind), "id long, links long, other long")
    found = cut(found)
    labels = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = found.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    known = distinct.drop("v").join(links, "node", "left").join(labels.withColumnRenamed("id", "node"), "node", "left")
    known = known.select("k1", "k2", "id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "node").alias("root"))
    least = known.groupBy("root").agg(F.min("id").alias("c"))
    out = keyed.drop("v").join(known.join(least, "root").select("k1", "k2", "n", "c"), ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
