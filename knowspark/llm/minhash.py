"""Near-duplicate detection by DartMinHash signatures, banding, and exact checks.

A document is the weighted set of its shingles of ``SHINGLE`` words, each with the number of times that it occurs, and two
documents are similar by their weighted Jaccard similarity: the sum of the lesser counts over the sum of the greater ones
(the plain similarity where no shingle repeats). Darts are thrown, by hashes, into the region that each shingle's weight
spans: they arrive in the order of their rank as a Poisson process per unit of weight, so two documents see the same
darts wherever their weights overlap. The darts below a rank that leaves about
k (ln k + 2) of them per document are dealt to k coordinates, and each coordinate keeps its earliest. Two documents
agree in a coordinate with the probability of their weighted Jaccard similarity, at a cost of the elements plus k log k.

Documents that agree in a whole band of ROWS coordinates share a bucket; a pair at 0.8 shares none of the BANDS bands
with probability 3e-6. Links are then settled exactly, from the texts:

* for the checks the k-th time of a shingle is an element of its own, which makes the weighted similarity a plain one;
* equal sets (128 bits, from two families of word hashes) are one vertex from the start, so copies are not compared;
* of every vertex in a bucket with others, the shingles that any other such vertex has are counted. Only these can be
  shared, so a vertex with too few of them is done, and a pair's counts bound its similarity;
* each bucket's vertices are compared with the one that has the largest part of shared shingles, a number of pairs
  linear in the bucket. Each comparison also yields a bitmap of which of that pivot's shingles the vertex lacks. The
  links' components become labels;
* what is left between labels is compared too, unless the counts and bitmaps show that it cannot reach 0.8: the pivot's
  shingles that one or the other lacks are in no intersection. So no link between buckets' members goes unseen, and none
  within a label needs to be seen.

A vertex that many are compared with is dealt out by a salt, and its text is read once for each salt. Shared shingles
are counted by blocks of texts as in :mod:`.substring_dedup`, in partitions that grow with the input.

Defined results: a text of 1 to 4 words has one shingle, all its words; a null or empty text has none, is its own class
and stays; rows that repeat an id are one document (its texts' classes are joined); a row with a null id takes the class
of an equal text that has an id, else none, and stays; a text of any length is read whole, with working memory of some
fifty bytes a word; ids are whole numbers, or text that reads as one; an empty table gives an empty result; other columns
are ignored (:func:`near_dedup` carries them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, release, slices
from .components import connected_components
from .substring_dedup import answer_repeats, dealt_blocks, hash_rows, layout
from .words import elements, grams, join, mix, shingles, short_gram, word_hashes

SHINGLE, BANDS, ROWS = 5, 24, 4
PERCENT = 80
SALT = 256
BITS = 512


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def dart_minhash(row: np.ndarray, element: np.ndarray, rows: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """The k coordinates of each row's weighted set; ``row`` is sorted, every row below ``rows`` has an element."""
    out = np.zeros((rows, k), np.uint64)
    if not rows:
        return out
    level = np.zeros(len(row), np.uint64)
    low, width, limit = np.zeros(len(row)), np.ones(len(row)), np.ones(len(row)) if weight is None else weight.astype(float)
    total = np.bincount(row, limit, rows)
    if weight is not None:  # beyond the first unit the region goes on in strips of 1, 2, 4, ... units
        parts = [(row, element, level, low, width, limit)]
        n = 1
        while (more := limit > 2.0 ** (n - 1)).any():
            size = int(more.sum())
            parts.append((row[more], element[more], np.full(size, n, np.uint64), np.full(size, 2.0 ** (n - 1)), np.full(size, 2.0 ** (n - 1)), limit[more]))
            n += 1
        row, element, level, low, width, limit = (np.concatenate(x) for x in zip(*parts))
    start = join(element, level + np.uint64(1))
    wanted = np.arange(rows)
    most = k * (np.log(k) + 2) / total
    while len(wanted):
        place = np.full(rows, -1)
        place[wanted] = np.arange(len(wanted))
        at = np.flatnonzero(place[row] >= 0)
        rank = np.zeros(len(at))
        cells, ranks, names = [], [], []
        turn = 1
        while len(at):
            dart = mix(start[at] + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            u = _uniform(dart)
            near = u > np.exp((rank - most[row[at]]) * width[at])
            at, dart = at[near], dart[near]
            rank = rank[near] - np.log(u[near]) / width[at]
            hit, where = mix(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dart
            good = slice(None) if weight is None else low[at] + width[at] * _uniform(mix(dart + np.uint64(77))) <= limit[at]
            coordinate = (hit >> np.uint64(32)).astype(np.int64) * k >> 32
            cells.append((place[row[at]] * k + coordinate)[good])
            ranks.append(rank[good] / most[row[at]][good])
            names.append(where[good])
            turn += 1
        cell, name = np.concatenate(cells), np.concatenate(names)
        order = np.argsort((cell.astype(np.uint64) << np.uint64(36)) | (np.minimum(np.concatenate(ranks), 1 - 2.0**-36) * 2.0**36).astype(np.uint64), kind="stable")
        cell, name = cell[order], name[order]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
        flat = np.zeros(len(wanted) * k, np.uint64)
        full = np.zeros(len(wanted) * k, bool)
        flat[cell[first]], full[cell[first]] = name[first], True
        done = full.reshape(-1, k).all(1)
        out[wanted[done]] = flat.reshape(-1, k)[done]
        wanted = wanted[~done]
        most[wanted] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, signature.shape[1] // bands)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for j in range(parts.shape[2]):
        key = join(key, parts[:, :, j])
    return key.astype(np.int64)


def text_elements(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and elements of the multisets of all texts' shingles, sorted."""
    hashes, _, _, counts = word_hashes(texts)
    return elements(*shingles(hashes, counts, SHINGLE)[:3])


def _second(hashes: np.ndarray, counts: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same shingles by the other family of word hashes."""
    g = grams(hashes, SHINGLE)
    out = g[np.minimum(at, max(0, len(g) - 1))] if len(g) else np.zeros(len(at), np.uint64)
    for i in np.flatnonzero(counts[row] < SHINGLE):
        out[i] = short_gram(hashes[at[i] : at[i] + counts[row[i]]])[0]
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, a 128-bit hash of the weighted set, its size and the band keys (null for a text without words)."""
    for whole in batches:
        for b in slices(whole, 1):
            hashes, _, _, counts = word_hashes(b.column(1), 2)
            row, gram, times, at = shingles(hashes[0], counts, SHINGLE)
            n = np.bincount(row, times, b.num_rows).astype(np.int64)
            some = np.flatnonzero(n)
            first = np.searchsorted(row, some)
            place = np.cumsum(n > 0) - 1
            keys = band_keys(dart_minhash(place[row], gram, len(some), BANDS * ROWS, None if (times == 1).all() else times))
            sums = []
            for g in (gram, _second(hashes[1], counts, row, at)):
                s = np.zeros(b.num_rows, np.int64)
                if len(some):
                    s[some] = np.add.reduceat(mix(join(g, times.astype(np.uint64), 0x51)), first).astype(np.int64)
                sums.append(s)
            size = np.where(n > 0, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, sums), pa.array(n, pa.int64()), lists], ["id", "sa", "sb", "n", "bands"])
    release()


def _send_shingles(buckets: int):
    """Each block's distinct elements, to the bucket that an element's hash belongs to."""

    def run(group: pa.Table) -> pa.Table:
        return hash_rows(group["block"][0].as_py(), np.unique(text_elements(_texts(group))[1]), buckets)

    return run


def _texts(group: pa.Table) -> pa.Array:
    text = group["text"].combine_chunks()
    return text.chunk(0) if isinstance(text, pa.ChunkedArray) else text


def _count_shared(group: pa.Table, told: pa.Table) -> pa.Table:
    """For each text of a block the number of its shingles that another text, here or in another block, has."""
    row, gram = text_elements(_texts(group))
    _, which, times = np.unique(gram, return_inverse=True, return_counts=True)
    known = times[which] > 1
    parts = [np.frombuffer(x, np.uint64) for x in told["hashes"].to_pylist()]
    if parts and len(gram):
        other = np.sort(np.concatenate(parts))
        known |= other[np.minimum(np.searchsorted(other, gram), len(other) - 1)] == gram
    shared = np.bincount(row, known, group.num_rows).astype(np.int64)
    return pa.Table.from_arrays([group["id"], pa.array(shared)], ["id", "shared"])


def shared_counts(texts: DataFrame, blocks: int, parts: int, buckets: int) -> DataFrame:
    """(id, shared) of texts (id, text), by blocks of bounded size that exchange hashes, not texts."""
    own = dealt_blocks(texts.select("id", "text"), blocks, parts)
    sent = own.groupBy("block").applyInArrow(_send_shingles(buckets), "bucket int, block int, hashes binary").repartitionById(parts, "bucket")
    repeated = sent.groupBy("bucket").applyInArrow(answer_repeats, "block int, hashes binary").repartitionById(parts, "block")
    return own.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(_count_shared, "id long, shared long")


def compare(a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray]:
    """The size of the intersection of two sorted sets, and as bits the places (by hash) where b lacks shingles of a."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    has = b[at] == a
    bits = np.zeros(BITS, np.uint8)
    bits[(a[~has] >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)] = 1
    return int(has.sum()), np.packbits(bits).view(np.int64)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, role, id, text), sorted: for each a and salt a's own text (role 0), then those to compare with it."""
    now, sets = None, []
    for whole in batches:
        for batch in slices(whole, 4):
            row, gram = text_elements(batch.column(4))
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            a, salt, role, ids = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for i in range(batch.num_rows):
                own = gram[edge[i] : edge[i + 1]]
                if (a[i], salt[i]) != now:
                    now, sets = (a[i], salt[i]), []
                if not len(own):
                    continue
                if role[i] == 0:
                    sets.append(own.copy())
                    continue
                found = [(len(s), *compare(s, own)) for s in sets]
                similar = any(100 * both >= PERCENT * (n + len(own) - both) for n, both, _ in found)
                one = found[0] if len(found) == 1 else (None, None, None)  # an id with several texts gives no bound
                out.append((a[i], ids[i], similar, one[0], one[1], one[2]))
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["a", "b", "similar", "an", "both", "lacks"])
    release()


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """For pairs (a, b) whether their texts (id, text) are similar, and what :func:`compare` gives."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).alias("salts"))
    salted = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b")
    asked = salted.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("id"))
    asked = asked.unionAll(salted.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("id")))
    rows = asked.join(texts, "id").select("a", "salt", "role", "id", "text")
    kind = "a long, b long, similar boolean, an long, both long, lacks array<long>"
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(_check, kind)


def _reaches(both, n, m):
    """Whether sets of n and m elements can be similar with ``both`` in common."""
    return both * 100 >= (n + m - both) * PERCENT


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, class_id (the smallest id of its class) and kept (whether it is that one)."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut(docs.mapInArrow(_sign, "id long, sa long, sb long, n long, bands array<long>"))
    sets = signed.where("n > 0").groupBy("sa", "sb").agg(F.min("id").alias("rep"))
    reps = signed.join(sets.select("rep", "sa", "sb"), ["sa", "sb"]).where("id = rep").dropDuplicates(["sa", "sb"])
    rows = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    shared_buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket")
    members = cut(rows.join(shared_buckets, "bucket"))
    texts = cut(docs.join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))

    # an id with several texts counts by the one that allows most
    counts = shared_counts(texts, *layout(docs, "text")).groupBy(F.col("id").alias("rep")).agg(F.max("shared").alias("shared"))
    members = members.join(counts, "rep").where(F.col("shared") * 100 >= F.col("n") * PERCENT)
    order = F.struct((F.col("shared") / F.col("n")).alias("part"), (-F.col("rep")).alias("first"))
    pivots = members.groupBy("bucket").agg(F.max_by(F.struct(F.col("rep").alias("pivot"), F.col("n").alias("pn"), F.col("shared").alias("ps")), order).alias("p"), F.count(F.lit(1)).alias("c"))
    members = cut(members.join(pivots.where("c > 1").select("bucket", "c", "p.*"), "bucket"))

    star = members.where("rep <> pivot").where(_reaches(F.least("shared", "ps"), F.col("n"), F.col("pn")))
    seen = cut(verify(star.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), texts))
    links = seen.where("similar").select("a", "b")
    labels = connected_components(links)

    named = members.where("c > 2 and rep <> pivot").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("bucket", "rep", "n", "shared", "pivot", F.coalesce("component", "rep").alias("label"))
    bound = seen.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), "an", "both", "lacks")
    sizes = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    major = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    open_ = cut(named.join(major.select("bucket", "major"), "bucket").join(bound, ["pivot", "rep"], "left").drop("pivot"))
    if not open_.isEmpty():
        minor = open_.where("label <> major").select("bucket", *[F.col(c).alias(f"{c}_") for c in ("rep", "n", "shared", "label", "both", "lacks")])
        lacking = F.aggregate(F.zip_with("lacks", "lacks_", lambda x, y: F.bit_count(x.bitwiseOR(y))), F.lit(0), lambda s, x: s + x)
        most = F.col("an") - lacking + F.least(F.col("shared") - F.col("both"), F.col("shared_") - F.col("both_"))
        most = F.least("shared", "shared_", F.coalesce(most, F.col("shared")))
        apart = (F.col("label") != F.col("label_")) & ((F.col("label") == F.col("major")) | (F.col("rep_") < F.col("rep")))
        near = open_.alias("x").join(minor.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & apart & _reaches(most, F.col("n"), F.col("n_")))
        pairs = near.select(F.col("rep_").alias("a"), F.col("rep").alias("b")).distinct()
        more = cut(verify(pairs, texts).where("similar").select("a", "b"))
        if not more.isEmpty():
            labels = connected_components(links.unionAll(more))

    classes = sets.where("rep is not null").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.select("sa", "sb", F.coalesce("component", "rep").alias("class_id"))
    out = signed.select("id", F.when(F.col("n") > 0, F.col("sa")).alias("sa"), F.when(F.col("n") > 0, F.col("sb")).alias("sb")).join(classes, ["sa", "sb"], "left")
    out = out.select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("class_id")))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of each class the one with the smallest id."""
    gone = near_classes(df, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(fresh(df, "gone"))).distinct()
    return df.join(gone, F.col(id_col) == gone[gone.columns[0]], "left_anti")
