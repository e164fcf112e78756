"""Substring deduplication with difference-cover anchors.

A word goes when a window of ``WINDOW`` words covers it whose words also start earlier, in a document with a smaller id
or further up in the same one; windows are judged on the input.

Two equal windows at places i and j share an offset d below the period at which i + d and j + d both lie in the
difference cover modulo the period. So anchors of WINDOW - PERIOD + 1 words are hashed only at cover places, and every
repeated window holds a repeated anchor at a place of the cover. Where anchors repeat they are extended: the whole
windows around them are hashed (128 bits, from two families of word hashes that know nothing of each other) and compared.

Documents are dealt into blocks of bounded size by a hash of their id and text, blocks into partitions of about
``PART_BYTES``, which work off one block after another. A block first settles its own repeats, then sends each distinct
hash once to the bucket that the hash belongs to, so a passage that a third of all documents share costs one hash a
block; only buckets that a block has hashes for are visited, so the work grows with the hashes. Buckets answer each block
with the hashes that another block has (anchors), then with the places whose window starts earlier elsewhere (windows),
a stretch of ``STRETCH`` hashes at a time. All three passes read the same shuffled blocks.

Defined results: a null or empty text has no words; a text of fewer than WINDOW words loses none; a null id ranks after
every other id; rows that repeat an id are the same document, so equal places in them are not earlier than each other;
a text of any length stays in one block, with working memory of some thirty bytes a word; ids are whole numbers, or text
that reads as one; an empty table gives an empty result; other columns are carried on request, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, input_bytes, release
from .words import grams, word_hashes

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)  # every difference modulo 13 is one of two members
BLOCK_BYTES, PART_BYTES = 2 << 20, 64 << 20
BUCKETS = 4  # for each partition
STRETCH = 1 << 20
LAST = np.iinfo(np.int64).max


class Block:
    """The words of one block's documents, in the order of id and text, and what is found in them."""

    def __init__(self, group: pa.Table, window: int) -> None:
        self.table = group.combine_chunks().sort_by([("id", "ascending"), ("text", "ascending")])  # the same order in every pass
        self.window = window
        text = self.table["text"].combine_chunks()
        release()  # of the block before
        if isinstance(text, pa.ChunkedArray):
            text = text.chunk(0) if text.num_chunks else pa.array([], pa.string())
        self.text = text
        (self.hashes, self.others), _, _, self.counts = word_hashes(text, 2)
        self.ends = np.cumsum(self.counts)
        self.begins = self.ends - self.counts
        self.ids = self.table["id"].cast(pa.int64()).fill_null(LAST).to_numpy()

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the cover in texts long enough for a window, and their hashes."""
        size = self.window - PERIOD + 1
        g = grams(self.hashes, size)
        row = self.rows()[: len(g)]
        at = np.arange(len(g))
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        good = cover[(at - self.begins[row]) % PERIOD] & (at + size <= self.ends[row]) & (self.counts[row] >= self.window)
        at = np.flatnonzero(good)
        return at, g[at]

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor that is in ``repeated`` (sorted) or twice in the block."""
        at, g = self.anchors()
        if not len(at):
            return at
        _, which, count = np.unique(g, return_inverse=True, return_counts=True)
        known = count[which] > 1
        if len(repeated):
            place = np.minimum(np.searchsorted(repeated, g), len(repeated) - 1)
            known |= repeated[place] == g
        at = at[known]
        row = self.rows()
        change = np.zeros(len(self.hashes) + 1, np.int32)
        np.add.at(change, np.maximum(at - PERIOD + 1, self.begins[row[at]]), 1)
        np.add.at(change, at + 1, -1)
        inside = np.cumsum(change[:-1]) > 0
        starts = np.flatnonzero(inside)
        return starts[starts + self.window <= self.ends[row[starts]]]


def layout(df: DataFrame, text: str) -> tuple[int, int, int]:
    """Numbers of blocks, of partitions, and of buckets of hashes, all in proportion to the input."""
    parallel = df.sparkSession.sparkContext.defaultParallelism
    size = input_bytes(df, text)
    parts = max(2 * parallel, -(-size // PART_BYTES))
    return max(parts, -(-size // BLOCK_BYTES)), parts, BUCKETS * parts


def dealt_blocks(df: DataFrame, blocks: int, parts: int) -> DataFrame:
    """``df`` (id, text, ...) with its block; one exchange that all passes share."""
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")
    return df.select(block.alias("block"), "*").repartitionById(parts, "block")


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """By range, so that sorted hashes have sorted buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def stretches(h: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) for each bucket that occurs among sorted hashes."""
    if len(h):
        b = bucket_of(h, buckets)
        edge = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        yield from zip(b[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(h)])


def shares(parts: list[np.ndarray]) -> Iterator[list[slice]]:
    """Cuts sorted arrays at common hashes, so that about ``STRETCH`` of all of them are looked at together."""
    total = sum(map(len, parts))
    pieces = -(-total // STRETCH)
    if pieces > 1:  # edges from a regular sample of all arrays
        sample = np.sort(np.concatenate([p[:: max(1, total // 65536)] for p in parts]))
        edges = np.unique(sample[np.arange(1, pieces) * len(sample) // pieces])
    else:
        edges = np.zeros(0, np.uint64)
    cuts = [np.r_[0, np.searchsorted(p, edges), len(p)] for p in parts]
    for i in range(len(edges) + 1):
        yield [slice(c[i], c[i + 1]) for c in cuts]


def pack_array(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _gaps(places: np.ndarray) -> bytes:
    return np.diff(places, prepend=0).astype(np.uint32).tobytes()


def _places(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint32), dtype=np.int64)


def no_rows(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


HASHES = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary())])
ANSWERS = pa.schema([("block", pa.int32()), ("hashes", pa.binary())])
WINDOWS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("places", pa.binary()), ("ids", pa.binary()), ("begins", pa.binary())])
PLACES = pa.schema([("block", pa.int32()), ("places", pa.binary())])


def _block_of(group: pa.Table) -> int:
    return group["block"][0].as_py()


def hash_rows(block: int, h: np.ndarray, buckets: int) -> pa.Table:
    """A block's sorted distinct hashes, a row for each bucket."""
    out = [(bucket, block, pack_array(h[a:z])) for bucket, a, z in stretches(h, buckets)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), HASHES)], schema=HASHES) if out else no_rows(HASHES)


def _send_anchors(window: int, buckets: int):
    def run(group: pa.Table) -> pa.Table:
        return hash_rows(_block_of(group), np.unique(Block(group, window).anchors()[1]), buckets)

    return run


def answer_repeats(group: pa.Table) -> pa.Table:
    """For one bucket's rows (block, hashes), each block's hashes sorted and distinct: those that another block has too."""
    blocks = group["block"].to_numpy()
    parts = [np.frombuffer(x, np.uint64) for x in group["hashes"].to_pylist()]
    found = []
    for slices_ in shares(parts):
        own = [p[x] for p, x in zip(parts, slices_)]
        h = np.concatenate(own)
        owner = np.repeat(np.arange(len(own), dtype=np.int32), [len(p) for p in own])
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        same = h[1:] == h[:-1]
        twice = np.r_[same, False] | np.r_[False, same]
        h, owner = h[twice], owner[twice]
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
        edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(h) else np.zeros(0, int)
        found += [(blocks[owner[a]], pack_array(h[a:z])) for a, z in zip(edge, np.r_[edge[1:], len(h)])]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), ANSWERS)], schema=ANSWERS) if found else no_rows(ANSWERS)


def _send_windows(window: int, buckets: int):
    def run(group: pa.Table, told: pa.Table) -> pa.Table:
        if not group.num_rows:
            return no_rows(WINDOWS)
        block, b = _block_of(group), Block(group, window)
        parts = [np.frombuffer(x, np.uint64) for x in told["hashes"].to_pylist()]
        at = b.candidates(np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64))
        if not len(at):
            return no_rows(WINDOWS)
        high, low = grams(b.hashes, window)[at], grams(b.others, window, 5)[at]
        row = b.rows()[at]
        order = np.lexsort((at, low, high))  # places come in the order of id, then place
        same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
        first = np.r_[True, ~same]
        lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        ids, within = b.ids[row], at - b.begins[row]
        later = (ids[order] != ids[lead]) | (within[order] > within[lead])
        out = [(block % buckets, block, b"", b"", _gaps(np.sort(at[order[~first & later]])), b"", b"")]
        keep = order[first | ~later]  # rows that repeat an id share the fate of the first
        for bucket, a, z in stretches(high[keep], buckets):
            own = keep[a:z]  # in the order of their hashes
            rows, which = np.unique(row[own], return_inverse=True)
            out.append((bucket, block, pack_array(high[own]), pack_array(low[own]), pack_array(at[own].astype(np.uint32)), pack_array(b.ids[rows]), pack_array(b.begins[rows])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), WINDOWS)], schema=WINDOWS)

    return run


def _answer_windows(group: pa.Table) -> pa.Table:
    out: dict[int, list[np.ndarray]] = {}
    own = []
    for r in group.to_pylist():
        if r["high"]:
            own.append(r)
        elif r["places"]:
            out.setdefault(r["block"], []).append(_places(r["places"]))
    highs = [np.frombuffer(r["high"], np.uint64) for r in own]
    for slices_ in shares(highs):
        some = [(r, h[x], x) for r, h, x in zip(own, highs, slices_) if x.stop > x.start]
        if not some:
            continue
        ids, within, places, lows = [], [], [], []
        for r, _, x in some:
            p = np.frombuffer(r["places"], np.uint32)[x].astype(np.int64)
            begins = np.frombuffer(r["begins"], np.int64)
            k = np.searchsorted(begins, p, "right") - 1
            ids.append(np.frombuffer(r["ids"], np.int64)[k])
            within.append(p - begins[k])
            places.append(p)
            lows.append(np.frombuffer(r["low"], np.uint64)[x])
        high, low = np.concatenate([h for _, h, _ in some]), np.concatenate(lows)
        owner = np.repeat(np.arange(len(some)), [len(p) for p in places])
        at, key, inside = np.concatenate(places), np.concatenate(ids), np.concatenate(within)
        order = np.lexsort((inside, key, low, high))
        same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
        first = np.r_[True, ~same]
        lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        gone = order[~first & ((key[order] != key[lead]) | (inside[order] > inside[lead]))]
        gone = gone[np.argsort(owner[gone], kind="stable")]
        edge = np.flatnonzero(np.r_[True, owner[gone][1:] != owner[gone][:-1]]) if len(gone) else []
        for a, z in zip(edge, [*edge[1:], len(gone)]):
            out.setdefault(some[owner[gone[a]]][0]["block"], []).append(at[gone[a:z]])
    blocks = list(out)
    told = [_gaps(np.sort(np.concatenate(out[b]))) for b in blocks]
    return pa.Table.from_arrays([pa.array(blocks, pa.int32()), pa.array(told, pa.binary())], schema=PLACES)


def _remove(window: int, width: int, whole: bool):
    def run(group: pa.Table, told: pa.Table) -> pa.Table:
        b = Block(group, window)
        change = np.zeros(len(b.hashes) + 1, np.int32)
        for raw in told["places"].to_pylist():
            at = _places(raw)
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        total = np.r_[0, np.cumsum(gone)]
        removed = total[b.ends] - total[b.begins]
        kept = []
        for text, n, a, z in zip(b.text.to_pylist(), removed, b.begins, b.ends):
            if whole and not n:
                kept.append(text)
                continue
            words = (text or "").encode().split()
            if n:
                words = [w for w, out in zip(words, gone[a:z].tolist()) if not out]
            kept.append(b" ".join(words).decode())
        columns = [*b.table.columns[1 : 1 + width], pa.array(b.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
        return pa.Table.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return run


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, window: int = WINDOW, whole: bool = False) -> DataFrame:
    """One row for each document: its id, the columns in ``carry``, n_words, n_removed and kept_text.

    ``kept_text`` is the words that stay, joined by one space; with ``whole``, a text that loses nothing is left as it
    is, white space and all. Columns of ``carry`` that clash with these names get a
    longer one of the result's.
    """
    if window < PERIOD + 3:
        raise ValueError("the window is too short for the cover")
    carry = carry or []
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(carry)])
    blocks, parts, buckets = layout(slim, "text")
    own = dealt_blocks(slim, blocks, parts)
    ddl = {pa.int32(): "int", pa.binary(): "binary"}
    kind = lambda schema: ", ".join(f"{f.name} {ddl[f.type]}" for f in schema)
    anchors = own.groupBy("block").applyInArrow(_send_anchors(window, buckets), kind(HASHES))
    repeated = anchors.repartitionById(parts, "bucket").groupBy("bucket").applyInArrow(answer_repeats, kind(ANSWERS)).repartitionById(parts, "block")
    windows = own.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(_send_windows(window, buckets), kind(WINDOWS))
    places = windows.repartitionById(parts, "bucket").groupBy("bucket").applyInArrow(_answer_windows, kind(PLACES)).repartitionById(parts, "block")
    width = len(slim.columns)
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate([*slim.schema.fields, *(T.StructField("n", k) for k in (T.LongType(), T.LongType(), T.StringType()))])]
    out = own.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(_remove(window, width, whole), T.StructType(fields))
    out = out.drop("c1")
    names = [id_col, *carry]
    for name in ("n_words", "n_removed", "kept_text"):
        names.append(fresh(df.select(id_col, *carry), name))
    return out.toDF(*names)


def substring_filter(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with repeated passages cut out of its texts; texts without any stay as they are.

    A document of which nothing is left goes. ``length_col``, where ``df`` has it, follows the text.
    """
    carry = [c for c in df.columns if c not in (id_col, text_col)]
    out = substring_dedup(df, id_col, text_col, carry, whole=True)
    n_words, n_removed, kept = out.columns[-3:]
    out = out.where((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_words)))
    if length_col in carry:
        out = out.withColumn(length_col, F.when(F.col(n_removed) > 0, F.length(kept).cast(df.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.select(*[F.col(kept).alias(c) if c == text_col else F.col(c).cast(df.schema[c].dataType).alias(c) for c in df.columns])


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = substring_dedup(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
