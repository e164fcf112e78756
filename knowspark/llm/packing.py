"""Best-fit packing of documents into training sequences of several permitted lengths.

A document longer than the longest sequence is cut into pieces of that length and a rest; nothing is dropped. Pieces
are dealt into shards by a hash, so a shard is a random share of the table whatever its keys, and shards are packed
side by side. Within a shard pieces go longest first into the open bin with the least room that still holds them. Where
none does, a new bin is opened in the length that will cost least for each unit it comes to hold. That is foreseen from
the sizes of the pieces still to come: for every permitted length the bin is filled up with the longest of them that fit
and costed at the length it would be downsized to; of equals the longer is opened. So a piece
that leaves a short bin half empty opens a longer one, where three of its like go in twice the length. In the end each
bin is downsized to the shortest permitted length that holds its contents, which is often shorter than foreseen. A shard
takes the cheaper of this plan and of the one that opens the shortest length throughout.

Defined results: null and empty texts are pieces of no length that take no room; they go to any bin, or to one of the
shortest length where there is no other. Texts have any length. Repeated ids are separate documents, told apart by ``item``; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTHS = (512, 1024, 2048, 4096)
SHARD = 50_000
OVERHEAD = 64


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ``[\\x20\\x09-\\x0D]``."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def default_cost(length: int) -> float:
    """Cost of a sequence in units: its length, the share that attention adds in a network 4,096 wide (length squared by
    six times the width), and a fixed ``OVERHEAD`` for each sequence. Of full sequences 1,024 is the cheapest for a unit."""
    return length + length * length / (6 * 4096) + OVERHEAD


class Room:
    """Open bins by the room left in them; finds the least room that is enough by words of bits."""

    def __init__(self, most: int) -> None:
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]
        self.bits = 0

    def put(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        self.bits |= 1 << room

    def take(self, need: int) -> tuple[int, int] | None:
        up = self.bits >> need
        if not up:
            return None
        room = need + (up & -up).bit_length() - 1
        number = self.bins[room].pop()
        if not self.bins[room]:
            self.bits &= ~(1 << room)
        return room, number


class Ahead:
    """The sizes of the pieces still to come, and what of them would go into a new bin."""

    def __init__(self, sizes: np.ndarray, most: int) -> None:
        self.counts = np.bincount(sizes, minlength=most + 1).tolist()
        self.bits = sum(1 << n for n, c in enumerate(self.counts) if c and n)

    def pass_by(self, size: int) -> None:
        self.counts[size] -= 1
        if size and not self.counts[size]:
            self.bits &= ~(1 << size)

    def fill(self, room: int) -> int:
        """Units that the longest pieces which fit, one after another, bring into a room."""
        got, bits = 0, self.bits
        while bits := bits & ((1 << room + 1) - 1):
            size = bits.bit_length() - 1
            n = min(self.counts[size], room // size)
            got += n * size
            room -= n * size
            bits &= ~(1 << size)
        return got


def place(sizes: np.ndarray, lengths: Sequence[int], cost, foresee: bool) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """Bin and offset of each item, and the opened length and used units of each bin, by one plan."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    opened: list[int] = []
    used: list[int] = []
    room, ahead = Room(lengths[-1]), Ahead(sizes, lengths[-1])
    price = [cost(n) for n in lengths]
    for i in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[i])
        ahead.pass_by(need)
        found = room.take(need)
        if found is None:
            first = at = bisect_left(lengths, need)
            if foresee and need:
                least = None
                for k in range(first, len(lengths)):
                    fill = need + ahead.fill(lengths[k] - need)
                    each = price[bisect_left(lengths, fill)] / fill
                    if least is None or each <= least:  # of equals the one with more room
                        least, at = each, k
            found = lengths[at], len(opened)
            opened.append(lengths[at])
            used.append(0)
        free, number = found
        bins[i], offsets[i] = number, used[number]
        used[number] += need
        room.put(free - need, number)
    return bins, offsets, opened, used


def best_fit(sizes: np.ndarray, lengths: Sequence[int] = LENGTHS, cost=default_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the length of each bin. Items may not be longer than the longest length."""
    lengths = sorted(lengths)
    best = None
    for foresee in (True, False):
        bins, offsets, _, used = place(sizes, lengths, cost, foresee)
        final = np.array([lengths[bisect_left(lengths, u)] for u in used], np.int64)
        total = sum(cost(n) * int(c) for n, c in zip(*np.unique(final, return_counts=True)))
        if best is None or total < best[0]:
            best = total, (bins, offsets, final)
    return best[1]


def pieces(docs: DataFrame, size: Column, lengths: Sequence[int] = LENGTHS) -> DataFrame:
    """doc_id, item (a number for the row), piece, first unit and size of each piece."""
    most = max(lengths)
    out = docs.select("doc_id", F.monotonically_increasing_id().alias("item"), size.cast("long").alias("total"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(most).cast("long"))
    out = out.select("doc_id", "item", "total", F.posexplode(starts).alias("piece", "first"))
    return out.select("doc_id", "item", "piece", "first", F.least(F.col("total") - F.col("first"), F.lit(most)).alias("size"))


def pack(docs: DataFrame, size: Column, lengths: Sequence[int] = LENGTHS, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, first, size of each piece; its bin_id, bin_length and offset there."""
    from .common import cut

    own = cut(pieces(docs, size, lengths))
    shards = max(1, -(-own.count() // shard))
    own = own.withColumn("shard", F.pmod(F.xxhash64("item", "piece"), F.lit(shards)))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("item", "ascending"), ("piece", "ascending")])
        sizes = group["size"].to_numpy()
        bins, offsets, final = best_fit(sizes, lengths)
        number = group["shard"][0].as_py() << 32
        columns = [group["doc_id"], group["piece"], group["first"], group["size"], pa.array(bins + number), pa.array(final[bins].astype(np.int32)), pa.array(offsets.astype(np.int32))]
        return pa.Table.from_arrays(columns, ["doc_id", "piece", "first", "size", "bin_id", "bin_length", "offset"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.groupBy("shard").applyInArrow(run, f"doc_id {kind}, piece int, first long, size long, bin_id long, bin_length int, offset int")
