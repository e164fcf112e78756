"""Exact deduplication by Grace hashing.

Every scan task first combines its own copies, so a text that holds a third of all rows leaves at most a few rows per
task. What is left is dealt out by the hash of the normalised text, and each task runs :class:`GraceTable`: rows go
into an open-addressing table that compares complete contents; when the table outgrows its budget its rows are split
by further hash bits into spill files, and each file is handled the same way until it fits.

Spill files belong to one task attempt and are gone when it ends; a lost executor only means that the task runs again.

Defined results: a null text counts as empty, and all empty texts are copies of each other; a null id ranks after
every other id; rows that repeat one id with one text count as one document, so each carries the same ``kept``
(:func:`exact_dedup` returns one of them); an empty table gives an empty result; columns besides id and text are
carried by :func:`exact_dedup` and ignored by :func:`exact_groups`, whatever their names.
"""

from __future__ import annotations

import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dealt, fresh, input_bytes, release, scratch, slices

WHITE = b" \t\n\v\f\r"
BUDGET = 24 << 20
FANOUT = 16


def normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, WHITE)


class OpenTable:
    """Open addressing with linear probing; two keys are equal only if their complete contents are."""

    def __init__(self) -> None:
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.keys: list[bytes] = []
        self.values: list[tuple] = []
        self.bytes = 0

    def find(self, h: int, key: bytes) -> int:
        """The place of ``key``, or the complement of the free slot where it belongs."""
        slots, at = self.slots, h & self.mask
        while (j := slots[at]) >= 0:
            if self.hashes[j] == h and self.keys[j] == key:
                return j
            at = (at + 1) & self.mask
        return ~at

    def add(self, free: int, h: int, key: bytes, value: tuple, size: int) -> None:
        self.slots[~free] = len(self.keys)
        self.hashes.append(h)
        self.keys.append(key)
        self.values.append(value)
        self.bytes += size + len(key) + 200
        if 2 * len(self.keys) > len(self.slots):
            self.mask = 2 * len(self.slots) - 1
            slots = [-1] * (self.mask + 1)
            for j, x in enumerate(self.hashes):
                at = x & self.mask
                while slots[at] >= 0:
                    at = (at + 1) & self.mask
                slots[at] = j
            self.slots = slots


class GraceTable:
    """Groups (hash, content, value) rows by complete content within a memory budget.

    ``better(a, b)`` merges two values of one content. Spilled buckets are split by four more hash bits each time.
    """

    def __init__(self, better, budget: int = BUDGET, level: int = 0, folder: str | None = None) -> None:
        self.better, self.budget, self.level = better, budget, level
        self.table = OpenTable()
        self.own = folder is None
        self.folder = folder
        self.files: list | None = None

    def add(self, h: int, key: bytes, value: tuple, size: int) -> None:
        at = self.table.find(h, key)
        if at >= 0:
            self.table.values[at] = self.better(self.table.values[at], value)
        elif self.files is not None:
            pickle.dump((h, key, value, size), self.files[h >> (60 - 4 * self.level) & FANOUT - 1], 5)
        else:
            self.table.add(at, h, key, value, size)
            if self.table.bytes > self.budget and self.level < 15:
                self._spill()

    def _spill(self) -> None:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="grace-", dir=scratch())
        here = tempfile.mkdtemp(dir=self.folder)
        self.files = [open(os.path.join(here, str(i)), "w+b") for i in range(FANOUT)]
        t, self.table = self.table, OpenTable()
        for h, key, value in zip(t.hashes, t.keys, t.values):
            pickle.dump((h, key, value, 0), self.files[h >> (60 - 4 * self.level) & FANOUT - 1], 5)

    def results(self) -> Iterator[tuple[int, bytes, tuple]]:
        try:
            yield from zip(self.table.hashes, self.table.keys, self.table.values)
            self.table = OpenTable()
            for f in self.files or ():
                inner = GraceTable(self.better, self.budget, self.level + 1, self.folder)
                f.seek(0)
                while True:
                    try:
                        inner.add(*pickle.load(f))
                    except EOFError:
                        break
                f.close()
                os.unlink(f.name)
                yield from inner.results()
        finally:
            self.close()

    def close(self) -> None:
        for f in self.files or ():
            f.close()
        if self.own and self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


def _rank(value: tuple) -> tuple:
    """Most code points first, then the smallest id; a null id comes last."""
    n, key = value[0], value[1]
    return (-n, key is None, 0 if key is None else key)


def _better(a: tuple, b: tuple) -> tuple:
    x, y = (a, b) if _rank(a) <= _rank(b) else (b, a)
    return (x[0], x[1], a[2] + b[2], x[3])


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n + 64
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], text_at: int, fields: list[pa.Field]) -> Iterator[tuple]:
    """The batches' rows as tuples; notes the columns in ``fields``."""
    for batch in batches:
        fields[:] = [pa.field(f.name, f.type) for f in batch.schema]
        for part in slices(batch, text_at):
            yield from zip(*(c.to_pylist() for c in part.columns))


def _combine(id_at: int, text_at: int, width: int, budget: int):
    """Scan side: the rows' own columns, then hash and count; copies seen together leave one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            table = OpenTable()
            for row in _rows(batches, text_at, fields):
                text = row[text_at]
                key = normal(text)
                h = xxhash.xxh3_64_intdigest(key)
                value = (len(text or ""), row[id_at], 1, row)
                at = table.find(h, key)
                if at >= 0:
                    table.values[at] = _better(table.values[at], value)
                else:
                    table.add(at, h, key, value, 2 * len(key))
                    if table.bytes > budget:
                        yield from flush(table)
                        table = OpenTable()
            yield from flush(table)
            release()

        def flush(table: OpenTable) -> Iterator[tuple]:
            for h, key, v in zip(table.hashes, table.keys, table.values):
                yield v[3] + (h - (1 << 64) if h >> 63 else h, v[2]), len(key)

        fields: list[pa.Field] = []
        yield from _lazy(rows(), fields)

    def _lazy(rows, fields):
        first = next(rows, None)
        if first is None:
            return
        schema = pa.schema([*fields, pa.field("h", pa.int64()), pa.field("n", pa.int64())])

        def again():
            yield first
            yield from rows

        yield from _batches(again(), schema)

    return run


def _reduce(id_at: int, text_at: int, width: int, budget: int):
    """One row for each content: the best row's own columns, the count, and the digest of the normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        grace = GraceTable(_better, budget)
        fields: list[pa.Field] = []
        try:
            for row in _rows(batches, text_at, fields):
                text, h = row[text_at], row[width]
                key = normal(text)
                grace.add(h & (1 << 64) - 1, key, (len(text or ""), row[id_at], row[width + 1], row[:width]), 2 * len(key))
            del fields[width:]
            if fields:
                schema = pa.schema([*fields, pa.field("n", pa.int64()), pa.field("sha", pa.string())])
                out = ((v[3] + (v[2], hashlib.sha256(key).hexdigest()), len(key)) for _, key, v in grace.results())
                yield from _batches(out, schema)
        finally:
            grace.close()
            release()

    return run


def exact_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> tuple[DataFrame, str, str]:
    """One row for each distinct normalised text: the columns of the row that stays, its group's size and digest.

    Returns the frame and the names of its two added columns.
    """
    n, h, sha = fresh(df, "group_size"), fresh(df, "content_hash"), fresh(df, "text_sha256")
    id_at, text_at, width = df.columns.index(id_col), df.columns.index(text_col), len(df.columns)
    part = df.mapInArrow(_combine(id_at, text_at, width, budget), T.StructType([*df.schema, T.StructField(h, T.LongType()), T.StructField(n, T.LongType())]))
    schema = T.StructType([*df.schema, T.StructField(n, T.LongType()), T.StructField(sha, T.StringType())])
    return dealt(part, input_bytes(df, text_col), h).mapInArrow(_reduce(id_at, text_at, width, budget), schema), n, sha


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with its columns: of equal texts the longest original, then the smallest id."""
    out, _, _ = exact_classes(df, id_col, text_col)
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: its id, the id that stays, the group's size, ``kept`` and ``text_sha256``."""
    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    classes, n, sha = exact_classes(slim)
    classes = classes.select(F.col("doc_id").alias("keep_id"), F.col(n).alias("group_size"), F.col(sha).alias("text_sha256"))
    digests = slim.select("doc_id", F.sha2(F.translate(F.coalesce("text", F.lit("")), WHITE.decode(), "").cast("binary"), 256).alias("text_sha256"))
    return digests.join(classes.hint("merge"), "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
