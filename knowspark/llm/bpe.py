"""Byte-level BPE encoding and decoding.

Texts are split as the pattern of the rank file's tokenizer says, by character classes over whole Arrow columns; equal
pieces are encoded once. A piece's bytes are mapped to Latin-1, an Aho-Corasick automaton lists the tokens at each of
its places, and the encoder takes the longest token whose neighbour on the left accepts it, going back a token where
none does. Two tokens accept each other if merging their joined bytes gives just those two, which is remembered for
each pair; a sequence in which all neighbours accept each other is the one that the merges give, so each place is left
at most once and the work is linear.

Defined results: a null or empty text has no tokens; ids of documents may be null or repeated; an empty table gives an
empty result; very long texts are worked off in pieces cut where a word starts.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .words import text_buffer

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The code points of Unicode's White_Space property.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
PIECE = 2 << 20
REMEMBERED = 400_000
LONG = 1 << 15
SAFE_CUT = re.compile(rb"[A-Za-z0-9.,] (?=[A-Za-z])")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other, in the Unicode version of the tokenizers."""
    from tokenizers import Regex, pre_tokenizers

    out = np.zeros(0x110000, np.uint8)
    points = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        inside = np.ones(len(points), bool)
        for _, (a, b) in pre_tokenizers.Split(Regex(name), "removed").pre_tokenize_str(text):
            inside[a:b] = False
        out[points[inside]] = kind
    out[list(WHITE_SPACE)] = SPACE
    return out


def code_points(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the first byte of each, with the end as one more."""
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
    at = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), out=at[1:])
    return cp, at


def piece_starts(cp: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
    """First code points of the pieces; ``row_starts`` are those of the rows, each a text of its own.

    The rules: one space belongs to the letters, numbers or others after it; of white space before something else all
    but the last character is a piece, and the last one too unless it is such a space; 's 't 're 've 'm 'll 'd are pieces.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    row = np.zeros(n + 1, bool)
    row[row_starts] = True
    row[n] = True
    new |= row[:-1]
    s = np.flatnonzero(new)
    e = np.r_[s[1:], n]
    k = kind[s]
    mark = np.zeros(n + 1, bool)
    space = k == SPACE
    mark[s[space & ((e - s > 1) | row[e] | (cp[e - 1] != 32))]] = True
    alone = space & ~row[e] & (cp[e - 1] != 32)
    mark[e[alone] - 1] = True
    word = ~space
    ws = s[word]
    led = np.zeros(len(ws), bool)
    inner = ~row[ws]
    led[inner] = cp[ws[inner] - 1] == 32
    mark[ws - led] = True
    quote = np.flatnonzero((k == OTHER) & (e - s == 1) & (cp[s] == 39) & ~row[e])
    quote = quote[(quote + 1 < len(s))]
    quote = quote[k[quote + 1] == LETTER]
    quote = quote[row[s[quote]] | (cp[s[quote] - 1] != 32)]
    if len(quote):
        a = s[quote + 1]
        left = e[quote + 1] - a
        one = cp[a]
        two = cp[np.minimum(a + 1, n - 1)]
        size = np.isin(one, [115, 116, 109, 100]).astype(np.int64)
        size[(left > 1) & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))] = 2
        mark[a[size > 0]] = False
        rest = (size > 0) & (left > size)
        mark[(a + size)[rest]] = True
    return np.flatnonzero(mark[:n])


def text_pieces(texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Cuts a column into byte strings of about PIECE bytes: bytes, starts of rows within, and the rows they belong to."""
    buf, offsets = text_buffer(texts)
    at, last = int(offsets[0]), int(offsets[-1])
    while at < last:
        to = min(at + PIECE, last)
        if to < last:
            row = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[row] > at:
                to = int(offsets[row])
            else:
                end = int(offsets[row + 1])
                m = None
                while to < end and m is None:
                    m = SAFE_CUT.search(buf[to : min(to + PIECE, end)].tobytes())
                    to = to + m.start() + 1 if m else min(to + PIECE, end)
        first = int(np.searchsorted(offsets, at, "right")) - 1
        stop = int(np.searchsorted(offsets, to, "left"))
        rows = np.arange(first, stop)
        rows = rows[offsets[rows + 1] > np.maximum(offsets[rows], at)]
        yield buf[at:to].tobytes(), np.maximum(offsets[rows], at) - at, rows
        at = to


def unique_pieces(raw: bytes, starts: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, list[bytes]]:
    """Number of each piece in the list of distinct ones, and that list; pieces touch each other."""
    offsets = np.r_[starts, len(raw)].astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    coded = data.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


class Encoder:
    """Ranks of byte strings, with what has been found out about pairs and pieces so far."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick

        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        size = max(self.tokens) + 1
        self.lengths = np.zeros(size, np.int64)
        for rank, token in self.tokens.items():
            self.lengths[rank] = len(token)
        self.firsts = np.r_[0, np.cumsum(self.lengths)]
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)

    def merged(self, raw: bytes) -> list[int]:
        """What the merges give, one after another, lowest rank first: only for short strings."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def accept(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``; ``left`` of -1 stands for the start."""
        key = (left, right)
        out = self.pairs.get(key)
        if out is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            raw = (self.tokens[left] if left >= 0 else b"") + self.tokens[right]
            out = self.pairs[key] = self.merged(raw) == ([left, right] if left >= 0 else [right])
        return out

    def _matches(self, raw: bytes) -> list[list[tuple[int, int]]]:
        """For each place the tokens that start there, as size and rank, shortest first."""
        found: list[list[tuple[int, int]]] = [[] for _ in raw]
        for end, (size, rank) in self.automaton.iter(raw.decode("latin-1")):
            found[end + 1 - size].append((size, rank))
        return found

    def piece(self, raw: bytes) -> tuple[int, ...]:
        if (rank := self.ranks.get(raw)) is not None:
            return (rank,)
        if (out := self.known.get(raw)) is not None:
            return out
        n = len(raw)
        found = self._matches(raw) if n <= LONG else Matches(self, raw)
        open_ = bytearray([1]) * (n + 1)
        tried = array("i", [-1]) * n
        at, path = 0, [(-1, 0)]
        while at < n:
            options = found[at]
            j = tried[at] if tried[at] >= 0 else len(options)  # they came shortest first
            left = path[-1][0]
            while j:
                j -= 1
                size, rank = options[j]
                if open_[at + size] and self.accept(left, rank):
                    tried[at] = j
                    path.append((rank, at))
                    at += size
                    break
            else:
                open_[at] = 0
                if len(path) == 1:
                    raise ValueError("the ranks do not cover all bytes")
                at = path.pop()[1]
        out = tuple(rank for rank, _ in path[1:])
        if n <= 64:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[raw] = out
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and the number of each row's."""
        counts = np.zeros(len(texts), np.int64)
        out = []
        for raw, row_bytes, rows in text_pieces(texts):
            cp, at = code_points(raw)
            first = np.searchsorted(at, row_bytes)
            starts = piece_starts(cp, first)
            number, distinct = unique_pieces(raw, at[starts])
            coded = [self.piece(p) for p in distinct]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            flat = np.fromiter((t for c in coded for t in c), np.uint32, int(sizes.sum()))
            begin = np.cumsum(sizes) - sizes
            out.append(flat[spread(begin[number], sizes[number])])
            per_row = np.add.reduceat(sizes[number], np.searchsorted(starts, first))
            counts[rows] += per_row
        return np.concatenate(out) if out else np.zeros(0, np.uint32), counts

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[spread(self.firsts[ids], self.lengths[ids])].tobytes()


class Matches:
    """The matches of a long piece, found a stretch at a time; the encoder looks back only a little."""

    def __init__(self, encoder: Encoder, raw: bytes) -> None:
        self.encoder, self.raw = encoder, raw
        self.overlap = int(encoder.lengths.max())
        self.held: dict[int, list[list[tuple[int, int]]]] = {}

    def __getitem__(self, at: int) -> list[tuple[int, int]]:
        block, within = divmod(at, LONG)
        if block not in self.held:
            while len(self.held) > 3:
                del self.held[next(iter(self.held))]
            self.held[block] = self.encoder._matches(self.raw[block * LONG : (block + 1) * LONG + self.overlap])
        return self.held[block][within]


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first .. first + size - 1 of each pair, one after another."""
    total = int(size.sum())
    skip = np.cumsum(size) - size
    return np.repeat(first - skip, size) + np.arange(total)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id and the token ids (array of ints) of each text; ``path`` is a rank file that every executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in (part for batch in batches for part in slices(batch, 1, 4 << 20)):
            ids, counts = e.encode(b.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "ids"])

    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """id and the bytes that the token ids stand for; null ids give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            raw = [e.decode(np.asarray(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["id", "bytes"])

    own = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, bytes binary").withColumnRenamed("id", id_col)


def digests(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian unsigned 32-bit) and of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in (part for batch in batches for part in slices(batch, 1, 4 << 20)):
            ids, counts = e.encode(b.column(1))
            last = np.cumsum(counts)
            shas, back = [], []
            for a, z in zip(last - counts, last):
                own = ids[a:z]
                shas.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(e.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), pa.array(shas, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
