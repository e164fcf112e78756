"""Words of whole Arrow text columns and their hashes, by numpy over the raw UTF-8 bytes.

A word is a maximal run of characters other than ``[\\x20\\x09-\\x0D]``; those six are single bytes in UTF-8 and
part of no other character, so the bytes need no decoding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
PIECE = 1 << 20

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
#: Starts of the two families of word hashes, and the multipliers between their steps.
FAMILIES = ((np.uint64(0x243F6A8885A308D3), np.uint64(0x9E3779B97F4A7C15)), (np.uint64(0x13198A2E03707344), np.uint64(0xC2B2AE3D27D4EB4F)))
LANES = 8
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


def join(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of two neighbouring hashes, in order."""
    x = a * _C
    x += b
    x += np.uint64(seed * 0x2545F4914F6CDD1D & (1 << 64) - 1)
    return mix(x)


def _hash(lanes: np.ndarray, piece: np.ndarray, s: np.ndarray, e: np.ndarray, family: int) -> np.ndarray:
    """Hashes of words by their start and end: eight bytes a step through a bijection, so that equal lengths of up to
    eight bytes never collide and no structure within longer words does; what is beyond ``LANES`` steps by xxh3."""
    start, factor = FAMILIES[family]
    n = e - s
    h = mix((n.astype(np.uint64) * _C + start) ^ (lanes[s] & _MASKS[np.minimum(n, 8)]))
    more = np.flatnonzero(n > 8)
    for step in range(1, LANES):
        if not len(more):
            return h
        left = n[more] - 8 * step
        h[more] = mix((h[more] * factor) ^ (lanes[s[more] + 8 * step] & _MASKS[np.minimum(left, 8)]))
        more = more[left > 8]
    if len(more):
        rest = [xxhash.xxh3_64_intdigest(piece[a:z].tobytes(), family + 1) for a, z in zip((s[more] + 8 * LANES).tolist(), e[more].tolist())]
        h[more] = mix((h[more] * factor) ^ np.array(rest, np.uint64))
    return h


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def word_hashes(texts: pa.Array, families: int = 1) -> tuple[np.ndarray, ...]:
    """Hash, first and end byte of each word, in order, and the number of words of each row.

    With two ``families`` the hashes are a matrix of two rows that know nothing of each other: words that collide in one
    do not in the other, so both together tell words apart in 128 bits.
    """
    buf, offsets = text_buffer(texts)
    hashes, starts, ends = [], [], []
    at, last = int(offsets[0]), int(offsets[-1])
    while at < last:
        to = min(at + PIECE, last)
        if to < last:  # cut between two rows or at white space
            row = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[row] > at:
                to = int(offsets[row])
            else:
                while to < last and not SPACE[buf[to]] and to != offsets[row + 1]:
                    to += 1
        piece = buf[at:to]
        inside = ~SPACE[piece]
        edge = np.zeros(len(piece) + 1, bool)
        edge[0] = edge[-1] = True
        edge[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")] - at] = True
        before = np.empty(len(piece), bool)
        before[0], before[1:] = False, inside[:-1]
        s = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(piece), bool)
        after[-1], after[:-1] = False, inside[1:]
        e = np.flatnonzero(inside & (~after | edge[1:])) + 1
        padded = np.concatenate([piece, np.zeros(8, np.uint8)])
        lanes = np.ndarray((len(piece),), "<u8", padded, 0, (1,))  # the eight bytes from each place on
        hashes.append(np.stack([_hash(lanes, piece, s, e, f) for f in range(families)]))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not hashes:
        none = np.zeros(0, np.int64)
        h = np.zeros((families, 0), np.uint64)
        return h if families > 1 else h[0], none, none, np.zeros(len(offsets) - 1, np.int64)
    first = np.concatenate(starts)
    counts = np.diff(np.searchsorted(first, offsets))
    h = np.concatenate(hashes, axis=1)
    return h if families > 1 else h[0], first, np.concatenate(ends), counts


def grams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the n words from each position on, by doubling; shorter than ``h`` by n - 1, across row ends too."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size, power, out, have = 1, h, None, 0
    while True:
        if n & size:
            if out is None:
                out, have = power, size
            else:
                m = min(len(out), len(power) - have)
                out, have = join(out[:m], power[have : have + m], seed + 64 + size), have + size
        if size * 2 > n:
            return out[: len(h) - n + 1]
        power = join(power[:-size], power[size:], seed + size)
        size *= 2


def shingles(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The n-word shingles of all rows, each once: row, hash (sorted within a row), number of times, and where it first is.

    A row of 1 to n - 1 words has one shingle, all its words; a row without words has none.
    """
    ends = np.cumsum(counts)
    none = np.zeros(0, np.int64)
    rows, out, places = [none], [np.zeros(0, np.uint64)], [none]
    if len(h) >= n:
        g = grams(h, n)
        row = np.repeat(np.arange(len(counts)), counts)[: len(g)]
        good = np.flatnonzero(np.arange(len(g)) + n <= ends[row])
        rows.append(row[good])
        out.append(g[good])
        places.append(good)
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        first = ends[i] - counts[i]
        rows.append(np.array([i]))
        out.append(short_gram(h[first : ends[i]]))
        places.append(np.array([first]))
    row, g, at = np.concatenate(rows), np.concatenate(out), np.concatenate(places)
    order = np.lexsort((g, row))
    row, g, at = row[order], g[order], at[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (g[1:] != g[:-1])]) if len(g) else none
    return row[new], g[new], np.diff(np.r_[new, len(g)]), at[new]


def short_gram(h: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words than a shingle has."""
    return grams(h, len(h), 7)[:1]


def elements(row: np.ndarray, gram: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A multiset as a set: the k-th time of a shingle is an element of its own. Rows and elements, sorted."""
    if (times == 1).all():
        return row, gram
    row, out = np.repeat(row, times), np.repeat(gram, times)
    turn = np.arange(len(out)) - np.repeat(np.cumsum(times) - times, times)
    again = turn > 0
    out[again] = join(out[again], turn[again].astype(np.uint64), 11)
    order = np.lexsort((out, row))
    return row[order], out[order]
