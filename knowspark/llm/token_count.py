"""Token counts by compiled finite-state transducers.

Two deterministic transducers do the work, for BPE tokenizers with word ends (lower case, white space dropped).

The first reads characters and annotates each transition with the words that start there. A text is cut into chunks of
``CHUNK`` characters; for every chunk the map from each entry state to its exit state is found, all chunks at once, and
the maps are composed by a parallel prefix scan. With the entry states so known a chunk's transitions emit their words,
and a word's transition emits its number of tokens, by the second transducer: that completes a chunk's map to (exit state,
tokens emitted). Emitted tokens compose by addition, in a second scan, from which each text's count is read off.

The second reads the bytes of one word and annotates each transition with the change in the number of tokens. Its state
is what the merges have made of the bytes so far: the last token of each prefix. Reading a byte, the new last token is
the one token ending there that its left neighbour accepts (merging both together gives just those two). States are
compiled when first met; when there are ``STATES`` of them, they are dropped and compiled anew as they are met.

The transducers are those of one pre-tokenising pattern; a file with any other pattern is refused. Texts are normalised
as the tokenizer library does it: by its own normaliser, where a text has a character that Python's Unicode tables treat
differently or do not know.

Defined results: null and empty texts have no bytes and no tokens; ids may be null or repeated; an empty table gives an
empty result; special strings inside a text are one token each; very long texts are worked off in pieces cut at spaces.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, NUMBER, SPACE, classes, code_points, unique_pieces
from .common import slices

CHUNK = 256
PIECE = 1 << 20
STATES, REMEMBERED = 250_000, 400_000
LIMIT = 2048

# Classes of characters: white space, other, number, letter, apostrophe, one of s t m d, then r v l e.
_S, _O, _N, _L, _Q, _A, _R, _V, _LL, _E = range(10)
# States: nothing open, in letters, in others, apostrophe read, and that with r, v or l after it.
FREE, WORD, OTHERS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
HERE, BEFORE = 1, 2  # a word starts at this character; at the one before it


#: The patterns of the tokenizer file that the transducers are made for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BLANKS = (r"\s+", " ")


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Tables of next state and annotation by class and state, for
    's | 't | 're | 've | 'm | 'll | 'd | letters | number | others; the first that fits wins."""
    to, out = np.zeros((10, 7), np.uint8), np.zeros((10, 7), np.uint8)
    letters = (_L, _A, _R, _V, _LL, _E)
    for state in range(7):
        pending = BEFORE if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 0
        to[_S, state], out[_S, state] = FREE, pending
        to[_N, state], out[_N, state] = FREE, pending | HERE
        inside = state in (OTHERS, QUOTE)
        to[_O, state], out[_O, state] = OTHERS, 0 if inside else pending | HERE
        to[_Q, state], out[_Q, state] = (OTHERS, 0) if inside else (QUOTE, pending | HERE)
        for c in letters:
            to[c, state] = WORD
            out[c, state] = pending if pending else 0 if state == WORD else HERE
    to[_A, QUOTE], out[_A, QUOTE] = FREE, 0
    for c, state in ((_R, QUOTE_R), (_V, QUOTE_V), (_LL, QUOTE_L)):
        to[c, QUOTE], out[c, QUOTE] = state, 0
    for c, state in ((_E, QUOTE_R), (_E, QUOTE_V), (_LL, QUOTE_L)):
        to[c, state], out[c, state] = FREE, 0
    return to, out


TO, OUT = _compile()


@lru_cache(1)
def _kinds() -> np.ndarray:
    base = classes()
    out = np.full(len(base), _O, np.uint8)
    out[base == LETTER], out[base == NUMBER], out[base == SPACE] = _L, _N, _S
    for chars, c in (("'", _Q), ("stmd", _A), ("r", _R), ("v", _V), ("l", _LL), ("e", _E)):
        for x in chars:
            out[ord(x)] = c
    return out


def annotations(cp: np.ndarray) -> np.ndarray:
    """Whether a word starts at each code point, by chunk maps and their prefix scan."""
    n = len(cp)
    kinds = np.full(-(-n // CHUNK) * CHUNK, _S, np.uint8)
    kinds[:n] = _kinds()[cp]
    columns = np.ascontiguousarray(kinds.reshape(-1, CHUNK).T)
    flat = TO.ravel()
    maps = np.tile(np.arange(7, dtype=np.uint8), (columns.shape[1], 1))
    for c in columns:
        maps = flat[(c.astype(np.int16) * 7)[:, None] + maps]
    step = 1
    while step < len(maps):  # after each round a row holds the map of twice as many chunks up to it
        later = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), 1)
        maps = np.concatenate([maps[:step], later])
        step *= 2
    state = np.r_[np.uint8(FREE), maps[:-1, FREE]].astype(np.uint8)
    marks = np.empty_like(columns)
    said = OUT.ravel()
    for j, c in enumerate(columns):
        at = c.astype(np.int16) * 7 + state
        marks[j] = said[at]
        state = flat[at]
    marks = marks.T.ravel()
    starts = (marks & HERE).astype(bool)
    starts[:-1] |= (marks[1:] & BEFORE).astype(bool)
    if len(marks) and int(state[-1]) >= QUOTE_R:
        starts[-1] = True
    return starts[:n]


def _byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, then 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    own = set(plain)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class CountTransducer:
    """From a word's bytes to its number of tokens."""

    END = "</w>"

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int]) -> None:
        self.chars = _byte_chars()
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.vocab = vocab
        self.longest = max(len(t.removesuffix(self.END)) for t in vocab)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[bytes, int] = {}
        self.next: dict[tuple[int, str], int] = {}
        self.states: list[tuple[str, int]] = [("", 0)]  # last token and count of a prefix

    def merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        body = token.removesuffix(self.END)
        out = list(body)
        if len(body) < len(token):
            out[-1] += self.END
        return out

    def accept(self, left: str, right: str) -> bool:
        out = self.pairs.get((left, right))
        if out is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            parts = (self._symbols(left) if left else []) + self._symbols(right)
            out = self.pairs[left, right] = self.merged(parts) == ([left, right] if left else [right])
        return out

    def _read(self, word: str, n: int, prefixes: list[tuple[str, int]], end: bool) -> tuple[str, int]:
        """The last token and count of the first n characters, given those of the shorter prefixes, the longest last."""
        for size in range(min(n, self.longest), 0, -1):
            token = word[n - size : n] + (self.END if end else "")
            if token in self.vocab:
                left, count = prefixes[-size]
                if self.accept(left, token):
                    return token, count + 1
        raise ValueError(f"the vocabulary does not cover {word!r}")

    def count(self, raw: bytes) -> int:
        if (out := self.known.get(raw)) is not None:
            return out
        word = "".join([self.chars[b] for b in raw])
        n, at, i = len(word), 0, 0
        prefixes = [self.states[0]]
        while i < n - 1:  # the last byte is read as the word's end
            to = self.next.get((at, word[i]))
            if to is None:
                break
            at, i = to, i + 1
            prefixes.append(self.states[at])
        compiling = i < n - 1
        if compiling and len(self.states) > STATES:  # start anew; this word's states are not linked to the first
            del self.states[1:]
            self.next.clear()
            compiling = False
        while i < n - 1:
            i += 1
            prefixes.append(self._read(word, i, prefixes, False))
            if compiling:
                self.states.append(prefixes[-1])
                self.next[at, word[i - 1]] = at = len(self.states) - 1
            if len(prefixes) > 4 * self.longest + 1000:  # no token reaches further back
                del prefixes[: -self.longest - 1]
        out = self._read(word, n, prefixes, True)[1]
        if n <= 64:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[raw] = out
        return out


@lru_cache(1)
def unlike() -> np.ndarray:
    """Of each code point, whether Python normalises it unlike the tokenizer library, or does not know it."""
    from tokenizers import normalizers

    lower = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    out = np.zeros(0x110000, bool)
    for a in range(0x80, 0x110000, 4096):
        chars = [chr(c) for c in range(a, min(a + 4096, 0x110000)) if not 0xD800 <= c < 0xE000]
        for c, own in zip(chars, lower.normalize_str("|".join(chars)).split("|")):
            out[ord(c)] = own != unicodedata.normalize("NFC", c).replace("Σ", "σ").lower() or unicodedata.category(c) == "Cn"
    return out


def emitted_before(places: np.ndarray, tokens: np.ndarray, n: int, edges: np.ndarray) -> np.ndarray:
    """Tokens emitted before each edge, given those that transitions at some places of n emit: by chunks and their scan."""
    said = np.zeros(-(-n // CHUNK) * CHUNK + CHUNK, np.int32)
    said[places] = tokens
    within = np.cumsum(said.reshape(-1, CHUNK), axis=1)
    before = np.r_[0, np.cumsum(within[:, -1], dtype=np.int64)]  # the scan of all chunks' emissions
    chunk, at = np.divmod(edges, CHUNK)
    return before[chunk] + np.where(at > 0, within[chunk, at - 1], 0)


class Counter:
    """Counts for a tokenizers .json of this kind; it refuses one that asks for anything else."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, normal, pre = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        kinds = [x["type"] for x in normal["normalizers"]], [x["type"] for x in pre["pretokenizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != CountTransducer.END or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError("not a lower-case BPE with word ends")
        blanks, split = normal["normalizers"][1], pre["pretokenizers"][0]
        if (blanks["pattern"], blanks["content"]) != ({"Regex": BLANKS[0]}, BLANKS[1]) or split["pattern"] != {"Regex": SPLIT} or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("no transducer for these patterns")
        self.library = Tokenizer.from_file(path).normalizer
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.words = CountTransducer(merges, model["vocab"])
        names = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(names, key=len, reverse=True)))) if names else None

    def normal(self, text: str) -> tuple[str, int]:
        """The text as the transducer reads it, and the number of special strings taken out of it."""
        found = 0
        if self.special and "<|" in text:
            text, found = self.special.subn("\n", text)
        if not text.isascii():
            if unlike()[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
                return self.library.normalize_str(text), found
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter, without a final sigma
        return text.lower(), found

    def _pieces(self, texts: list[str | None], counts: np.ndarray) -> Iterator[tuple[str, list[int], list[int]]]:
        """Joins normalised texts with newlines up to about PIECE characters: text, and first character and row of each part."""
        parts, starts, rows, size = [], [], [], 0
        for row, text in enumerate(texts):
            if not text:
                continue
            text, found = self.normal(text)
            counts[row] += found
            at = 0
            while at < len(text):
                to = len(text)
                if to - at > PIECE:
                    m = re.compile(r"\s").search(text, at + PIECE)
                    to = m.start() if m else to
                parts.append(text[at:to])
                starts.append(size)
                rows.append(row)
                size += to - at + 1
                at = to
                if size >= PIECE:
                    yield "\n".join(parts), starts, rows
                    parts, starts, rows, size = [], [], [], 0
        if parts:
            yield "\n".join(parts), starts, rows

    def count(self, texts: list[str | None]) -> np.ndarray:
        counts = np.zeros(len(texts), np.int64)
        for text, first, rows in self._pieces(texts, counts):
            raw = text.encode("utf-8")
            cp, at = code_points(raw)
            starts = annotations(cp)
            space = _kinds()[cp] == _S
            gap = space.copy()
            gap[1:] &= ~space[:-1]
            bounds = np.flatnonzero(starts | gap)
            if not len(bounds):
                continue
            head = int(at[bounds[0]])
            number, distinct = unique_pieces(raw[head:], at[bounds] - head)
            # a piece that starts with white space is a gap
            own = self.words
            tokens = np.fromiter((0 if p[:1].isspace() or not p else own.count(p) for p in distinct), np.int64, len(distinct))
            each = tokens[number]
            each[space[bounds]] = 0
            total = emitted_before(bounds, each, len(cp), np.r_[first, len(cp)])
            np.add.at(counts, rows, np.diff(total))
        return counts


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, path: str, limit: int = LIMIT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each text; ``path`` is a tokenizer file that every executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            for part in slices(b, 1, 4 << 20):
                counts = pa.array(c.count(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.compute.binary_length(part.column(1).fill_null("")).cast(pa.int64()), counts], ["doc_id", "n_bytes", "n_tokens"])

    own = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
