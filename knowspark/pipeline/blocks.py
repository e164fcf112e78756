"""Documents as blocks: headings, paragraphs, lists, tables, code, figures; and where one topic ends."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
NUMBERED = re.compile(r"^\d+(?:\.\d+)*\.?\s+\S.{0,80}$")
ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
TABLE = re.compile(r"^\s*\|.*\|\s*$|\S+(?:\t|\s{3,})\S+(?:\t|\s{3,})\S+")
FIGURE = re.compile(r"^\s*(?:!\[[^\]]*\]\([^)]*\)|(?:Figure|Fig\.|Abbildung)\s+\d+)", re.I)


@dataclass(frozen=True)
class Block:
    kind: str
    text: str
    level: int
    path: tuple[str, ...]
    page: int


def blocks(text: str | None) -> list[Block]:
    """Blocks in order; a form feed starts a page, an empty line ends a paragraph, a fence holds code."""
    out: list[Block] = []
    held: list[str] = []
    kind, path, page = "", [], 1

    def flush() -> None:
        nonlocal held, kind
        if held:
            out.append(Block(kind, "\n".join(held) if kind in ("table", "code", "list") else " ".join(held), 0, tuple(p for p in path if p), page))
        held, kind = [], ""

    for raw in (text or "").split("\n"):
        while "\f" in raw:
            before, raw = raw.split("\f", 1)
            if before.strip():
                held.append(before.strip())
                kind = kind or "paragraph"
            flush()
            page += 1
        line = raw.strip()
        if line.startswith("```"):
            was = kind
            flush()
            kind = "" if was == "code" else "code"
            continue
        if kind == "code":
            held.append(raw)
            continue
        if not line:
            flush()
            continue
        m = HEADING.match(line)
        if m or NUMBERED.match(line) and len(line) < 60 and line[-1] not in ".!?," and not ITEM.match(raw):
            flush()
            level = len(m[1]) if m else line.split()[0].rstrip(".").count(".") + 1
            title = m[2].strip() if m else line
            del path[level - 1 :]
            path += [""] * (level - 1 - len(path)) + [title]
            out.append(Block("heading", title, level, tuple(p for p in path[:-1] if p), page))
            continue
        now = "figure" if FIGURE.match(line) else "list" if ITEM.match(raw) else "table" if TABLE.search(line) else "paragraph"
        if now != kind:
            flush()
            kind = now
        held.append(line)
    flush()
    return out


def explode_blocks(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """A row for each block of each document."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, position int, kind string, text string, level int, headings array<string>, page int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, b.kind, b.text, b.level, list(b.path), b.page) for k, t in zip(pdf[key], pdf[text_col]) for i, b in enumerate(blocks(t))]
            yield pd.DataFrame(rows, columns=[key, "position", "kind", "text", "level", "headings", "page"])

    return df.select(key, text_col).mapInPandas(run, schema)


MERGE, SPLIT = 0.55, 0.10


def boundaries(texts: list[str], kinds: list[str] | None = None) -> list[bool]:
    """For each block whether a topic starts there: at headings, and where trigram vectors of neighbours part."""
    from ..functions.vectors import trigram_vector

    vectors = [trigram_vector(t) for t in texts]
    out = []
    for i, v in enumerate(vectors):
        if i == 0 or kinds and kinds[i] == "heading":
            out.append(True)
            continue
        if kinds and kinds[i - 1] == "heading":
            out.append(False)
            continue
        near = sum(a * b for a, b in zip(v, vectors[i - 1]))
        out.append(near < SPLIT or near < MERGE and texts[i][:1].isupper() and len(texts[i - 1]) > 400)
    return out
