"""Chunks of documents: greedy packing of fragments within sections, with overlap."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import blocks

MOST, OVERLAP = 4096, 200


def chunks(fragments: Sequence[tuple[str, str]], most: int = MOST, overlap: int = OVERLAP) -> list[tuple[str, str]]:
    """(section, text) chunks of fragments (section, text), counted in characters.

    A section change ends a chunk. A fragment is never cut; one longer than ``most`` is a chunk of its own. Each next
    chunk of a section starts with the last ``overlap`` characters of the one before, if that was longer than that; the
    section's name stands before its first chunk only.
    """
    out: list[tuple[str, str]] = []
    section, held, carry, first = None, "", "", True

    def flush() -> None:
        nonlocal held, carry, first
        if held:
            out.append((section or "", (f"{section}\n" if first and section else "") + carry + held))
            if len(held) > overlap:
                carry = held[-overlap:] + " " if overlap else ""
            first = False
        held = ""

    for name, text in fragments:
        if name != section:
            flush()
            section, carry, first = name, "", True
        if held and len(held) + len(text) + 1 > most:
            flush()
        held = f"{held} {text}" if held else text
    flush()
    return out


def chunk_text(text: str | None, most: int = MOST, overlap: int = OVERLAP) -> list[tuple[str, str]]:
    found = blocks(text)
    return chunks([(f"{b.page}:{' > '.join(b.path)}" if b.path or b.page > 1 else "", b.text) for b in found if b.kind != "heading"], most, overlap)


def chunk_documents(df: DataFrame, text_col: str = "text", key: str = "doc_id", most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_id, position, section, text): ids are ``{key}/chunk-{position:04}``."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, chunk_id string, position int, section string, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, f"{k}/chunk-{i:04}", i, s, c) for k, t in zip(pdf[key], pdf[text_col]) for i, (s, c) in enumerate(chunk_text(t, most, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_id", "position", "section", "text"])

    return df.select(key, text_col).mapInPandas(run, schema)


def embed_chunks(chunked: DataFrame, embed: Callable[[Column], Column] | None = None, provider: str = "trigram") -> DataFrame:
    """Chunks with the vector of their text and the name of what made it; ``embed`` is a column function, by default trigrams."""
    from ..functions.vectors import trigram_embedding

    return chunked.withColumn("embedding", (embed or trigram_embedding)(F.col("text"))).withColumn("embedding_provider", F.lit(provider))
