"""Summaries of conversations: sentences sorted into buckets by cue words, verbatim; native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cue words of each bucket; a sentence may be in several, and is a fact where it is in none.
CUES = {
    "decisions": ("decided", "decide", "decision", "agreed", "agree", "we will", "we'll", "plan to", "chose", "choose"),
    "actions": ("todo", "action item", "next step", "will do", "assigned"),
    "open_issues": ("open:", "unresolved", "question:"),
    "constraints": ("must", "never", "always", "cannot", "can't", "should not", "required"),
    "outcomes": ("done", "finished", "completed", "resolved", "shipped", "passed", "result"),
}


def sentences(text: Column) -> Column:
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])", "$1\x01"), "\x01")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def buckets(sentence: Column) -> Column:
    low = F.lower(sentence)
    found = []
    for name, cues in CUES.items():
        hit = F.lit(False)
        for cue in cues:
            hit = hit | low.contains(cue)
        if name == "open_issues":
            hit = hit | sentence.endswith("?")
        found.append(F.when(hit, name))
    out = F.filter(F.array(*found), lambda x: x.isNotNull())
    return F.when(F.size(out) == 0, F.array(F.lit("facts"))).otherwise(out)


def bucketed(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, position, bucket, sentence) of turns (conv_id, turn, text)."""
    rows = turns.select("conv_id", "turn", F.posexplode(sentences(F.col("text"))).alias("position", "sentence"))
    return rows.select("conv_id", "turn", "position", F.explode(buckets(F.col("sentence"))).alias("bucket"), "sentence")


def bucket_counts(turns: DataFrame) -> DataFrame:
    return bucketed(turns).groupBy("conv_id", "bucket").agg(F.count(F.lit(1)).alias("sentences"))


def entities(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, entity): runs of capitalised words of letters that do not open a sentence."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.transform(F.split(text, r"(?<=[.!?])"), lambda s: F.concat_ws(" ", F.transform(F.filter(F.split(F.regexp_replace(s, r"[.!?]+$", ""), r"\s+"), lambda w: w != ""), _capital)))
    runs = F.regexp_extract_all(F.concat_ws(" | ", marked), F.lit(r"\+\S+(?: \+\S+)*"), F.lit(0))
    return turns.select("conv_id", "turn", F.explode(F.transform(runs, lambda r: F.replace(r, F.lit("+"), F.lit("")))).alias("entity"))


def _capital(word: Column, place: Column) -> Column:
    """A capitalised word marked by a plus sign, any other as a dash."""
    return F.when((place > 0) & word.rlike(r"^\p{Lu}\p{L}+$"), F.concat(F.lit("+"), word)).otherwise("-")
