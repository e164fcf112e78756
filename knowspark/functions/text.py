"""Text expressions: tokens, similarity, names, and small detectors; all native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters and numbers, in the form that the SQL oracle's regular expressions share.
NOT_WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """The set of lower-case words; an empty array for none."""
    return F.array_distinct(token_list(text))


def token_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def query_tokens(text: str) -> list[str]:
    """What :func:`tokens` gives for a constant, as Python strings."""
    out: list[str] = []
    word = ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            if word not in out:
                out.append(word)
            word = ""
    return out


def object_text(v: DataFrame) -> Column:
    """All text of a view's row: its text columns in the order of their names, then the summary."""
    names = sorted(f.name for f in v.schema if f.name != "ko" and isinstance(f.dataType, T.StringType))
    nested = sorted(f.name for f in v.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType))
    parts = [F.col(n) for n in names] + [F.concat_ws(" ", F.col(n)) for n in nested]
    return F.concat_ws(" ", *parts, F.col("ko.summary"))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4)


def normalize_name(name: Column) -> Column:
    """Lower case, single spaces, and without a trailing ``type`` or ``_t``."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.lower(name)), r"\s+", " "), r"(?<=.)(?:type|_t)$", ""))


def statement_key(text: Column) -> Column:
    """The first three words, joined by underscores."""
    return F.concat_ws("_", F.slice(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""), 1, 3))


def snake_case(name: Column) -> Column:
    out = F.regexp_replace(name, r"(\p{Ll}|\p{N})(\p{Lu})", "$1_$2")
    return F.lower(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", ""))


def capitalized_phrases(text: Column) -> Column:
    """Runs of two or more capitalised words."""
    return F.regexp_extract_all(text, F.lit(r"\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+)+"), F.lit(0))


def dates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0))


# Markers of duty, verbs that open an order, and phrases that try to take over a reader of instructions.
DUTIES = ("must", "shall", "should", "must not", "shall not")
IMPERATIVES = (
    "run", "use", "never", "always", "ensure", "check", "avoid", "prefer", "set", "add", "install", "configure", "create", "delete", "update", "write", "read",
    "open", "close", "start", "stop", "build", "test", "deploy", "commit", "push", "pull", "merge", "rebase",
)
INJECTIONS = ("ignore previous", "ignore all", "disregard", "you are now", "new instructions", "system prompt", "override", "bypass")


def is_instruction(text: Column) -> Column:
    """Whether a duty opens the text or follows a space in it, or an imperative opens it."""
    low = F.regexp_replace(F.lower(text), r"^\s+", "")
    return reduce(lambda a, b: a | b, [low.startswith(w) for w in DUTIES + IMPERATIVES] + [low.contains(f" {w}") for w in DUTIES])


def is_injection(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(p) for p in INJECTIONS])


#: What may not be stored: name and pattern, in syntax that the SQL oracle shares.
SECRETS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("ipv4", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("card", r"\b(?:[0-9][ -]?){15}[0-9]\b"),
    ("assignment", r"(?:token|password|secret|api_?key)\s*[=:]\s*\"?[A-Za-z0-9_/+.-]{12,}"),
    ("key", r"\b(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b"),
    ("phone", r"\+[0-9]{1,3}[ -]?[0-9]{2,4}[ -]?[0-9]{3,4}[ -]?[0-9]{3,4}\b"),
)


def secret_counts(text: Column) -> list[Column]:
    return [F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(n) for n, p in SECRETS]


def redact(text: Column) -> Column:
    for name, pattern in SECRETS:
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return text


def space_words(text: Column) -> Column:
    """The runs of characters other than white space, in order."""
    return F.array_remove(F.split(text, r"\s+"), "")


def space_jaccard(a: Column, b: Column, empty: float) -> Column:
    """Of the sets of two texts' space-separated words; ``empty`` where both have none."""
    x, y = F.array_distinct(space_words(a)), F.array_distinct(space_words(b))
    both = F.size(F.array_intersect(x, y))
    total = F.size(x) + F.size(y) - both
    return F.when(total == 0, empty).otherwise(both / total)


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.95 but for case, containment by length; of names of several words 0.7 of the share of common
    ones; 0.5 where one name is a single word of the other; else 0."""
    x, y = F.lower(a), F.lower(b)
    short, long_ = F.least(F.octet_length(x), F.octet_length(y)), F.greatest(F.octet_length(x), F.octet_length(y))
    u, v = space_words(x), space_words(y)
    shared = F.size(F.filter(u, lambda w: F.array_contains(v, w)))
    several = (F.size(u) >= 2) & (F.size(v) >= 2)
    return (
        F.when(a == b, 1.0).when(x == y, 0.95).when(x.contains(y) | y.contains(x), 0.8 * short / long_ + 0.1)
        .when(several & (shared > 0), 0.7 * shared / (F.size(u) + F.size(v) - shared)).when(~several & (shared > 0), 0.5).otherwise(0.0)
    )


def iso_millis(text: Column) -> Column:
    """A strict UTC date or instant without fraction or zone, 1970 to 9999, as epoch milliseconds; else null."""
    good = text.rlike(r"^(19[7-9]\d|[2-9]\d{3})-\d{1,2}-\d{1,2}(T\d{1,2}:\d{1,2}:\d{1,2})?$")
    stamp = F.try_to_timestamp(F.when(good, F.replace(text, F.lit("T"), F.lit(" "))))
    return F.unix_millis(stamp)
