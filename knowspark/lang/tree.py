"""Statements, as frozen dataclasses, and the error that every stage of the language raises."""

from __future__ import annotations

from dataclasses import dataclass

# The error codes that tools rely on.
UNEXPECTED_CHAR, UNTERMINATED_STRING, INVALID_NUMBER = 1001, 1002, 1003
UNEXPECTED_TOKEN, EXPECTED_TOKEN, UNEXPECTED_END, INVALID_OPERATOR, CONFLICTING_CLAUSES, INVALID_RANGE = 1010, 1011, 1012, 1013, 1014, 1015
UNKNOWN_TYPE, UNKNOWN_PROPERTY, TYPE_MISMATCH, UNKNOWN_RELATIONSHIP = 1030, 1031, 1032, 1033


class QueryError(ValueError):
    """A query that cannot be compiled: a stable code, a message, a place and perhaps a hint."""

    def __init__(self, code: int, message: str, line: int = 0, column: int = 0, hint: str = "") -> None:
        self.code, self.line, self.column, self.hint = code, line, column, hint
        place = f" at {line}:{column}" if line else ""
        super().__init__(f"Q{code}{place}: {message}" + (f" ({hint})" if hint else ""))


@dataclass(frozen=True)
class Compare:
    name: str
    op: str
    value: object


@dataclass(frozen=True)
class Both:
    left: Compare | Both | Either
    right: Compare | Both | Either


@dataclass(frozen=True)
class Either:
    left: Compare | Both | Either
    right: Compare | Both | Either


Condition = Compare | Both | Either


@dataclass(frozen=True)
class Similar:
    """A text query; ``model`` asks for the vector side, ``bm25`` for that score instead of Jaccard."""

    text: str | None = None
    model: str | None = None
    bm25: bool = False
    vector: tuple[float, ...] | None = None
    k: int | None = None
    fuse: str = "rrf"


@dataclass(frozen=True)
class Hop:
    relation: str | None
    depth: int = 1
    start: str | None = None


@dataclass(frozen=True)
class Span:
    """``as_of``, ``between`` or ``historical``."""

    kind: str
    start: int = 0
    end: int = 0


@dataclass(frozen=True)
class Match:
    entity: str | None
    where: Condition | None = None
    similar: Similar | None = None
    hop: Hop | None = None
    span: Span | None = None
    statuses: tuple[str, ...] = ()
    source: str | None = None
    limit: int | None = None
    offset: int = 0
    fields: tuple[str, ...] | None = None
    explain: bool = False


@dataclass(frozen=True)
class Create:
    entity: str
    values: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class Update:
    entity: str
    koid: str
    values: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class Delete:
    entity: str
    koid: str


@dataclass(frozen=True)
class Ingest:
    source: str
    tables: bool = False
    entities: bool = False
    relationships: bool = False


Statement = Match | Create | Update | Delete | Ingest


def names(where: Condition | None) -> set[str]:
    if where is None:
        return set()
    return {where.name} if isinstance(where, Compare) else names(where.left) | names(where.right)
