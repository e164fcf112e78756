"""The query language: text and JSON fronts that give one statement tree."""

from .jsonfront import parse_json
from .parser import parse
from .tree import QueryError

__all__ = ["QueryError", "parse", "parse_json"]
