"""Expressions of CHECK constraints, compiled to native columns.

Grammar: OR, AND, NOT, == != < <= > >=, + - * /, IF(cond, a, b), parentheses, strings, numbers, true, false, null, names.
Integers divide with truncation; dividing by zero is an error, which the column shows as null (see :func:`check`).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r'\s*(?:(\d+\.\d+|\d+)|"((?:[^"\\]|\\.)*)"|([A-Za-z_][\w.]*)|(==|!=|<=|>=|[<>()+\-*/,]))')


class Checker:
    """Parses one expression against a frame's columns, so that text and numbers are told apart."""

    def __init__(self, source: str, df: DataFrame) -> None:
        self.df, self.tokens, at = df, [], 0
        while source[at:].strip():
            m = TOKEN.match(source, at)
            if not m:
                raise ValueError(f"unexpected {source[at:].strip()[:10]!r}")
            self.tokens.append(next((k, v) for k, v in zip(("number", "text", "name", "op"), m.groups()) if v is not None))
            at = m.end()
        self.at = 0

    def _peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def _take(self, *ops: str) -> str | None:
        kind, value = self._peek()
        if kind in ("op", "name") and value.upper() in ops:
            self.at += 1
            return value.upper()
        return None

    def _need(self, op: str) -> None:
        if not self._take(op):
            raise ValueError(f"expected {op}")

    def parse(self) -> Column:
        out = truth(*self._or())
        if self._peek()[0] != "end":
            raise ValueError(f"unexpected {self._peek()[1]!r}")
        return out

    def _or(self) -> tuple[Column, str]:
        left = self._and()
        while self._take("OR"):
            left = truth(*left) | truth(*self._and()), "bool"
        return left

    def _and(self) -> tuple[Column, str]:
        left = self._not()
        while self._take("AND"):
            left = truth(*left) & truth(*self._not()), "bool"
        return left

    def _not(self) -> tuple[Column, str]:
        if self._take("NOT"):
            return ~truth(*self._not()), "bool"
        left, kind = self._sum()
        if op := self._take("==", "!=", "<", "<=", ">", ">="):
            right, other = self._sum()
            if op in ("==", "!="):
                same = left.eqNullSafe(right) if kind == other or "null" in (kind, other) else F.lit(False)
                return (same if op == "==" else ~same), "bool"
            if {kind, other} <= {"int", "float"} or kind == other == "text":
                return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op], "bool"
            return F.lit(None).cast("boolean"), "bool"
        return left, kind

    def _sum(self) -> tuple[Column, str]:
        left, kind = self._product()
        while op := self._take("+", "-"):
            right, other = self._product()
            if op == "+" and kind == other == "text":
                left = F.concat(left, right)
            elif {kind, other} <= {"int", "float"}:
                left, kind = (left + right if op == "+" else left - right), "int" if kind == other == "int" else "float"
            else:
                raise ValueError(f"{op} of {kind} and {other}")
        return left, kind

    def _product(self) -> tuple[Column, str]:
        left, kind = self._atom()
        while op := self._take("*", "/"):
            right, other = self._atom()
            if not {kind, other} <= {"int", "float"}:
                raise ValueError(f"{op} of {kind} and {other}")
            if op == "*":
                left = left * right
            else:
                whole = kind == other == "int"
                divisor = F.when(right != 0, right)
                left = F.call_function("div", left.cast("bigint"), divisor.cast("bigint")) if whole else left.cast("double") / divisor
            kind = "int" if kind == other == "int" else "float"
        return left, kind

    def _atom(self) -> tuple[Column, str]:
        if self._take("("):
            out = self._or()
            self._need(")")
            return out
        if self._take("-"):
            value, kind = self._atom()
            return -value, kind
        kind, value = self._peek()
        self.at += 1
        if kind == "number":
            return (F.lit(float(value)), "float") if "." in value else (F.lit(int(value)), "int")
        if kind == "text":
            return F.lit(re.sub(r"\\(.)", r"\1", value)), "text"
        if kind == "name":
            low = value.lower()
            if low == "if" and self._take("("):
                cond = truth(*self._or())
                self._need(",")
                a, ka = self._or()
                self._need(",")
                b, kb = self._or()
                self._need(")")
                return F.when(cond, a).otherwise(b), ka if ka == kb else "float" if {ka, kb} <= {"int", "float"} else ka
            if low in ("true", "false"):
                return F.lit(low == "true"), "bool"
            if low == "null":
                return F.lit(None), "null"
            if value not in self.df.columns:
                return F.lit(None), "null"
            return F.col(value), kind_of(self.df.schema[value].dataType)
        raise ValueError(f"unexpected {value!r}")


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.IntegralType):
        return "int"
    return "float" if isinstance(t, T.NumericType) else "text" if isinstance(t, T.StringType) else "list"


def truth(value: Column, kind: str) -> Column:
    """Null, zero and the empty string are false."""
    if kind == "bool":
        return F.coalesce(value, F.lit(False))
    if kind == "null":
        return F.lit(False)
    if kind == "list":
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return F.coalesce(value != ("" if kind == "text" else 0), F.lit(False))


def check(df: DataFrame, source: str) -> Column:
    """Whether each row of ``df`` satisfies the expression; an error in a row counts as not satisfied."""
    return F.coalesce(Checker(source, df).parse(), F.lit(False))


# Formats of a text, in syntax that the SQL oracle's regular expressions share.
FORMATS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "url": r"^https?://[^\s/]+",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "datetime": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
}


def in_domain(df: DataFrame, name: str, rule: str, *args) -> Column:
    """Whether a column lies in a domain; a value of the wrong kind does not, a null does.

    Rules: range(low, high), pattern(regex, unanchored), length(low, high; in bytes), enum(values...), format(name).
    """
    c, kind = F.col(name), kind_of(df.schema[name].dataType)
    wants = {"range": ("int", "float"), "pattern": ("text",), "length": ("text",), "format": ("text",), "enum": ("int", "float", "text", "bool")}[rule]
    if kind not in wants:
        return c.isNull()
    if rule == "range":
        good = c.between(*args)
    elif rule == "pattern":
        good = c.rlike(args[0])
    elif rule == "length":
        good = F.octet_length(c).between(*args)
    elif rule == "enum":
        good = c.isin(list(args))
    else:
        good = c.rlike(FORMATS[args[0]])
    return F.coalesce(good, F.lit(True))
