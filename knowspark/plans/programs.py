"""Stored programs, workflows, reports and agents made of them, views, and results as JSON chunks."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import lru_cache
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang import tree as t
from ..lang.parser import parse
from .engine import Engine

PARAMETER = re.compile(r"\{\{\s*(\w+)\s*\}\}")


@lru_cache(256)
def parsed(source: str) -> t.Statement:
    """Statements are immutable, so a text is parsed once."""
    return parse(source)


@dataclass(frozen=True)
class Program:
    """A statement with ``{{name}}`` parameters, which stand where a value may: a string, number, true, false or null."""

    name: str
    source: str

    def statement(self, values: Mapping[str, object]) -> t.Statement:
        """The statement with values put into the parsed tree, so that no value is ever read as language."""
        names = PARAMETER.findall(self.source)
        if missing := sorted(set(names) - set(values)):
            raise KeyError(f"{self.name} needs {', '.join(missing)}")
        marks = {n: f"\x00{n}\x00" for n in names}
        return _put(parsed(PARAMETER.sub(lambda m: json.dumps(marks[m[1]], ensure_ascii=False).replace("\\u0000", "\x00"), self.source)), {m: values[n] for n, m in marks.items()})


def _put(x: object, values: Mapping[str, object]) -> object:
    if isinstance(x, str):
        return values.get(x, x)
    if isinstance(x, tuple):
        return tuple(_put(i, values) for i in x)
    if hasattr(x, "__dataclass_fields__"):
        return replace(x, **{n: _put(getattr(x, n), values) for n in x.__dataclass_fields__})
    return x


@dataclass
class Stats:
    """What a runner has done; rows are counted where a result is handed out in chunks."""

    programs: int = 0
    rows: int = 0
    millis: int = 0
    hits: int = 0
    misses: int = 0


@dataclass
class Runner:
    """Runs programs; an execution id runs once, and later calls get what it gave."""

    engine: Engine
    done: dict[str, DataFrame] = field(default_factory=dict)
    stats: Stats = field(default_factory=Stats)

    def run(self, program: Program, values: Mapping[str, object], execution: str | None = None) -> DataFrame:
        start = time.monotonic()
        self.stats.programs += 1
        if execution is not None and execution in self.done:
            self.stats.hits += 1
            return self.done[execution]
        self.stats.misses += 1
        out = self.engine.run(program.statement(values))
        if execution is not None:
            self.done[execution] = out = out.persist()
        self.stats.millis += int(1000 * (time.monotonic() - start))
        return out

    def chunks(self, program: Program, values: Mapping[str, object], size: int = 100) -> Iterator[list[str]]:
        """The result as JSON, a chunk at a time."""
        for chunk in json_chunks(self.run(program, values), size):
            self.stats.rows += len(chunk)
            yield chunk


@dataclass(frozen=True)
class Workflow:
    """Programs as the steps of a graph without cycles: each names the steps that it comes after."""

    name: str
    steps: Mapping[str, tuple[Program, Sequence[str]]]

    def order(self) -> list[str]:
        if missing := sorted({n for _, after in self.steps.values() for n in after} - set(self.steps)):
            raise KeyError(f"{self.name} has no step {', '.join(missing)}")
        try:
            return list(TopologicalSorter({n: after for n, (_, after) in self.steps.items()}).static_order())
        except CycleError as e:
            raise ValueError(f"{self.name} goes in a circle") from e

    def run(self, runner: Runner, values: Mapping[str, object], execution: str | None = None) -> dict[str, DataFrame]:
        """Each step's result, by name, in an order that the graph allows; with an execution id each step runs once."""
        return {n: runner.run(self.steps[n][0], values, f"{execution}/{n}" if execution else None) for n in self.order()}


@dataclass(frozen=True)
class Report:
    """A text with ``{{name}}`` places for the parameters and, by its name, for each section's result as a table."""

    name: str
    template: str
    sections: Mapping[str, Program]

    def render(self, runner: Runner, values: Mapping[str, object], most: int = 100) -> str:
        """Tables show the first ``most`` rows of a result and say so where there are more."""
        filled = {n: self._table(runner.run(p, values), most) for n, p in self.sections.items()} | {n: str(v) for n, v in values.items()}
        return PARAMETER.sub(lambda m: filled[m[1]], self.template)

    @staticmethod
    def _table(df: DataFrame, most: int) -> str:
        rows = df.limit(most + 1).collect()  # a page of a report
        columns = [c for c in df.columns if c != "ko"]
        lines = [" | ".join(columns), " | ".join("---" for _ in columns)]
        lines += [" | ".join("" if r[c] is None else str(r[c]) for c in columns) for r in rows[:most]]
        return "\n".join(lines + (["..."] if len(rows) > most else []))


@dataclass(frozen=True)
class Agent:
    """A prompt and the programs that it may run as skills, for those whom its policies let."""

    name: str
    prompt: str
    skills: Mapping[str, Program]
    allowed: Sequence[str] = ()

    def run(self, runner: Runner, principal: str, values: Mapping[str, object]) -> dict[str, DataFrame]:
        if self.allowed and principal not in self.allowed:
            raise PermissionError(f"{principal} may not run {self.name}")
        return {n: runner.run(p, values) for n, p in self.skills.items()}


def create_view(engine: Engine, spark: SparkSession, name: str, query: str) -> None:
    """A named query: readers of the view run it anew."""
    engine.run(parsed(query)).createOrReplaceTempView(name)


def json_chunks(df: DataFrame, size: int = 100) -> Iterator[list[str]]:
    """The rows as JSON texts, ``size`` at a time, partition by partition, never all at once."""
    held: list[str] = []
    for row in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator(prefetchPartitions=True):
        held.append(row.j)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
