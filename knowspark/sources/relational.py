"""Relational sources: JDBC tables, SQLite files, and the objects and edges that they stand for."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.hashing import stable_id
from ..schema import view


@dataclass(frozen=True)
class TableSpec:
    """A table: its primary key, and foreign keys as column: (table, relation)."""

    name: str
    key: Sequence[str]
    foreign: Mapping[str, tuple[str, str]] = field(default_factory=dict)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table by JDBC; with a numeric column and its bounds it is read in parallel. Filters and columns are pushed down."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, pushDownPredicate="true", pushDownAggregate="true", fetchsize="10000", **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


INTROSPECT = """(SELECT c.table_name, c.column_name, c.data_type, k.constraint_type
 FROM information_schema.columns c
 LEFT JOIN (SELECT u.table_name, u.column_name, t.constraint_type FROM information_schema.key_column_usage u
            JOIN information_schema.table_constraints t ON t.constraint_name = u.constraint_name) k
   ON k.table_name = c.table_name AND k.column_name = c.column_name
 WHERE c.table_schema = '{schema}') AS x"""


def introspect(spark: SparkSession, url: str, schema: str = "public", **options: str) -> DataFrame:
    """(table_name, column_name, data_type, constraint_type) of a database schema."""
    return read_jdbc(spark, url, INTROSPECT.format(schema=schema.replace("'", "''")), **options)


def objects(df: DataFrame, spec: TableSpec, source: str) -> DataFrame:
    """A typed view of a table, ids made from the source, the table and the primary key."""
    evidence = F.array(F.struct(F.lit(source).alias("source_artifact"), F.lit(spec.name).alias("location"), F.lit(None).cast("string").alias("revision"), F.lit("import").alias("method"), F.lit(1.0).alias("confidence")))
    return view(df, spec.name, key_id(spec, source), origin=F.lit("import"), evidence=evidence)


def key_id(spec: TableSpec, source: str):
    return stable_id(F.lit(source), F.lit(spec.name), *[F.col(c) for c in spec.key])


def edges(df: DataFrame, spec: TableSpec, source: str) -> DataFrame:
    """(src, rel_type, dst) of a table's foreign keys."""
    out = None
    for column, (target, relation) in spec.foreign.items():
        one = df.where(F.col(column).isNotNull()).select(key_id(spec, source).alias("src"), F.lit(relation).alias("rel_type"), stable_id(F.lit(source), F.lit(target), F.col(column)).alias("dst"))
        out = one if out is None else out.unionAll(one)
    return out if out is not None else df.sparkSession.createDataFrame([], "src string, rel_type string, dst string")


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: Mapping[str, str]) -> None:
        self.schema, self.path, self.table, self.parts = schema, options["path"], options["table"], int(options.get("parts", 4))

    def partitions(self) -> Sequence[InputPartition]:
        import sqlite3

        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        import sqlite3

        names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            yield from c.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """Reads a table of an SQLite file that all executors can open, in ranges of row ids."""

    KINDS = {"INT": "bigint", "INTEGER": "bigint", "BIGINT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "NUMERIC": "double", "TEXT": "string", "BLOB": "binary", "BOOLEAN": "boolean"}

    @classmethod
    def name(cls) -> str:
        return "knowspark_sqlite"

    def schema(self) -> str:
        import sqlite3

        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            rows = c.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        return ", ".join(f"`{r[1]}` {self.KINDS.get(r[2].split('(')[0].upper(), 'string')}" for r in rows)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(schema, self.options)


def read_sqlite(spark: SparkSession, path: str, table: str, parts: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format(SqliteSource.name()).options(path=path, table=table, parts=parts).load()
