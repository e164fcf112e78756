"""Graph and document stores over HTTP or export files: labels become types, relationships become edges."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.hashing import stable_id

STATEMENTS = {
    "nodes": "MATCH (n) WHERE id(n) % {parts} = {part} RETURN toString(id(n)), labels(n)[0], apoc.convert.toJson(properties(n))",
    "edges": "MATCH (a)-[r]->(b) WHERE id(a) % {parts} = {part} RETURN toString(id(a)), type(r), toString(id(b))",
}
SCHEMAS = {"nodes": "id string, label string, properties string", "edges": "src string, rel_type string, dst string"}


class _Part(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class _GraphReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.options, self.parts = dict(options), int(options.get("parts", 8))

    def partitions(self) -> Sequence[InputPartition]:
        return [_Part(i) for i in range(self.parts)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        import base64
        import json
        import urllib.request

        query = STATEMENTS[self.options["what"]].format(parts=self.parts, part=partition.number)
        body = json.dumps({"statements": [{"statement": query}]}).encode()
        headers = {"Content-Type": "application/json"}
        if "user" in self.options:
            token = base64.b64encode(f"{self.options['user']}:{self.options.get('password', '')}".encode()).decode()
            headers["Authorization"] = f"Basic {token}"
        with urllib.request.urlopen(urllib.request.Request(self.options["url"], body, headers), timeout=300) as r:
            answer = json.load(r)
        if answer.get("errors"):
            raise RuntimeError(answer["errors"][0].get("message", "the graph store failed"))
        for row in answer["results"][0]["data"]:
            yield tuple(row["row"])


class GraphSource(DataSource):
    """Nodes or edges of a property graph through its HTTP transaction endpoint, in parts by node id."""

    @classmethod
    def name(cls) -> str:
        return "knowspark_graph"

    def schema(self) -> str:
        return SCHEMAS[self.options["what"]]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _GraphReader(self.options)


def read_graph(spark: SparkSession, url: str, what: str, **options: str) -> DataFrame:
    """``nodes`` or ``edges``; ids and ends are the store's own (see :func:`graph_ids`)."""
    spark.dataSource.register(GraphSource)
    return spark.read.format(GraphSource.name()).options(url=url, what=what, **options).load()


def graph_ids(df: DataFrame, source: str, *columns: str) -> DataFrame:
    """The columns' store ids turned into object ids."""
    return df.withColumns({c: stable_id(F.lit(source), F.col(c)) for c in columns})


def read_documents_store(spark: SparkSession, url: str, database: str, collection: str) -> DataFrame:
    """A MongoDB collection through its Spark connector, which must be on the class path."""
    return spark.read.format("mongodb").options(**{"connection.uri": url, "database": database, "collection": collection}).load()


def read_export(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Line-by-line JSON exports of a document store; extended-JSON ids and numbers come as structs."""
    reader = spark.read
    return (reader.schema(schema) if schema else reader.option("samplingRatio", 0.1)).json(path)
