"""Versions, journal and edges as Parquet tables under one folder.

A write appends versions first and the journal last; versions without a journal row are not committed and not seen. One
process writes at a time. Versions are partitioned by type, so a type scan reads its own files only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import provenance
from .plans.lineage import numbered
from .schema import EDGES, JOURNAL, VERSIONS


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def journal(self) -> DataFrame:
        return self._read("journal", JOURNAL)

    def versions(self) -> DataFrame:
        """Committed versions."""
        return self._read("versions", VERSIONS).join(self.journal().select("koid", "version"), ["koid", "version"], "left_semi")

    def heads(self) -> DataFrame:
        v = self.versions()
        rows = v.groupBy("koid").agg(F.max_by(F.struct(*v.columns), "commit_ts").alias("_h"))
        return rows.select("_h.*").where("state <> 'deleted'")

    def get(self, koid: str) -> DataFrame:
        return self.heads().where(F.col("koid") == koid)

    def get_many(self, koids: DataFrame) -> DataFrame:
        """The objects of (koid); raises if one is missing."""
        out = self.heads().join(koids.select("koid").distinct(), "koid", "left_semi")
        if (n := koids.select("koid").distinct().count()) != out.count():
            raise KeyError(f"not all of {n} objects exist")
        return out

    def types(self) -> DataFrame:
        return self.heads().groupBy("type_name").agg(F.count(F.lit(1)).alias("objects"))

    def edges(self, heads: DataFrame | None = None) -> DataFrame:
        """Edges of heads, an inward reference turned round."""
        rows = (heads if heads is not None else self.heads()).select("koid", F.explode("relationships").alias("r"))
        inward = F.col("r.direction") == "in"
        out = rows.select(F.when(inward, F.col("r.target")).otherwise(F.col("koid")).alias("src"), F.col("r.rel_type").alias("rel_type"), F.when(inward, F.col("koid")).otherwise(F.col("r.target")).alias("dst"))
        return out.distinct().select(*[c.split()[0] for c in EDGES.split(", ")])

    def append(self, rows: DataFrame, kind: str, actor: str, at: int, note: str | None = None) -> None:
        """Commits new versions: the versions, then their journal rows, chained to each object's last."""
        rows = rows.persist()
        rows.write.mode("append").partitionBy("type_name").parquet(f"{self.path}/versions")
        old = self.journal()
        top = old.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s")).first().s
        last = old.groupBy("koid").agg(F.max_by("own_hash", "seq").alias("prev_hash"))
        new = numbered(rows.select("koid", "version", "origin", payload(rows).alias("payload_hash")), "seq", "koid", "version")
        new = new.withColumn("seq", F.col("seq") + top).join(last, "koid", "left").withColumn("prev_hash", F.coalesce("prev_hash", F.lit(provenance.GENESIS)))
        new = new.select("*", F.lit(kind).alias("kind"), F.lit(actor).alias("actor"), F.lit(at).cast("long").alias("ts"), F.lit(None).cast("string").alias("signature"), F.lit(note).cast("string").alias("note"))
        several = new.groupBy("koid").agg((F.count(F.lit(1)) > 1).alias("_several"))  # such a chain goes on within this append
        new = new.join(several, "koid")
        one = new.where("not _several").drop("_several").withColumn("own_hash", provenance.own_hash())
        new = one.unionByName(provenance.chain(new.where("_several").drop("_several").withColumnRenamed("prev_hash", "_start"), "_start"))
        new.select(*[c.split()[0] for c in JOURNAL.split(", ")]).write.mode("append").parquet(f"{self.path}/journal")
        rows.unpersist()

    def backup(self, path: str) -> None:
        for name, df in (("versions", self.versions()), ("journal", self.journal())):
            (df.write.partitionBy("type_name") if name == "versions" else df.write).parquet(f"{path}/{name}")

    def restore(self, path: str) -> None:
        """Takes the backup at ``path`` into this store, which must be empty, and checks that all of it arrived."""
        if not self.journal().isEmpty():
            raise ValueError("the store is not empty")
        Store(self.spark, path).backup(self.path)
        if not self.same_as(Store(self.spark, path)):
            raise RuntimeError("the restored store differs from its backup")

    def backups(self, folder: str) -> DataFrame:
        """(name, versions, last_seq) of the backups under a folder."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        names = sorted(f.getPath().getName() for f in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root) if f.isDirectory())
        rows = []
        for name in names:
            copy = Store(self.spark, f"{folder}/{name}")
            rows.append((name, *copy.journal().agg(F.count(F.lit(1)), F.max("seq")).first()))
        return self.spark.createDataFrame(rows, "name string, versions bigint, last_seq bigint")

    def same_as(self, other: Store) -> bool:
        """Whether both hold the same versions and journal, by keys and payload hashes."""
        for a, b in ((self, other), (other, self)):
            if not a.versions().select("koid", "version", payload(a.versions())).exceptAll(b.versions().select("koid", "version", payload(b.versions()))).isEmpty():
                return False
            if not a.journal().exceptAll(b.journal()).isEmpty():
                return False
        return True

    def compact(self, path: str, files: int = 1) -> Store:
        """The store rewritten with few files for each type, sorted by object and time."""
        self.versions().repartition(files, "type_name").sortWithinPartitions("type_name", "koid", "commit_ts").write.partitionBy("type_name").parquet(f"{path}/versions")
        self.journal().coalesce(files).write.parquet(f"{path}/journal")
        return Store(self.spark, path)


def payload(rows: DataFrame):
    """A hash of a version's properties, keys in order."""
    entries = F.array_sort(F.map_entries("properties"))
    return F.sha2(F.concat_ws("|", "koid", F.col("version").cast("string"), F.to_json(entries)), 256).alias("payload_hash")
