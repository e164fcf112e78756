"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str) -> str:
    """A column name made from ``name`` that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again; for whole corpora, which it compresses."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``; only in local mode (tests, a laptop),
    where neither that setting nor a checkpoint folder exists, is a temporary one used.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame, text: str) -> int:
    """The size that the optimiser gives for ``df``; where it does not know, the bytes of ``text``, counted."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 50:
        size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return size


def dealt(df: DataFrame, size: int, *columns: str, most: int = 64 << 20) -> DataFrame:
    """``df`` dealt out by columns so that a partition has about ``most`` of ``size`` bytes.

    Where the session's number of shuffle partitions is enough, that holds, and adaptive execution may merge them.
    """
    parts = -(-size // most)
    if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(*columns)
    return df.repartition(parts, *columns)


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], by: str, salts: int = 16) -> DataFrame:
    """A left join of many rows with facts, one for each key, of which there are far fewer.

    A key that most rows have is dealt out to ``salts`` tasks by the hash of column ``by``, each with its copy of the fact.
    """
    salt = fresh(rows, "salt")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = facts.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(copies, [*keys, salt], "left").drop(salt)


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text and at most ``rows`` rows, so that working memory stays small."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(ends):
        z = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right"))
        z = min(max(z, a + 1), a + rows)
        yield batch.slice(a, z - a)
        a = min(z, len(ends))


def release() -> None:
    """Gives memory that a task no longer uses back to the system; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def scratch() -> str:
    """Where one task attempt may spill, as Spark's own shuffle does: its executor's local dirs, else the temp folder."""
    for name in ("LOCAL_DIRS", "SPARK_LOCAL_DIRS"):
        for folder in os.environ.get(name, "").split(","):
            if folder and os.path.isdir(folder) and os.access(folder, os.W_OK):
                return folder
    return tempfile.gettempdir()
