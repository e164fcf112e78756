"""Cutting the lineage of frames that loops reuse."""

from __future__ import annotations

import tempfile
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of ``spark.checkpoint.dir``; a temporary one only in local mode, where none is set."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with the rows' numbers from 1 in an order, without bringing them to one task.

    Rows are range-partitioned and sorted; only the partitions' sizes go through the driver.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", within))
    sizes = {r._part: r["count"] for r in rows.groupBy("_part").count().collect()}
    parts = sorted(sizes)
    before = dict(zip(parts, accumulate([0, *(sizes[p] for p in parts)])))
    offsets = df.sparkSession.createDataFrame([(p, before[p]) for p in parts], "_part int, _before long")
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")  # a row for each partition
