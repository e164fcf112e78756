"""The journal as a stream: subscriptions, index maintenance, triggers, and rules on new versions.

A checkpoint folder is a subscription's durable position; deleting it unsubscribes, running the batch form after a
sequence number replays. Work per micro-batch is written under the batch's number, so a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..schema import JOURNAL


def stream(spark: SparkSession, path: str, most_files: int = 1000) -> DataFrame:
    """New journal rows, as files arrive."""
    return spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", most_files).parquet(path)


def subscribe(spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame, int], None], koids: Sequence[str] = (), kinds: Sequence[str] = (), once: bool = True) -> StreamingQuery:
    """Calls ``handle`` with each batch of events of the given objects or kinds; the position moves when it returns."""
    events = stream(spark, path)
    if koids:
        events = events.where(F.col("koid").isin(list(koids)))
    if kinds:
        events = events.where(F.col("kind").isin(list(kinds)))
    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def maintain_index(spark: SparkSession, journal: str, heads: Callable[[], DataFrame], text: Column, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps an inverted index at ``out``: each batch writes the tokens of the objects it touched, under its number.

    Readers take, for each object, what the latest batch that touched it wrote (:func:`index`). An object that is gone
    has one row without a token, so it drops out.
    """

    def handle(batch: DataFrame, number: int) -> None:
        touched = batch.groupBy("koid").agg(F.max("seq").alias("seq"))
        rows = touched.join(heads().select(F.col("koid"), F.explode_outer(tx.tokens(text)).alias("token")), "koid", "left")
        rows.select("koid", "seq", "token").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return subscribe(spark, journal, checkpoint, handle, once=once)


def index(spark: SparkSession, out: str) -> DataFrame:
    """(koid, token) as of the last batch."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("koid").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["koid", "batch"], "left_semi").where("token is not null").select("koid", "token")


def lag(journal: DataFrame, indexed: DataFrame) -> DataFrame:
    """(events): how many events the index is behind."""
    a = journal.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"))
    b = indexed.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("water"))
    return a.join(F.broadcast(b)).select((F.col("head") - F.col("water")).alias("events"))  # one row each


def triggers(spark: SparkSession, path: str, checkpoint: str, programs: Mapping[str, Callable[[DataFrame], DataFrame]], out: str, once: bool = True) -> StreamingQuery:
    """Runs the program of each event kind over the batch's events of that kind; each batch writes once."""

    def handle(batch: DataFrame, number: int) -> None:
        for kind, program in programs.items():
            events = batch.where(F.col("kind") == kind)
            if not events.isEmpty():
                program(events).write.mode("overwrite").parquet(f"{out}/kind={kind}/batch={number}")

    return subscribe(spark, path, checkpoint, handle, kinds=tuple(programs), once=once)


def replay(journal: DataFrame, after: int, koids: DataFrame | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The batch form of a subscription."""
    from ..operators.provenance import after as later

    return later(journal, after, koids, kinds).orderBy("seq")
