"""Streaming twins: windowed counts with watermarks; streams from files and to files."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ROWS_A_TASK
from ..operators.common import shared_path
from .stateful import ROCKSDB


def source(spark: SparkSession, folder: str, like: DataFrame, glob: str = "*.parquet") -> DataFrame:
    """A stream of Parquet files of a folder with the schema of a table."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", glob).parquet(folder)


def arriving(rows: DataFrame, time: str, slices: int, closing: DataFrame) -> tuple[DataFrame, str]:
    """A stream of rows in `slices` batches by time, a fifth of each a batch late, and one that ends all watermarks; and how late rows are.

    A row comes no later than two slices of the whole span of time.  A slice is written by as many tasks as it has
    rows for, and a batch takes as many files; where a slice has fewer, a batch also takes files of the next, which makes no row later.
    """
    spark, folder = rows.sparkSession, shared_path(rows.sparkSession, "arriving")
    at = F.unix_micros(time)
    first, last, n = rows.agg(F.min(at), F.max(at), F.count("*")).first()
    files = max(1, -(-n // (slices * ROWS_A_TASK)))
    step = max(1, -(-((last or 0) - (first or 0) + 1) // slices))
    own = F.floor((at - F.lit(first or 0)) / step)
    batch: Column = own + (F.pmod(F.xxhash64(*rows.columns), F.lit(5)) == 0).cast("int")
    for i in range(slices + 1):
        rows.where(batch == i).coalesce(files).write.mode("append").parquet(folder)
    closing.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder), f"{2 * step} microseconds"


@contextmanager
def _state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def tumbling(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) for each stretch of time; with `late`, rows later than that are dropped."""
    seen = events.withWatermark("ts", late) if late else events
    return seen.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str, step: str, late: str | None = None) -> DataFrame:
    seen = events.withWatermark("ts", late) if late else events
    return seen.groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    seen = events.withWatermark("ts", late) if late else events
    return seen.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def drained(stream: DataFrame, name: str, mode: str = "append", told: list | None = None) -> DataFrame:
    """The rows of a stream whose input is all there, by a run that ends when it is used up.

    They go to Parquet files in the shared folder.  Aggregates run in complete mode,
    and each batch replaces what the one before wrote.  The progress of the batches is added to `told`.
    """
    spark = stream.sparkSession
    path, checkpoint = shared_path(spark, name), shared_path(spark, f"{name}-progress")
    out = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        out = out.format("parquet").option("path", path)
    else:
        out = out.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path))
    with _state_in_rocksdb(spark):
        run = out.start()
        run.awaitTermination()
    if told is not None:
        told += run.recentProgress
    return spark.read.schema(stream.schema).parquet(path)
