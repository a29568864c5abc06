"""State that one chunk of a log leaves to the next, so that no chunk reads history again.

A state is a folder of Parquet tables: `end`, the last place of the stream that it
covers, and tables of entries or of sums, one for each kind of feature.  It is written by one
run and never changed, so any run can be repeated from the state before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def carry_on(spark: SparkSession, rows: DataFrame, state: str | None, next_state: str | None) -> None:
    """Checks that a chunk of (ts, seq) begins after the state's end, and writes where the next state ends."""
    place = F.struct("ts", "seq")
    span = rows.agg(F.min(place).alias("first"), F.max(place).alias("last"))
    if state:
        old = spark.read.parquet(f"{state}/end").withColumnRenamed("last", "old")
        span = span.crossJoin(F.broadcast(old)).select("first", F.greatest("last", "old").alias("last"), "old")
        told = span.where("first <= old").first()
        if told:
            raise ValueError(f"the chunk begins at {tuple(told['first'])}, but the state ends at {tuple(told['old'])}")
    if next_state:
        span.select("last").write.mode("overwrite").parquet(f"{next_state}/end")


def last_window(entries: DataFrame, window: int, inclusive: bool, end: DataFrame) -> DataFrame:
    """The entries that a row after `end` may still see, added up where key and place are equal."""
    sums = [c for c in entries.columns if c[0] in "nk" and c[1:].isdigit()]
    bound = F.col("last.ts") - window
    late = entries.crossJoin(F.broadcast(end)).where(F.col("ts") >= bound if inclusive else F.col("ts") > bound)
    return late.groupBy(*[c for c in entries.columns if c not in sums]).agg(*[F.sum(c).alias(c) for c in sums])


def merged_sums(entries: DataFrame, past: DataFrame | None, keys: list[str], values: list[str]) -> DataFrame:
    """Sums of all entries so far by key."""
    every = entries.select(*keys, *values)
    every = every if past is None else every.unionByName(past)
    return every.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def with_past(rows: DataFrame, past: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """rows with the sums of the state added to their own."""
    before = past.withColumnsRenamed({v: f"_past_{v}" for v in values})
    joined = rows.join(before, keys, "left")
    return joined.select(*[c for c in rows.columns if c not in values], *[(F.col(v) + F.coalesce(f"_past_{v}", F.lit(0))).alias(v) for v in values])
