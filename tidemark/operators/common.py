"""Helpers that several operators share."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..config import BROADCAST_ROWS, ROWS_A_TASK


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, else as it is (a shuffled join).

    What isn't stored yet is written to the shared folder, and its rows are counted while
    they are written, so what stands behind df runs once.
    """
    side = df if hasattr(df, "observed_rows") else shared_table(df, "side")
    return F.broadcast(side) if side.observed_rows <= most else side


def spread(rows: DataFrame, like: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys over so many tasks that each gets about ROWS_A_TASK of the rows of a stored table `like`; a small table as it is.

    A number that grows with the rows bounds what one task holds, and sides dealt alike are joined without another shuffle.
    """
    parts = -(-like.count() // ROWS_A_TASK)
    return rows.repartition(parts, *keys) if parts > 2 else rows


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir; beside the warehouse only where that is unset)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/tidemark/{label}-{uuid.uuid4().hex}"


def observed_write(df: DataFrame, write: Callable[[DataFrame], None], **metrics: Column) -> dict[str, Any]:
    """What `metrics` come to over the rows of df while write() writes them: no second pass."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("_rows"), *[c.alias(name) for name, c in metrics.items()]))
    return seen.get


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage; `observed_rows` tells how many rows were written."""
    path = shared_path(df.sparkSession, label)
    told = observed_write(df, lambda rows: rows.write.parquet(path))
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.observed_rows = told["_rows"]
    return back


def cumulative(counts: DataFrame, order: list[str], n: str, by: list[str] | None = None, out: str = "before") -> DataFrame:
    """counts with the sum of n over the rows before each, in an order within groups.

    Rows are dealt into ranges of (by, order); the sums of whole ranges before a
    range, of which there are as many as partitions, are added to those within it,
    so no task orders all values.
    """
    by = by or []
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shared_table(counts.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*by, "_part").agg(F.sum(n).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.select(F.struct(*[F.col(b) for b in [*by, "_part"]]).alias("_range_of"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_range"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_in", F.coalesce(F.sum(n).over(inside), F.lit(0))).withColumn("_key", F.struct(*[F.col(b) for b in [*by, "_part"]]))
    joined = placed.join(small(ranges), F.col("_key").eqNullSafe(F.col("_range_of")))
    return joined.select(*counts.columns, (F.col("_in") + F.col("_range")).alias(out))


def _ranges(rows: DataFrame, by: list[str], order: list[str]) -> tuple[DataFrame, Window, Window]:
    """rows dealt into ranges (_part) of (by, order), stored; windows over the rows of a group in a range, and over the ranges of a group."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shared_table(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    return dealt, Window.partitionBy("_part", *by).orderBy(*order), Window.partitionBy(*by).orderBy("_part")


def _with_range(rows: DataFrame, told: DataFrame, by: list[str]) -> DataFrame:
    """rows of _ranges() with the columns that `told` has of their group and range; groups may be null."""
    key = lambda: F.struct("_part", *by)
    named = told.select(key().alias("_range_of"), *[c for c in told.columns if c not in ("_part", *by)])
    return rows.withColumn("_range", key()).join(small(named), F.col("_range") == F.col("_range_of"), "left").drop("_range", "_range_of")


def fill_forward(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """rows with nulls replaced by the last value before, in an order within groups.

    A group of any size is dealt into ranges; each takes over the last values of the ranges before.
    """
    dealt, inside, between = _ranges(rows, by, order)
    now, ahead = inside.rowsBetween(Window.unboundedPreceding, 0), between.rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    ends = dealt.groupBy(*by, "_part").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])
    carried = ends.select(*by, "_part", *[F.last(c, ignorenulls=True).over(ahead).alias(f"_before_{c}") for c in columns])
    filled = dealt.withColumns({c: F.last(c, ignorenulls=True).over(now) for c in columns})
    return _with_range(filled, carried, by).withColumns({c: F.coalesce(c, f"_before_{c}") for c in columns}).select(*rows.columns)


def neighbours(rows: DataFrame, by: list[str], order: list[str], column: str, previous: str, following: str) -> DataFrame:
    """rows with the values of a column, never null, in the rows before and after, in an order within groups of any size."""
    dealt, inside, between = _ranges(rows, by, order)
    at = F.struct(*order)
    ends = dealt.groupBy(*by, "_part").agg(F.min_by(column, at).alias("_first"), F.max_by(column, at).alias("_last"))
    edges = ends.select(*by, "_part", F.lag("_last").over(between).alias("_ahead"), F.lead("_first").over(between).alias("_behind"))
    own = dealt.withColumns({previous: F.lag(column).over(inside), following: F.lead(column).over(inside)})
    return _with_range(own, edges, by).withColumns({previous: F.coalesce(previous, "_ahead"), following: F.coalesce(following, "_behind")}).select(*rows.columns, previous, following)


def quantiles(rows: DataFrame, column: str, cuts: list[float]) -> list[float] | None:
    """Exact quantiles of a column, interpolated between neighbours; None without values."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    placed = shared_table(cumulative(counts, ["v"], "n"), "values")
    total = placed.agg(F.sum("n")).first()[0]
    if not total:
        return None
    places = {c: (total - 1) * c for c in cuts}
    wanted = sorted({x for p in places.values() for x in (math.floor(p), math.ceil(p))})
    hit = F.filter(F.array(*[F.lit(w).cast("long") for w in wanted]), lambda w: (w >= F.col("before")) & (w < F.col("before") + F.col("n")))
    at = {w: float(r["v"]) for r in placed.select("v", hit.alias("at")).where(F.size("at") > 0).collect() for w in r["at"]}
    low, high = lambda p: at[math.floor(p)], lambda p: at[math.ceil(p)]
    return [low(p) + (high(p) - low(p)) * (p - math.floor(p)) for p in places.values()]


def grouped_medians(rows: DataFrame, by: str, column: str, out: str) -> DataFrame:
    """(by, out): the exact median of each group, by counts of values."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(by, F.col(column).alias("v")).agg(F.count("*").alias("n"))
    placed = shared_table(cumulative(counts, ["v"], "n", [by]), "values")
    total = placed.groupBy(F.col(by).alias("_by")).agg(F.sum("n").alias("_all"))
    middle = placed.join(total, F.col(by) == F.col("_by"))
    holds = lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("n"))
    lo, hi = F.floor((F.col("_all") - 1) / 2), F.ceil((F.col("_all") - 1) / 2)
    return middle.groupBy(by).agg(((F.max(F.when(holds(lo), F.col("v"))) + F.max(F.when(holds(hi), F.col("v")))) / 2).alias(out))
