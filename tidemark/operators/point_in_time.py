"""Sums over what was known before each row: windowed, self-excluding, tie-aware.

An entry counts for a query row if it comes earlier in the stream (smaller time,
or equal time and smaller seq) and its time is greater than the query's less the
window (not smaller, if inclusive; no bound, if the window is None).

Time is cut into stretches of one window.  An entry belongs to its own stretch
and to the next, a query to its own, so a frame never looks outside its stretch,
and a key with very many entries spreads over as many partitions as it has
stretches.  Without a bound, earlier stretches enter as sums.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAY
from .common import shared_table, small

#: Stretches that split history where there is no bound.
UNBOUNDED_STRETCH = 90 * DAY


def earlier_sums(queries: DataFrame, entries: DataFrame, keys: list[str], values: list[str], window: int | None, inclusive: bool = False, row_id: str = "id", within: list[str] | None = None) -> DataFrame:
    """queries with the sums of `values` over the earlier entries of the same keys, 0 where there are none.

    queries has row_id, ts, seq and the keys; entries has ts, seq, the keys and
    the values.  Rows with a null key see nothing.  With further keys in `within`,
    the sums over entries that have these in common too stand beside them, named
    <value>_within, from the same shuffle.

    A query's other columns travel with it, so it is shuffled once and never joined back.  Frames
    are differences of running sums, so a key's work grows with its rows and not with their square.
    """
    length = window or UNBOUNDED_STRETCH
    stretch = F.floor(F.col("ts") / length)
    if within and not window:
        raise ValueError("sums within further keys need a window")
    outer, keys = keys, [*keys, *(within or [])]
    known = lambda of: reduce(and_, [F.col(c).isNotNull() for c in of])
    rest = [c for c in queries.columns if c not in (*keys, "ts", "seq", *values)]
    facts = entries.select(*keys, "ts", "seq", *values).where(known(outer))
    row = F.struct(*rest) if rest else F.struct(F.lit(0).alias("_"))
    asked = queries.select(*keys, "ts", "seq", *[F.lit(0).cast(facts.schema[v].dataType).alias(v) for v in values], stretch.alias("_stretch"), row.alias("_row"))
    reach = F.array(stretch, stretch + 1) if window else F.array(stretch)
    history = facts.withColumn("_stretch", F.explode(reach)).withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType))
    both = history.unionByName(asked).repartition(*outer, "_stretch")  # of several keys too, both kinds of sums come from this one shuffle

    def sums(of: list[str], tail: str) -> list[Column]:
        key = [*of, "_stretch"]
        up_to_now = Window.partitionBy(*key).orderBy("ts", "seq").rangeBetween(Window.unboundedPreceding, 0)
        same = Window.partitionBy(*key, "ts", "seq")
        gone = Window.partitionBy(*key).orderBy("ts").rangeBetween(Window.unboundedPreceding, -(length + 1 if inclusive else length))
        total = lambda v, over: F.coalesce(F.sum(v).over(over), F.lit(0))
        seen = lambda v: total(v, up_to_now) - total(v, same) - (total(v, gone) if window else F.lit(0))
        return [F.when(known(of), seen(v)).otherwise(0).alias(v + tail) for v in values]

    own = [*sums(outer, ""), *sums(keys, "_within")] if within else sums(keys, "")
    told = [*values, *([f"{v}_within" for v in values] if within else [])]
    seen = both.select(*keys, "ts", "seq", "_stretch", "_row", *own).where(F.col("_row").isNotNull())
    if not window:
        per = facts.groupBy(*keys, stretch.alias("_stretch")).agg(*[F.sum(v).alias(v) for v in values])
        slots = per.select(*keys, "_stretch", *values, F.lit(False).alias("_ask")).unionByName(seen.select(*keys, "_stretch", *[F.lit(0).cast(per.schema[v].dataType).alias(v) for v in values], F.lit(True).alias("_ask")).distinct())
        past = Window.partitionBy(*keys).orderBy("_stretch").rangeBetween(Window.unboundedPreceding, -1)
        earlier = slots.select(*keys, "_stretch", "_ask", *[F.coalesce(F.sum(v).over(past), F.lit(0)).alias(f"_{v}") for v in values]).where("_ask").drop("_ask")
        seen = seen.join(earlier, [*keys, "_stretch"], "left").withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values})
    return seen.select(*[F.col("_row")[c].alias(c) if c in rest else F.col(c) for c in queries.columns if c not in values], *told)


def first_seen(rows: DataFrame, keys: list[str], out: str, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """rows with a boolean: whether the row is the first of its keys in stream order."""
    least = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return rows.join(least, keys, "left").withColumn(out, F.struct(*order) == F.col("_first")).drop("_first")


def greedy_chunks(rows: DataFrame, window: int, ts: str = "ts") -> DataFrame:
    """rows with chunk_id: a chunk begins at the first time more than a window after the last chunk began.

    Each time's successor, the first time more than a window later, is looked up in
    its stretch of time or is the least of the next one that has any.  The chain of
    starts doubles each round, so a chain of many chunks takes few rounds.
    """
    times = shared_table(rows.select(F.col(ts).alias("t")).where("t is not null").distinct(), "times")
    stretch = F.floor(F.col("x") / window)
    there = times.select(F.col("t").alias("x"), F.col("t").alias("time"), F.lit(None).cast("long").alias("asks"))
    asked = times.select((F.col("t") + window).alias("x"), F.lit(None).cast("long").alias("time"), F.col("t").alias("asks"))
    after = Window.partitionBy("s").orderBy("x").rangeBetween(1, Window.unboundedFollowing)
    found = there.unionByName(asked).withColumn("s", stretch).withColumn("near", F.min("time").over(after)).where("asks is not null")
    least = there.groupBy(stretch.alias("s")).agg(F.min("x").alias("first"))
    # as few rows as the span of time has windows: of those before which a stretch lies, its own or a later first
    held = found.select("s").distinct().join(least, "s", "full")
    later = held.withColumn("next", F.min("first").over(Window.orderBy("s").rowsBetween(1, Window.unboundedFollowing))).select("s", "next")
    jump = shared_table(found.join(small(later), "s").select(F.col("asks").alias("t"), F.coalesce("near", "next").alias("to")).where("to is not null"), "jumps")
    starts = shared_table(times.agg(F.min("t").alias("t")).where("t is not null"), "starts")
    count = starts.count()
    while count:
        more = starts.join(jump, "t").select(F.col("to").alias("t"))
        starts = shared_table(starts.union(more).distinct(), "starts")
        before, count = count, starts.count()
        if count == before:
            break
        jump = shared_table(jump.join(jump.select(F.col("t").alias("to"), F.col("to").alias("far")), "to").select("t", F.col("far").alias("to")), "jumps")
    order = Window.orderBy("t")
    bounds = starts.select((F.row_number().over(order) - 1).cast("long").alias("chunk_id"), F.col("t").alias("_from"), F.lead("t").over(order).alias("_to"))
    held = times.withColumn("x", F.col("t")).withColumn("s", stretch)
    # a stretch holds one start at most, so its times are of the chunk that begins in it or of the last one before
    edge = held.select("s").distinct().join(bounds.withColumn("x", F.col("_from")).withColumn("s", stretch).drop("x"), "s", "full")
    open_ = edge.withColumn("_last", F.max("chunk_id").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)))
    own = held.join(small(open_), "s").select("t", F.when(F.col("_from") <= F.col("t"), F.col("chunk_id")).otherwise(F.col("_last")).alias("chunk_id"))
    return rows.join(small(shared_table(own.withColumnRenamed("t", "_t"), "chunks")), F.col(ts) == F.col("_t"), "left").drop("_t")


def rate(hits: Column, total: Column) -> Column:
    """hits / total, 0 where there is nothing."""
    return F.coalesce(F.try_divide(hits, total), F.lit(0.0))
