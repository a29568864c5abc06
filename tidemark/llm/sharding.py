"""Shards of near-equal bytes that keep groups whole (operator 12).

Longest processing time first: groups, the largest first, each go to the shard
that holds least so far, taken from a heap.  Groups of one size are interchangeable,
so the heap runs over sizes and their numbers: a size with few groups pops the heap
once for each, one with many takes all pops below a level at once and the rest in
order, which gives the loads that single pops would give.  What passes through
that one task is a row for each distinct size; D distinct sizes of whole bytes need
D * (D + 1) / 2 bytes, so there are at most sqrt(2 * bytes) of them (14 million in
100 TB), and they stream.  All else (sizes of groups, places of groups among those
of their size, slots of rows in their shard) is aggregated, joined and numbered by ranges.

A group never leaves its shard, so one that is larger than a shard's share makes that
shard larger; the others stay near equal.  A null group is a group of its own, a null size
counts as 0, groups of size 0 go to the shard that holds least at the end.  Ties: shards by number, groups
of a size by group, rows by `order`; rows alike in all of these are numbered in any order.
Without rows there are no shards.  Further columns are kept, and none is overwritten.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, numbered, stored, table

SHARDS = 40
#: Bytes that a document takes beside its text.
HEAD = 16


def deal(heap: list[tuple[int, int]], size: int, n: int) -> dict[int, int]:
    """How many of n groups of one size each shard of the heap of (load, shard) gets; the heap is brought up to date."""
    got: dict[int, int] = {}
    if size == 0:
        return {heap[0][1]: n}
    if n > 4 * len(heap):
        # a shard of load x is popped at x, x + size, ...: all pops under the highest level that n can pay for
        pops = lambda level: sum(max(0, -((x - level) // size)) for x, _ in heap)
        low, high = heap[0][0], heap[0][0] + n * size + 1
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if pops(middle) <= n else (low, middle)
        got = {shard: k for x, shard in heap if (k := max(0, -((x - low) // size)))}
        heap[:] = [(x + got.get(shard, 0) * size, shard) for x, shard in heap]
        heapq.heapify(heap)
        n -= sum(got.values())
    for _ in range(n):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        got[shard] = got.get(shard, 0) + 1
    return got


def schedule(sizes: DataFrame, shards: int) -> DataFrame:
    """(total, shard, upto): for each size of (total, n), the shards that get groups of it and the number of groups up to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = [(0, s) for s in range(shards)]
        for batch in batches:
            totals, shard_of, upto = batch.column("total"), [], []
            for total, n in zip(totals.to_pylist(), batch.column("n").to_pylist()):
                got, before = sorted(deal(heap, total, n).items()), 0
                shard_of.append([s for s, _ in got])
                upto.append([before := before + k for _, k in got])
            yield pa.RecordBatch.from_arrays([totals, pa.array(shard_of, pa.list_(pa.int32())), pa.array(upto, pa.list_(pa.int64()))], names=["total", "shard", "upto"])

    return sizes.select("total", "n").repartition(1).sortWithinPartitions(F.desc("total")).mapInArrow(run, "total long, shard array<int>, upto array<long>")


def shard(rows: DataFrame, group: Column, size: Column, order: list[str], shards: int = SHARDS) -> DataFrame:
    """rows with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard).

    Rows of one group meet in one shard, and the bytes of shards are levelled.  Names that rows
    has already are lengthened by underscores.
    """
    key, bytes_, shard_of, slot = fresh(rows.columns, "group", "bytes", "shard", "slot")
    marked = stored(rows.withColumn(key, F.sha2(F.to_json(F.struct(group.alias("g"))).cast("binary"), 256)).withColumn(bytes_, F.coalesce(size.cast("long"), F.lit(0))), "sized")
    groups = stored(marked.groupBy(F.col(key).alias("key")).agg(F.sum(bytes_).alias("total")), "groups")
    plan = stored(schedule(groups.groupBy("total").agg(F.count("*").alias("n")), shards), "schedule")
    # the schedule's rows are fewer than the groups', but unbounded: a plain join, split where a size is common
    placed = numbered(groups, ["total"], ["key"], "place").join(plan, "total")
    homes = stored(placed.select(F.col("key").alias(key), F.get("shard", F.size(F.filter("upto", lambda u: u <= F.col("place")))).alias(shard_of)), "homes")
    return numbered(marked.join(homes, key).drop(bytes_), [shard_of], [*order, key], slot).drop(key)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40 and its slot there; documents of equal texts (null: empty) share a shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + HEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text.cast("binary"), 256).alias("digest"),
    )
    rows = shard(docs, F.col("digest"), F.col("size"), ["doc_id"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
