"""Near duplicates by circulant MinHash, banding and exact Jaccard verification (operator 7).

Two permutations of the 32-bit numbers make all coordinates of a signature: the
first, sigma, scatters a document's shingles, the second, pi, is shifted by k
around the circle for coordinate k.  Documents of one shingle set form a class,
whose least id stands for it.  Representatives that share a band are candidates.

In each bucket of a band the member that meets most others leads, and all
members are verified against it, so the work grows with the bucket and not with
its square.  Links found this way are joined to components.  What remains are
pairs with a common leader in different components: the distances to the leader
(the Jaccard distance is a metric), the sizes, and one-bit sketches rule out
most, and all others are verified inside the join, which yields links only.  There
the members outside of a group's largest component meet all members, which are
dealt into blocks, so no task holds a whole group.  So no link of a bucket is lost.

Classes are told apart by the size of the set and two 64-bit sums over it, each
from word hashes of its own; links are confirmed on whole sets of 64-bit shingles.
Nulls, empty and blank texts have no shingle; repeated keys are one document (the
same text) or are joined by their key like links; other columns aren't touched.

With the default 40 bands of 6 coordinates a pair of similarity 0.8 shares no
band with a chance of 5e-6, of 0.85 with 6e-9; the sketch misses one with 3e-7.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, checked_broadcast, stored, table
from .components import components
from .shingles import mix64, shingles

BANDS, ROWS = 40, 6
#: Share of equal bits in sketches below which a pair of similarity 0.8 (0.9 of the bits) isn't looked at.
LEAST_BITS = 0.8
#: Members of a leader's group that one block holds, about.
GROUP_BLOCK = 512
#: Ids of candidates are broadcast up to this number, beyond it they are joined by shuffle.
BROADCAST_IDS = 200_000
_SEED_A, _SEED_B = np.uint32(0x7FEB352D), np.uint32(0x2C1B3C6D)


def _permute(x: np.ndarray, out: np.ndarray, tmp: np.ndarray) -> None:
    """A fixed permutation of the 32-bit numbers, from x into out."""
    np.right_shift(x, np.uint32(16), out=tmp)
    np.bitwise_xor(x, tmp, out=out)
    np.multiply(out, np.uint32(0x85EBCA6B), out=out)
    np.right_shift(out, np.uint32(13), out=tmp)
    np.bitwise_xor(out, tmp, out=out)
    np.multiply(out, np.uint32(0xC2B2AE35), out=out)
    np.right_shift(out, np.uint32(16), out=tmp)
    np.bitwise_xor(out, tmp, out=out)


def circulant(hashes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Signatures [documents with shingles, size] of sets that lie end to end."""
    full = counts[counts > 0]
    starts = np.concatenate([[0], np.cumsum(full)])[:-1].astype(np.int64)
    x = (hashes >> np.uint64(32)).astype(np.uint32) * _SEED_A
    x ^= x >> np.uint32(15)
    x *= _SEED_B
    x ^= x >> np.uint32(12)  # sigma
    out = np.empty((len(full), size), np.uint32)
    moved, seen, tmp = np.empty_like(x), np.empty_like(x), np.empty_like(x)
    for k in range(size):
        np.subtract(x, np.uint32(k), out=moved)  # pi, shifted by k around the circle
        _permute(moved, seen, tmp)
        out[:, k] = np.minimum.reduceat(seen, starts)
    return out


def signatures(docs: DataFrame, text: str, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with n_shingles, the set's 128-bit digest (d1, d2), a hash for each band, and a bit of each coordinate."""
    size, longs = bands * rows, -(-bands * rows // 64)
    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("d1", T.LongType()),
        T.StructField("d2", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("bits", T.ArrayType(T.LongType())),
    ]

    def make():
        def part(column: pa.Array) -> list[np.ndarray]:
            hashes, counts = shingles(column, width)
            n, full = len(counts), np.flatnonzero(counts)
            digest, keys, bits = np.zeros((2, n), np.uint64), np.zeros((n, bands), np.uint64), np.zeros((n, longs), np.uint64)
            if len(full):
                starts = np.concatenate([[0], np.cumsum(counts[full])])[:-1]
                digest[0, full] = np.add.reduceat(hashes, starts)
                again, counts2 = shingles(column, width, seed=1)
                digest[1, full] = np.add.reduceat(again, np.concatenate([[0], np.cumsum(counts2[full])])[:-1])
                sig = circulant(hashes, counts, size)
                key = np.zeros((len(full), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
                for r in range(rows):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows])
                keys[full] = key
                bit = np.zeros((len(full), longs * 64), np.uint8)
                bit[:, :size] = (sig * np.uint32(0x9E3779B1)) >> np.uint32(31)
                bits[full] = np.packbits(bit, axis=1).view(">u8").astype(np.uint64)
            return [counts.astype(np.int64), *digest.view(np.int64), keys.view(np.int64), bits.view(np.int64)]

        def work(batch: pa.RecordBatch) -> list:
            counts, d1, d2, keys, bits = part(batch.column(text))
            lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel()))
            return [pa.array(counts), pa.array(d1), pa.array(d2), lists(keys), lists(bits)]

        return work

    return append_columns(docs, text, fields, make, most=1 << 20)


def _sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, items): the whole shingle set of each document, sorted."""

    def make():
        def work(batch: pa.RecordBatch) -> list:
            hashes, counts = shingles(batch.column(text), width)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))]

        return work

    return append_columns(docs.select(F.col(key).alias("id"), text), text, [T.StructField("items", T.ArrayType(T.LongType(), False))], make).select("id", "items")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with the sizes of the intersection and of the union of their whole sets."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("_x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("_y"))
    both = pairs.join(left, "a").join(right, "b")
    shared = both.select("a", "b", F.size(F.array_intersect("_x", "_y")).cast("long").alias("shared"), (F.size("_x") + F.size("_y")).cast("long").alias("_sum"))
    return shared.select("a", "b", "shared", (F.col("_sum") - F.col("shared")).alias("united"))


def _like(a: str, b: str, size: int) -> Column:
    """Whether sketches a and b agree in enough bits."""
    longs = -(-size // 64)
    apart = sum((F.bit_count(F.get(F.col(a), i).bitwiseXOR(F.get(F.col(b), i))) for i in range(longs)), F.lit(0))
    return apart <= int(size * (1 - LEAST_BITS))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id) of each document.

    Documents link if 100 * intersection >= percent * union of their sets of
    distinct `width`-word shingles; component_id is the least key reachable, and keys
    are of any type that can be ordered.  A
    document of fewer words has its sequence as its one shingle; null, empty and
    blank texts have no shingle and stay alone.  percent is 80 or more, as the bands
    would lose links below.
    """
    if percent < 80:
        raise ValueError("the bands find links of 80 percent and more")
    small = docs.select(key, text)
    signed = stored(signatures(small, text, width, bands, rows).drop(text), "signatures")
    chosen = F.struct(F.col(key).alias("id"), "bands", "bits")
    classes = signed.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min(chosen).alias("r"))
    reps = classes.select(F.col("r.id").alias("id"), F.col("n_shingles").alias("n"), "r.bits", F.explode("r.bands").alias("bucket"))
    # Small tables are stored before they are joined: a join of two plain shuffles can split a hot key.
    shared = stored(reps.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    met = stored(reps.join(shared, "bucket"), "members")
    edges = _links(met, small, key, text, width, percent, bands * rows)
    of_node = components(edges)
    least = signed.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min(key).alias("id"))
    rep_of = least.join(of_node.withColumnRenamed("node", "id"), "id", "left")
    named = rep_of.select("d1", "d2", F.col("n_shingles").alias("_n"), F.coalesce("component", "id").alias("component_id"))
    joined = signed.select(key, "n_shingles", "d1", "d2").join(named.withColumnRenamed("d1", "e1").withColumnRenamed("d2", "e2"), (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n_shingles") == F.col("_n")), "left")
    return joined.select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id"))


def _links(met: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int, size: int) -> DataFrame:
    """Links between the representatives that share buckets, enough to connect all that link."""
    degree = met.groupBy("id").agg(F.sum("members").alias("degree"))
    ids = checked_broadcast(degree.select(F.col("id").alias(key)), BROADCAST_IDS)
    sets = stored(_sets(docs.join(ids, key, "left_semi"), key, text, width), "sets")
    ranked = met.join(degree, "id")
    leads = stored(ranked.groupBy("bucket").agg(F.max_by("id", F.struct("degree", F.xxhash64("id"))).alias("leader")), "leads")
    led = stored(met.join(leads, "bucket"), "led")
    first = led.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    told = stored(_verified(first, sets), "verified")
    linked = F.col("shared") * 100 >= F.col("united") * percent
    edges = told.where(linked).select("a", "b")
    part = components(edges)
    apart = 1 - F.col("shared") / F.col("united")
    member = (
        told.select(F.col("b").alias("leader"), F.col("a").alias("id"), apart.alias("apart"))
        .join(part.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    member = stored(member, "led_members")
    parts = member.groupBy("leader", "component").agg(F.count("*").alias("_m"))
    open_ = parts.groupBy("leader").agg(F.max_by("component", F.struct("_m", "component")).alias("_big"), F.sum("_m").alias("_all"), F.count("*").alias("_parts"))
    open_ = stored(open_.where("_parts > 1").select("leader", "_big", F.ceil(F.col("_all") / GROUP_BLOCK).cast("int").alias("_blocks")), "open")
    sketch = stored(met.groupBy("id").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "sketches")
    rest = stored(member.join(open_, "leader").join(sketch, "id").join(sets, "id"), "rest")
    # All members lie in a block of their group; those outside of its largest component go to every block.
    every = rest.withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    few = rest.where("component <> _big").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    reach = 1 - percent / 100 + 1e-9
    x = few.select(*[F.col(c).alias(f"x_{c}") for c in few.columns])
    y = every.select(*[F.col(c).alias(f"y_{c}") for c in every.columns])
    shared = F.size(F.array_intersect("x_items", "y_items")).cast("long")
    hold = (
        (F.col("x_leader") == F.col("y_leader"))
        & (F.col("x_block") == F.col("y_block"))
        & (F.col("x_component") != F.col("y_component"))
        & ((F.col("x_id") < F.col("y_id")) | (F.col("y_component") == F.col("y__big")))
        & (F.abs(F.col("x_apart") - F.col("y_apart")) <= reach)
        & (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent)
        & _like("x_bits", "y_bits", size)
        & (shared * 100 >= (F.col("x_n") + F.col("y_n") - shared) * percent)
    )
    more = x.join(y, hold).select(F.col("x_id").alias("a"), F.col("y_id").alias("b"))
    return edges.unionByName(more)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles at 80 percent: each document's class and whether it stays."""
    made = near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return made.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
