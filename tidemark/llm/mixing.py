"""Mixing sources to target weights by min-cost flow (operator 2).

Documents that belong to the same set of sources form a pattern.  Each pattern
offers its size once at no cost, a second time at cost 1, and so on up to
MOST_COPIES, so repeating is convex in cost; a flow of least cost routes this
capacity to the sources' quotas.  Patterns and sources that hang together are one
component and are solved in one task, so a task holds sets of sources, not documents.

Within a pattern each document is taken as often as all can be; the rest goes to
documents in the order of a seeded hash, the last one in part.  The place in that
order where the rest ends is found by sums over hash ranges, so even a source
with a third of all documents is never ordered in one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checked_broadcast, stored, table
from .components import components

MOST_COPIES = 2
SEED = 17
#: Hash ranges of the order within a pattern.
RANGES = 4096
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def _named(source: Column) -> Column:
    """A text that differs for different sources, null included."""
    return F.coalesce(F.concat(F.length(source).cast("string"), F.lit(":"), source), F.lit("null"))


def pattern_of(sources: Column) -> Column:
    """A text for the set of sources in an array."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(sources, _named))), "|")


def fill_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, get the weights in turn and divide
    share * all sizes by them; a target stops at most * its source's size, and
    the excess is divided again until none is above.
    """
    spark = sizes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(sizes.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "sources")
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = dealt.withColumn("_place", place).join(F.broadcast(before), "_part")
    turn = ((F.col("_place") + F.col("_before")) % len(weights)).cast("int")
    weighed = stored(ranked.select("source", "source_size", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight")), "weights")
    cap = F.col("source_size") * float(most)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, last = 0.0, None
    while level != last:
        full = F.col("weight") * level > cap
        used, left = weighed.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        last, level = level, (share * total - (used or 0.0)) / left if left else level
    return weighed.select("source", "source_size", F.least(cap, F.col("weight") * level).alias("target"))


def route(offers: dict[str, tuple[float, list[str]]], quotas: dict[str, float], most_copies: int = MOST_COPIES) -> dict[str, dict[str, float]]:
    """Flow of least cost from patterns to sources.

    offers: each pattern's size and sources.  Copy number r of a pattern costs
    r - 1, and no path returns to the origin, so opening the copies one after the
    other and filling the shortest paths of all patterns at once, until none is
    left, yields the least cost.
    """
    flow: dict[str, dict[str, float]] = {p: {} for p in offers}
    need = dict(quotas)
    for _ in range(most_copies):
        spare = {p: float(size) for p, (size, _) in offers.items() if size > 0}
        while _fill_shortest(offers, flow, spare, need):
            pass
    return flow


def _fill_shortest(offers: dict[str, tuple[float, list[str]]], flow: dict[str, dict[str, float]], spare: dict[str, float], need: dict[str, float]) -> bool:
    """Fill all shortest paths from patterns with spare words to sources in need; False if there are none."""
    given: dict[str, list[str]] = {}
    for p, f in flow.items():
        for s, x in f.items():
            if x > 1e-9:
                given.setdefault(s, []).append(p)
    starts = [p for p, x in spare.items() if x > 1e-9]
    level = {("p", p): 0 for p in starts}
    here, depth, met = list(level), 0, False
    while here and not met:
        depth += 1
        nexts = []
        for side, name in here:
            for x in [("s", s) for s in offers[name][1]] if side == "p" else [("p", p) for p in given.get(name, ())]:
                if x not in level:
                    level[x] = depth
                    nexts.append(x)
                    met = met or (x[0] == "s" and need.get(x[1], 0.0) > 1e-9)
        here = nexts
    if not met:
        return False
    # Each edge is left for good once nothing more goes through it.
    ahead: dict[tuple[str, str], list[str]] = {}
    for start in starts:
        path = [("p", start)]
        while path:
            side, name = top = path[-1]
            if side == "s" and level[top] == depth and need.get(name, 0.0) > 1e-9:
                moved = min([spare[start], need[name], *[flow[b[1]][a[1]] for a, b in zip(path, path[1:], strict=False) if a[0] == "s"]])
                for a, b in zip(path, path[1:], strict=False):
                    if a[0] == "p":
                        flow[a[1]][b[1]] = flow[a[1]].get(b[1], 0.0) + moved
                    else:
                        flow[b[1]][a[1]] -= moved
                spare[start] -= moved
                need[name] -= moved
                if spare[start] <= 1e-9:
                    break
                path = path[:1]
                continue
            if top not in ahead:
                other = ("s", offers[name][1]) if side == "p" else ("p", given.get(name, ()))
                ahead[top] = [x for x in reversed(other[1]) if level.get((other[0], x)) == level[top] + 1] if level[top] < depth else []
            while ahead[top] and side == "s" and flow[ahead[top][-1]].get(name, 0.0) <= 1e-9:
                ahead[top].pop()
            if ahead[top]:
                path.append(("s" if side == "p" else "p", ahead[top][-1]))
            else:
                path.pop()
                if path:
                    ahead[path[-1]].pop()
    return True


def _takes(members: DataFrame, targets: DataFrame, most_copies: int) -> DataFrame:
    """(pattern, size, take): how many words of each pattern the mix takes."""
    offers = members.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("sources").alias("sources"))
    named = targets.select(_named(F.col("source")).alias("name"), "target")
    each = offers.withColumn("name", F.explode(F.array_distinct(F.transform("sources", _named))))
    shared = each.groupBy("name").agg(F.count("*").alias("_patterns"))
    quota = stored(each.drop("sources").join(shared, "name").join(named, "name", "left"), "offers")
    # A pattern whose sources are in no other pattern is a component of its own.
    alone = quota.groupBy("pattern").agg(F.max("_patterns").alias("_p")).where("_p = 1").select("pattern")
    linked = quota.join(alone, "pattern", "left_anti")
    node = F.concat(F.lit("p "), "pattern")
    edges = linked.select(node.alias("a"), F.concat(F.lit("s "), "name").alias("b"))
    if linked.limit(1).count():
        linked = linked.join(components(edges).withColumnRenamed("node", "_node"), node == F.col("_node")).drop("_node")
    else:
        linked = linked.withColumn("component", node)
    whole = quota.join(alone, "pattern", "left_semi").withColumn("component", node).unionByName(linked)
    lots = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def solve(part: pa.Table) -> pa.Table:
        net: dict[str, tuple[float, list[str]]] = {}
        for p, n, name in zip(*(part.column(c).to_pylist() for c in ("pattern", "size", "name")), strict=True):
            net.setdefault(p, (float(n or 0), []))[1].append(name)
        quotas = {name: t or 0.0 for name, t in zip(part.column("name").to_pylist(), part.column("target").to_pylist(), strict=True)}
        flow = route({p: (n, sorted(s)) for p, (n, s) in sorted(net.items())}, quotas, most_copies)
        return pa.table({"pattern": pa.array(list(flow), pa.string()), "size": pa.array([int(net[p][0]) for p in flow], pa.int64()), "take": pa.array([float(sum(f.values())) for f in flow.values()], pa.float64())})

    dealt = whole.select("pattern", "size", "name", F.col("target").cast("double").alias("target"), F.pmod(F.xxhash64("component"), F.lit(lots)).alias("lot"))
    return dealt.groupBy("lot").applyInArrow(solve, "pattern string, size long, take double")


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", sources: str = "sources", size: str = "size", most_copies: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """(key, sources, size, taken): how many words the mix takes of each document.

    docs has for each document an array of its sources and its size; targets is
    (source, target).  A document is taken at most most_copies times; one of size
    0 or without sources gives nothing.  The same rows always give the same mix.
    """
    base = docs.select(F.col(key).alias("_key"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.col(sources).alias("sources"), F.col(sources).alias("_own")).withColumn("pattern", pattern_of(F.col("sources")))
    members = stored(base.withColumn("_hash", F.xxhash64(F.lit(seed), F.col("_key").cast("string"))).withColumn("_range", F.shiftright("_hash", 52) + RANGES // 2), "members")
    takes = stored(_takes(members, targets, most_copies).withColumn("_copies", F.when(F.col("size") > 0, F.floor(F.col("take") / F.col("size"))).otherwise(0).cast("long")).withColumn("_rest", F.floor(F.col("take")).cast("long") - F.col("_copies") * F.col("size")).drop("size"), "takes")
    sums = members.groupBy("pattern", "_range").agg(F.sum("size").alias("_sum"))
    up = Window.partitionBy("pattern").orderBy("_range")
    where = (
        sums.withColumn("_before", F.sum("_sum").over(up) - F.col("_sum"))
        .join(takes, "pattern")
        .where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_sum") >= F.col("_rest")))
        .groupBy("pattern")
        .agg(F.min(F.struct("_range", "_before")).alias("_end"))
    )
    ends = takes.join(where, "pattern", "left").select("pattern", "_copies", "_rest", F.coalesce("_end._range", F.lit(-1)).alias("_stop"), F.coalesce("_end._before", F.lit(0)).alias("_before"))
    placed = members.drop("sources").join(checked_broadcast(stored(ends, "ends"), BROADCAST_ROWS), "pattern", "left")
    whole = placed.where("_stop is null or _range <> _stop").withColumn("_more", F.when(F.col("_range") < F.col("_stop"), F.col("size")).otherwise(0))
    order = Window.partitionBy("pattern").orderBy("_hash", "_key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_rest") - F.col("_before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    part = placed.where("_range = _stop").withColumn("_more", F.least(F.greatest(left, F.lit(0)), F.col("size")))
    taken = (F.coalesce("_copies", F.lit(0)) * F.col("size") + F.col("_more")).cast("long")
    return whole.unionByName(part).select(F.col("_key").alias(key), F.col("_own").alias("sources"), "size", taken.alias("taken"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150% of all words takes of each document, sources weighing 3, 1, 2 in turn."""
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(fill_targets(sizes, [3, 1, 2], 1.5, MOST_COPIES), "targets")
    taken = mix(docs.withColumn("sources", F.array("source")), targets).withColumn("source", F.get("sources", F.lit(0)))
    known = checked_broadcast(targets.withColumnRenamed("source", "_source"), BROADCAST_ROWS)
    return taken.join(known, F.col("source").eqNullSafe(F.col("_source")), "left").select("doc_id", "size", "source_size", "target", "taken")
