"""Exploratory aggregates, sampling and transforms of feature tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cumulative, grouped_medians, quantiles, small


def threshold_table(counts: DataFrame, count: str, thresholds: list[int]) -> DataFrame:
    """(threshold, groups, total): groups with at least so many rows, and their rows."""
    one = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    return counts.select(count, one).groupBy("threshold").agg(F.count_if(F.col(count) >= F.col("threshold")).alias("groups"), F.coalesce(F.sum(F.when(F.col(count) >= F.col("threshold"), F.col(count))), F.lit(0)).alias("total"))


def histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n): equal bins from least to largest, the last one closed."""
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    width = ((hi - lo) / bins) if lo is not None and hi > lo else 1.0
    place = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("long")
    return rows.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def describe(rows: DataFrame, column: str) -> DataFrame:
    """(n, mean, std, least, q1, median, q3, most) of a column, with exact quartiles."""
    q = quantiles(rows, column, [0.25, 0.5, 0.75]) or [None] * 3
    told = [F.lit(v).cast("double").alias(name) for v, name in zip(q, ("q1", "median", "q3"), strict=True)]
    return rows.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("least"), F.max(column).alias("most")).select("n", "mean", "std", "least", *told, "most")


def zero_inflation(rows: DataFrame, columns: list[str], rare: float = 80.0) -> DataFrame:
    """(column, zeros, others, percent, is_rare) for each column, in one pass."""
    sums = rows.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c) == 0).alias(c) for c in columns])
    each = sums.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("zeros")) for c in columns])).alias("x"))
    percent = F.col("x.zeros") * 100.0 / F.col("_n")
    return each.select("x.column", "x.zeros", (F.col("_n") - F.col("x.zeros")).alias("others"), percent.alias("percent"), (percent > rare).alias("is_rare"))


def log_odds(rows: DataFrame, column: str, outcome: str, cuts: list[float]) -> DataFrame:
    """(bin, middle, log_odds) over quantile bins of the non-zero rows, closed on both sides; bins of one outcome are left out."""
    some = rows.where(F.col(column) != 0)
    edges = quantiles(some, column, cuts)
    if not edges:
        return rows.sparkSession.createDataFrame([], "bin int, middle double, log_odds double")
    bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])
    each = some.select(column, outcome, F.explode(F.filter(bins, lambda b: (F.col(column) >= b["lo"]) & (F.col(column) <= b["hi"]))).alias("b"))
    p = F.avg(F.col(outcome).cast("double"))
    binned = each.select(F.col("b.bin").alias("bin"), column, outcome)
    middle = grouped_medians(binned, "bin", column, "middle")
    shares = binned.groupBy("bin").agg(p.alias("_p")).where("_p > 0 and _p < 1")
    return shares.join(small(middle), "bin").select("bin", "middle", F.log(F.col("_p") / (1 - F.col("_p"))).alias("log_odds"))


def percentile_boxes(rows: DataFrame, column: str, cuts: list[float]) -> DataFrame:
    """(box, n) of half-open boxes (lo, hi] between percentiles; the least row is in none."""
    edges = quantiles(rows, column, cuts) or []
    box = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:], strict=False)))):
        box = F.when((F.col(column) > a) & (F.col(column) <= b), i).otherwise(box)
    return rows.select(box.alias("box")).where("box is not null").groupBy("box").agg(F.count("*").alias("n"))


def min_max(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with columns scaled to 0..1; a constant column becomes 0."""
    if not columns:
        return rows
    ends = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = {c: F.coalesce(F.try_divide((F.col(c) - F.col(f"_lo_{c}")).cast("double"), (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")).cast("double")), F.lit(0.0)) for c in columns}
    return rows.crossJoin(F.broadcast(ends)).withColumns(scaled).select(*rows.columns)


#: Transforms that are tried against skewed features.
TRANSFORMS = {
    "log10": lambda x: F.log10(1 + x),
    "log1p": F.log1p,
    "sqrt": lambda x: F.sqrt(1 + x),
    "cbrt": lambda x: F.cbrt(1 + x),
    "inverse": lambda x: 1 / (1 + x),
    "square": lambda x: x * x,
    "cube": lambda x: x * x * x,
    "loglog": lambda x: F.log1p(F.log1p(x)),
    "log_point_1": lambda x: F.log(0.1 + x),
    "log_point_01": lambda x: F.log(0.01 + x),
    "log_point_001": lambda x: F.log(0.001 + x),
    "complement": lambda x: 1 - x,
}


def edge_weights(counts: DataFrame, label: str = "label", n: str = "n") -> DataFrame:
    """(label, weight): (1 - n / all) / (kinds - 1), which sum to 1."""
    all_ = counts.agg(F.sum(n).alias("_all"), F.count("*").alias("_kinds"))
    return counts.crossJoin(F.broadcast(all_)).select(label, ((1 - F.col(n) / F.col("_all")) / (F.col("_kinds") - 1)).alias("weight"))


def weighted_sum(parts: list[tuple[float, str]]) -> Column:
    return reduce(lambda a, b: a + b, [w * F.col(c) for w, c in parts])


def sample_cap(counts: DataFrame, n: str, share: float) -> DataFrame:
    """(cap): the largest count below the given share of groups by rank.

    Counts of counts decide, so the number of groups doesn't matter.
    """
    per = counts.groupBy(n).agg(F.count("*").alias("_g"))
    total = per.agg(F.sum("_g").alias("_all"))
    upto = cumulative(per, [n], "_g", out="_before")
    return upto.crossJoin(F.broadcast(total)).where(F.col("_before") < F.floor(F.col("_all") * share)).agg(F.max(n).alias("cap"))


def capped_sample(rows: DataFrame, group: str, key: str, cap: int, seed: int = 43) -> DataFrame:
    """At most cap rows of each group, chosen by a seeded hash.

    The cap-th least hash of a group is found range by range, so a group with very
    many rows isn't ordered in one task.
    """
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), key)).withColumn("_range", F.shiftright("_h", 54))
    per = hashed.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = per.withColumn("_before", F.sum("_n").over(Window.partitionBy(group).orderBy("_range")) - F.col("_n")).where(F.col("_before") < cap)
    near = hashed.join(before.select(group, "_range", "_before", "_n"), [group, "_range"])
    sure = near.where(F.col("_before") + F.col("_n") <= cap)
    edge = near.where(F.col("_before") + F.col("_n") > cap).withColumn("_at", F.row_number().over(Window.partitionBy(group, "_range").orderBy("_h", key)) + F.col("_before")).where(F.col("_at") <= cap)
    return sure.select(*rows.columns).unionByName(edge.select(*rows.columns))


def seeded_order(key: Column, seed: int) -> Column:
    """A text by which rows are shuffled: the same for the same key and seed, on any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def seeded_sample(rows: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """`most` rows chosen by a seeded shuffle; each task hands on its own first ones only."""
    return rows.orderBy(seeded_order(F.col(key), seed), key).limit(most)


def shuffled(rows: DataFrame, key: str, out: str, seed: int = 42) -> DataFrame:
    """rows with new numbers 0, 1, ... in a seeded order."""
    placed = rows.withColumn("_order", seeded_order(F.col(key), seed)).withColumn("_one", F.lit(1))
    return cumulative(placed, ["_order", key], "_one", out=out).drop("_order", "_one")


def sample_size(population: Column, spread: float, z: float = 1.96, error: float = 0.05) -> Column:
    """Rows that a representative sample needs."""
    top = z * z * spread
    return F.ceil(top / (error * error + top / population))
