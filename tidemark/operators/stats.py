"""Statistics and models: sums come from Spark, only matrices of columns are handled on the driver."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BROADCAST_ROWS
from .common import cumulative, shared_table, small, spread


def gram(rows: DataFrame, columns: list[str], weight: Column | None = None) -> np.ndarray:
    """The matrix of sums of products of columns, in one aggregation."""
    w = F.lit(1.0) if weight is None else weight
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    got = rows.agg(*[F.sum(w * F.col(columns[i]) * F.col(columns[j])).alias(f"s{n}") for n, (i, j) in enumerate(pairs)]).first()
    out = np.zeros((len(columns), len(columns)))
    for n, (i, j) in enumerate(pairs):
        out[i, j] = out[j, i] = got[n] or 0.0
    return out


def vif(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, vif): uncentred variance inflation, as without a constant."""
    g = gram(rows, columns)
    values = np.diag(g) * np.diag(np.linalg.pinv(g))
    return rows.sparkSession.createDataFrame(list(zip(columns, values.tolist(), strict=True)), "column string, vif double")


def placed_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, v, n, before): how often each value of each column occurs, and how many values of its column are less.

    All columns are melted and counted together, and their counts ordered together: few counts by one
    window for each column, more by ranges of (column, value).  Null is the least value.
    """
    values = rows.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("column", "v"))
    counts = shared_table(values.groupBy("column", "v").agg(F.count("*").alias("n")), "counts")
    if counts.observed_rows <= BROADCAST_ROWS:
        less = Window.partitionBy("column").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("before", F.coalesce(F.sum("n").over(less), F.lit(0)))
    else:
        placed = cumulative(counts, ["v"], "n", ["column"])
    return shared_table(placed, "placed")


def summaries(rows: DataFrame, columns: list[str], cuts: dict[str, float] | None = None) -> DataFrame:
    """(column, n, mean, std, least, <cuts>, most) of each column, nulls left out; quantiles are exact, between neighbours.

    All of it comes from the counts of values, so rows are read once for all columns.
    """
    cuts = cuts or {"q1": 0.25, "median": 0.5, "q3": 0.75}
    placed = placed_values(rows, columns)
    known = placed.where("v is not null")
    missing = placed.where("v is null").select("column", F.col("n").alias("_nulls"))
    total = known.groupBy("column").agg(F.sum("n").alias("_all"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    each = known.join(F.broadcast(total.join(missing, "column", "left")), "column").withColumn("_at", F.col("before") - F.coalesce("_nulls", F.lit(0)))
    holds = lambda p: (p >= F.col("_at")) & (p < F.col("_at") + F.col("n"))
    at = {name: (F.col("_all") - 1) * cut for name, cut in cuts.items()}
    ends = [F.max(F.when(holds(end(p)), F.col("v"))).alias(f"{name}_{side}") for name, p in at.items() for side, end in (("lo", F.floor), ("hi", F.ceil))]
    got = each.groupBy("column").agg(
        F.max("_all").alias("n"),
        F.max("mean").alias("mean"),
        F.sqrt(F.try_divide(F.sum(F.col("n") * (F.col("v") - F.col("mean")) ** 2), F.max("_all") - 1)).alias("std"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        *ends,
    )
    share = {name: (F.col("n") - 1) * cut - F.floor((F.col("n") - 1) * cut) for name, cut in cuts.items()}
    between = [(F.col(f"{q}_lo") + (F.col(f"{q}_hi") - F.col(f"{q}_lo")) * share[q]).alias(q) for q in cuts]
    name = F.get(F.array(*[F.lit(c) for c in columns]), "column")
    return got.select(name.alias("column"), "n", "mean", "std", "least", *between, "most")


#: Columns that are ranked by a broadcast each.
AT_HAND = 8


def average_ranks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The ranks of all columns, row by row and in columns of the same names; equal values share their mean rank.

    Columns whose values are together few get their ranks by broadcasts: some columns one by one, and where these are more than
    AT_HAND all from one, after which a row's ranks meet again by its number, where they have been added up before they are shuffled.  A column of many values is joined by its value, with the row as it is,
    dealt over tasks by the number of rows; so a value that many rows have is only shuffled if its column has many others.
    """
    placed = placed_values(rows, columns)
    ranks = placed.select(F.col("column").alias("_c"), F.col("v").alias("_v"), (F.col("before") + (F.col("n") + 1) / 2).alias("_rank"))
    sizes = {r["_c"]: r["k"] for r in ranks.groupBy("_c").agg(F.count("*").alias("k")).collect()}
    few, room = [], BROADCAST_ROWS
    for i in sorted(sizes, key=sizes.get):
        room -= sizes[i]
        few += [i] if room >= 0 else []
    many = [c for i, c in enumerate(columns) if i not in few]
    out = rows.select(*columns)
    for c in many:
        of = ranks.where(F.col("_c") == columns.index(c)).select("_v", "_rank")
        value = out.withColumn("_value", F.col(c).cast("double"))
        out = spread(value, rows, "_value").join(of, F.col("_value").eqNullSafe(F.col("_v"))).withColumn(c, F.col("_rank")).drop("_value", "_v", "_rank")
    if len(few) <= AT_HAND:
        for c in (columns[i] for i in few):
            of = F.broadcast(ranks.where(F.col("_c") == columns.index(c)).select("_v", "_rank"))
            out = out.join(of, F.col(c).cast("double").eqNullSafe(F.col("_v"))).withColumn(c, F.col("_rank")).drop("_v", "_rank")
        return out
    numbered = out.select(F.monotonically_increasing_id().alias("_row"), *columns)  # before rows are exploded
    names = [columns[i] for i in few]
    each = numbered.select("_row", *many, F.posexplode(F.array(*[F.col(c).cast("double") for c in names])).alias("_at", "v"))
    own = F.get(F.array(*[F.lit(i) for i in few]), "_at")
    told = each.withColumn("column", own).join(F.broadcast(ranks.where(F.col("_c").isin(few))), (F.col("column") == F.col("_c")) & F.col("v").eqNullSafe(F.col("_v")))
    ranked = told.groupBy("_row").agg(*[F.first(c).alias(c) if c in many else F.sum(F.when(F.col("column") == columns.index(c), F.col("_rank"))).alias(c) for c in columns])
    return ranked.drop("_row")


def moments(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """The matrix of sums of products of a leading one and the columns; each task adds up its own, so k * k sums are shuffled."""
    k = len(columns) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(np.nan_to_num(c.cast("double").to_numpy(zero_copy_only=False)) for c in batch.columns)])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["i", "s"])

    sums = rows.select(*columns).mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s"))
    out = np.zeros(k * k)
    for i, s in sums.collect():
        out[i] = s
    return out.reshape(k, k)


#: Values of all columns together, with their ranks, that every task holds.
VALUES_AT_HAND = 4_000_000


def _centred_ranks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The ranks of all columns, less half the number of rows, row by row; equal values share their mean rank.

    Columns whose values are together at hand, those of fewest values first, are looked up in arrays: rows aren't shuffled for them. Each further
    column is joined by its value, dealt by the number of rows; meanwhile the others travel as places in their arrays, of 1, 2 or 4 bytes.
    """
    placed = placed_values(rows, columns)
    half = rows.count() / 2
    ranks = placed.select(F.col("column").alias("_c"), F.col("v").alias("_v"), (F.col("before") + (F.col("n") + 1) / 2 - F.lit(half)).alias("_rank"))
    sizes = {r["_c"]: r["k"] for r in ranks.groupBy("_c").agg(F.count("*").alias("k")).collect()}
    at_hand, room = [], VALUES_AT_HAND
    for i in sorted(sizes, key=sizes.get):
        room -= sizes[i]
        at_hand += [i] if room >= 0 else []
    held: dict[str, tuple[np.ndarray, np.ndarray, bool, np.dtype]] = {}
    if at_hand:
        told = ranks.where(F.col("_c").isin(at_hand)).toArrow()
        where, rank, known = told["_c"].to_numpy(), told["_rank"].to_numpy(), told["_v"].is_valid().to_numpy()
        value = told["_v"].to_numpy()
        order = np.lexsort((value, known, where))  # as Spark orders them: null first, NaN last
        cuts = np.flatnonzero(np.diff(where[order], prepend=-1))
        for own in np.split(order, cuts[1:]):
            nulls = not known[own[0]]
            held[columns[where[own[0]]]] = (value[own[nulls:]], rank[own], nulls, np.dtype(np.min_scalar_type(len(own))))
    few, many = [c for c in columns if c in held], [c for c in columns if c not in held]

    def place(batch: pa.RecordBatch, c: str) -> np.ndarray:
        values, _, nulls, _ = held[c]
        x = batch.column(c).cast(pa.float64())
        at = np.searchsorted(values, x.fill_null(0.0).to_numpy(zero_copy_only=False)) + nulls
        return np.where(x.is_null().to_numpy(zero_copy_only=False), 0, at)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(held[c][1][place(batch, c)]) for c in columns], names=columns)

    kinds = ", ".join(f"`{c}` double" for c in columns)
    if not many:
        return rows.select(*columns).mapInArrow(looked_up, kinds)
    width = sum(held[c][3].itemsize for c in few)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            flat = np.hstack([np.empty((n, 0), np.uint8), *(place(batch, c).astype(held[c][3]).view(np.uint8).reshape(n, -1) for c in few)])
            codes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(pa.float64()) for c in many), codes], names=[*many, "_codes"])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, begin, out = np.frombuffer(b"".join(batch.column("_codes").to_pylist()), np.uint8).reshape(-1, width) if width else None, 0, {}
            for c in few:
                _, rank, _, kind = held[c]
                out[c] = pa.array(rank[np.ascontiguousarray(flat[:, begin : begin + kind.itemsize]).view(kind)[:, 0]])
                begin += kind.itemsize
            yield pa.RecordBatch.from_arrays([out[c] if c in out else batch.column(c) for c in columns], names=columns)

    out = rows.select(*columns).mapInArrow(encoded, ", ".join([*(f"`{c}` double" for c in many), "_codes binary"]))
    for c in many:
        of = ranks.where(F.col("_c") == columns.index(c)).select("_v", "_rank")
        out = spread(out, rows, c).join(of, F.col(c).eqNullSafe(F.col("_v"))).withColumn(c, F.col("_rank")).drop("_v", "_rank")
    return out.mapInArrow(decoded, kinds)


def spearman(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, rho) for each pair of columns, null where one of them never varies."""
    m = moments(_centred_ranks(rows, columns), columns)  # ranks about their middle, so that sums of squares keep their digits
    spread = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / max(m[0, 0], 1)
    sd = np.sqrt(np.clip(np.diag(spread), 0, None))
    made = [(a, b, float(spread[i, j] / (sd[i] * sd[j])) if sd[i] > 1e-9 and sd[j] > 1e-9 else None) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    return rows.sparkSession.createDataFrame(made, "a string, b string, rho double")


def chi_square(observed: DataFrame, count: str = "n") -> DataFrame:
    """(statistic, degrees) against equal counts."""
    mean = observed.agg(F.avg(count).alias("_m"), F.count("*").alias("_k"))
    return observed.crossJoin(F.broadcast(mean)).agg(F.sum((F.col(count) - F.col("_m")) ** 2 / F.col("_m")).alias("statistic"), (F.max("_k") - 1).alias("degrees"))


def contingency(rows: DataFrame, a: Column, b: Column, corrected: bool = True) -> DataFrame:
    """(statistic, odds_ratio) of two yes/no columns; the correction is Yates's."""
    n = rows.agg(F.count_if(a & b).alias("tt"), F.count_if(a & ~b).alias("tf"), F.count_if(~a & b).alias("ft"), F.count_if(~a & ~b).alias("ff"))
    total = F.col("tt") + F.col("tf") + F.col("ft") + F.col("ff")
    det = F.abs(F.col("tt") * F.col("ff") - F.col("tf") * F.col("ft")).cast("double")
    low = F.greatest(det - (total / 2 if corrected else 0), F.lit(0.0))
    sides = ((F.col("tt") + F.col("tf")).cast("double")) * (F.col("ft") + F.col("ff")) * (F.col("tt") + F.col("ft")) * (F.col("tf") + F.col("ff"))
    return n.select((total * low * low / sides).alias("statistic"), F.try_divide((F.col("tt") * F.col("ff")).cast("double"), (F.col("tf") * F.col("ft")).cast("double")).alias("odds_ratio"))


def fisher_p(tt: int, tf: int, ft: int, ff: int) -> float:
    """Two-sided p of Fisher's exact test.

    Probabilities relative to that of the mode follow from each other by ratios,
    outward on both sides until they are negligible beside the observed one, so the work grows with the
    spread of the distribution, the root of the counts, and not with the counts.  A p under
    e^-700 is 0.
    """
    r, c, n = tt + tf, tt + ft, tt + tf + ft + ff
    least, most = max(0, r + c - n), min(r, c)
    mode = min(max((r + 1) * (c + 1) // (n + 2), least), most)

    def outward(step: int, far: int, floor: float | None) -> np.ndarray:
        """Log ratios to the mode, from the value beside it to one of less than `floor`, or than that of the value `far` away."""
        logs, size = np.empty(0), 1 << 12
        while (left := (most - mode if step > 0 else mode - least) - len(logs)) > 0:
            x = mode + step * (len(logs) + np.arange(min(size, left), dtype=np.float64))
            up, down = (r - x) * (c - x) / ((x + 1) * (n - r - c + x + 1)), x * (n - r - c + x) / ((r - x + 1) * (c - x + 1))
            logs = np.concatenate([logs, (logs[-1] if len(logs) else 0.0) + np.cumsum(np.log(up if step > 0 else down))])
            least_of = floor if floor is not None else (logs[far - 1] if far else 0.0) if len(logs) >= far else -math.inf
            if logs[-1] < max(least_of - 45, -745):
                break
            size *= 2
        return logs

    far, side = abs(tt - mode), 1 if tt >= mode else -1
    own = outward(side, far, None)
    observed = 0.0 if not far else float(own[far - 1]) if far <= len(own) else -math.inf
    logs = np.concatenate([[0.0], own, outward(-side, 0, observed)])
    weights = np.exp(logs)
    return float(min(1.0, weights[logs <= observed + 1e-7].sum() / weights.sum()))


def chi_square_p(statistic: float, degrees: int) -> float:
    """Share of a chi-square distribution above a statistic, by the incomplete gamma function."""
    a, x = degrees / 2, statistic / 2
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:  # the series of the lower part
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * lead)
    b = x + 1 - a  # the continued fraction of the upper part
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out * lead


def confusion(rows: DataFrame, truth: Column, guess: Column, count: str | None = None) -> DataFrame:
    """Counts, accuracy, precision, recall and F1 of yes/no columns; `count` names a column that tells how many rows a row stands for."""
    times = lambda c: F.count_if(c) if count is None else F.coalesce(F.sum(F.when(c, F.col(count))), F.lit(0))
    n = rows.agg(times(truth & guess).alias("tp"), times(~truth & guess).alias("fp"), times(truth & ~guess).alias("fn"), times(~truth & ~guess).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return n.select("tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip").transform(rows)


def logit(rows: DataFrame, columns: list[str], label: str) -> np.ndarray:
    """Coefficients of a binomial model, the constant first."""
    if not columns:  # the constant alone fits the share; a label that never varies has the limit that a share next to it would give
        share = min(max(rows.agg(F.avg(label)).first()[0] or 0.0, 1e-12), 1 - 1e-12)
        return np.array([math.log(share / (1 - share))])
    model = GeneralizedLinearRegression(family="binomial", featuresCol="_x", labelCol=label, maxIter=50).fit(assembled(rows, columns))
    return np.concatenate([[model.intercept], model.coefficients.toArray()])


def coefficients(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(term, estimate, std_error, z, p, odds) of a binomial model, the constant last."""
    model = GeneralizedLinearRegression(family="binomial", featuresCol="_x", labelCol=label, maxIter=50).fit(assembled(rows, columns))
    told = model.summary
    values = [*model.coefficients.toArray().tolist(), model.intercept]
    made = [(t, float(v), float(e), float(z), float(p), math.exp(min(v, 700.0))) for t, v, e, z, p in zip([*columns, "const"], values, told.coefficientStandardErrors, told.tValues, told.pValues, strict=True)]
    return rows.sparkSession.createDataFrame(made, "term string, estimate double, std_error double, z double, p double, odds double")


def matching(columns: list[str], patterns: list[str], keep: bool = True) -> list[str]:
    """The columns whose names some pattern matches from their beginning; without keep the others."""
    return [c for c in columns if any(re.match(p, c) for p in patterns) == keep]


def correlation_clusters(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Columns grouped pair by pair: a pair joins every group that has one of its two, else it begins one.

    Groups that a later pair connects stay apart, and both get the pair.
    """
    groups: list[list[str]] = []
    for a, b in pairs:
        hit = [g for g in groups if a in g or b in g]
        for g in hit:
            g += [x for x in (a, b) if x not in g]
        if not hit:
            groups.append([a, b])
    return groups


def influence(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """rows with cooks_distance and residual_z of a logit, and outlier: beyond 4/n and 3."""
    beta = logit(rows, columns, label)
    names = ["_one", *columns]
    fit = rows.withColumn("_one", F.lit(1.0))
    eta = sum((float(b) * F.col(c) for b, c in zip(beta, names, strict=True)), F.lit(0.0))
    fit = fit.withColumn("_mu", 1 / (1 + F.exp(-eta)))
    w = F.col("_mu") * (1 - F.col("_mu"))
    inverse = np.linalg.pinv(moments(fit.select(*[(F.sqrt(w) * F.col(c)).alias(c) for c in names]), names)[1:, 1:])
    kept = fit.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).cast("double").to_numpy(zero_copy_only=False) for c in names])
            mu = batch.column("_mu").to_numpy(zero_copy_only=False)
            lever = np.einsum("ij,jk,ik->i", x, inverse, x) * mu * (1 - mu)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lever, from_pandas=True)], names=[*kept, "_h"])

    schema = T.StructType([*fit.schema, T.StructField("_h", T.DoubleType())])
    fit = fit.mapInArrow(run, schema).withColumn("_r", F.coalesce(F.try_divide(F.col(label) - F.col("_mu"), F.sqrt(w)), F.lit(0.0)))
    mean, sd, n = fit.agg(F.avg("_r"), F.stddev_pop("_r"), F.count("*")).first()
    cook = F.coalesce(F.try_divide(F.col("_r") ** 2 / len(names) * F.col("_h"), (1 - F.col("_h")) ** 2), F.lit(0.0))
    z = (F.col("_r") - F.lit(mean)) / F.lit(sd or 1.0)
    return fit.withColumn("cooks_distance", cook).withColumn("residual_z", z).withColumn("outlier", (cook > 4 / max(n, 1)) & (F.abs(z) > 3)).drop("_one", "_mu", "_h", "_r")


@dataclass(frozen=True)
class MixedModel:
    """Estimates and their standard errors, the variance of rows and that between groups."""

    terms: list[str]
    estimates: np.ndarray
    errors: np.ndarray
    scale: float
    group_variance: float
    rows: int

    def table(self, spark: SparkSession) -> DataFrame:
        """(term, estimate, std_error, z), the two variances last."""
        told = [(t, float(e), float(s), float(e / s) if s else None) for t, e, s in zip(self.terms, self.estimates, self.errors, strict=True)]
        told += [("_scale", self.scale, None, None), ("_group_variance", self.group_variance, None, None)]
        return spark.createDataFrame(told, "term string, estimate double, std_error double, z double")


def random_intercepts(rows: DataFrame, columns: list[str], label: str, group: str, steps: int = 40) -> MixedModel:
    """Linear mixed model with an intercept for each group, no constant, by restricted likelihood.

    All that a variance ratio needs are the sums of products over all rows and, for the groups of each size, the
    sum of the outer products of their sums.  One aggregation by group and one by size give both;
    ratios are then tried on the driver, over the distinct sizes, of which there are at most
    sqrt(2 * rows).
    """
    names, p = [*columns, label], len(columns)
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    value = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names]
    per = rows.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"), F.array(*[F.sum(v) for v in value]).alias("s"), F.array(*[F.sum(value[i] * value[j]) for i, j in pairs]).alias("m"))
    sizes = per.groupBy("n").agg(F.count("*").alias("k"), F.array(*[F.sum(F.col("m")[x]) for x in range(len(pairs))]).alias("m"), F.array(*[F.sum(F.col("s")[i] * F.col("s")[j]) for i, j in pairs]).alias("o")).collect()
    size, groups = np.array([r["n"] for r in sizes], float), np.array([r["k"] for r in sizes], float)

    def square(flat: np.ndarray) -> np.ndarray:
        out = np.zeros((*flat.shape[:-1], p + 1, p + 1))
        for x, (i, j) in enumerate(pairs):
            out[..., i, j] = out[..., j, i] = flat[..., x]
        return out

    total, outer = square(np.array([r["m"] for r in sizes]).sum(0)), square(np.array([r["o"] for r in sizes]))
    n = int((size * groups).sum())

    def at(t: float) -> tuple[float, np.ndarray, float, np.ndarray]:
        m = total - np.tensordot(t / (1 + t * size), outer, 1)
        xx, xy, yy = m[:p, :p], m[:p, p], m[p, p]
        inverse = np.linalg.pinv(xx)
        beta = inverse @ xy
        rss = max(yy - beta @ xy, 1e-12)
        signs = np.linalg.slogdet(xx)[1]
        return (n - p) * math.log(rss / (n - p)) + float(groups @ np.log(1 + t * size)) + signs, beta, rss / (n - p), inverse

    low, high, golden = -8.0, 6.0, (math.sqrt(5) - 1) / 2
    a, b = high - golden * (high - low), low + golden * (high - low)
    fa, fb = at(math.exp(a))[0], at(math.exp(b))[0]
    for _ in range(steps):
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - golden * (high - low)
            fa = at(math.exp(a))[0]
        else:
            low, a, fa = a, b, fb
            b = low + golden * (high - low)
            fb = at(math.exp(b))[0]
    ratio = math.exp((low + high) / 2)
    _, beta, scale, inverse = at(ratio)
    return MixedModel(list(columns), beta, np.sqrt(np.clip(scale * np.diag(inverse), 0, None)), float(scale), float(ratio * scale), n)
