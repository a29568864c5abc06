"""Regression forests: importances, cross-validation, ablation and partial dependence."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ROWS_A_TASK
from .common import shared_path, shared_table
from .stats import assembled, confusion, placed_values, summaries

#: What the models are defined with.
TREES, FOLDS, GRID = 100, 5, 100
DEPTH = 8
#: Forests that are fitted at a time.
AT_ONCE = 4
#: Trees of a counted forest that are fitted at a time, and bins of a column (as many as Spark's forests have).
TREES_AT_ONCE, BINS = 12, 32
#: Trees that grow in one task, and nodes whose sums are shuffled in one row, where forests grow together.
TREES_A_TASK, NODES_A_ROW = 10, 16
#: Rows (of a byte for each column) that a task holds; drawn rows and cells of sums that are handled at a time.
ROWS_AT_ONCE, DRAWN, CELLS = 6_000_000, 1 << 15, 1 << 13


def forest(rows: DataFrame, columns: list[str], label: str, trees: int = TREES, depth: int = DEPTH, seed: int = 42) -> RandomForestRegressionModel:
    """A fitted regression forest over all columns."""
    return RandomForestRegressor(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed).fit(assembled(rows, columns))


def importances(model: RandomForestRegressionModel, columns: list[str], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(columns, model.featureImportances.toArray().tolist(), strict=True)), "column string, importance double").orderBy(F.desc("importance"), "column")


def folded(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(k)))


def nodes(model: RandomForestRegressionModel, spark: SparkSession) -> list[dict[str, np.ndarray]]:
    """Each tree as arrays by node: feature (-1 at a leaf), threshold, left, right, value.

    They are read from the saved model; their number is bounded by trees * 2^(depth + 1), whatever the rows.
    """
    path = shared_path(spark, "forest")
    model.save(path)
    each = spark.read.parquet(f"{path}/data")
    tree = next(c for c in each.columns if c.lower().startswith("tree"))
    told = each.select(F.col(tree).alias("tree"), "nodeData.*").select("tree", "id", "prediction", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")).toPandas()
    out = []
    for _, one in told.sort_values(["tree", "id"]).groupby("tree"):
        leaf = one.leftChild.to_numpy() < 0
        out.append({"feature": np.where(leaf, -1, one.feature.to_numpy()), "threshold": one.threshold.to_numpy(), "left": one.leftChild.to_numpy(), "right": one.rightChild.to_numpy(), "value": one.prediction.to_numpy()})
    return out


@dataclass
class CountedForest:
    """Trees over numbers of bins (`trees`, as nodes() tells them), the lower edges of all bins but the first, and importances."""

    trees: list[dict[str, np.ndarray]]
    edges: list[list[float]]
    weights: np.ndarray

    def unbinned(self) -> list[dict[str, np.ndarray]]:
        """The trees with thresholds between values: a bin up to k has the values below the edge of the next."""
        below = [np.nextafter(np.array([*e, np.inf]), -np.inf) for e in self.edges]
        return [t | {"threshold": np.array([below[f][int(x)] if f >= 0 else x for f, x in zip(t["feature"], t["threshold"], strict=True)])} for t in self.trees]


def bin_edges(rows: DataFrame, columns: list[str], bins: int = BINS) -> list[list[float]]:
    """Per column the least value of each bin but the first: a bin for each value, or bins of equal shares of the rows if there are more values."""
    known = placed_values(rows, columns).where("v is not null and not isnan(v)")
    total = known.groupBy("column").agg(F.sum("n").alias("_all"), F.count("*").alias("_values"), F.min("before").alias("_nulls"))
    share = F.floor((F.col("before") - F.col("_nulls")) * bins / F.col("_all")).cast("double")
    cut = known.join(F.broadcast(total), "column").groupBy("column", F.when(F.col("_values") <= bins, F.col("v")).otherwise(share).alias("bin")).agg(F.min("v").alias("v"))
    out: list[list[float]] = [[] for _ in columns]
    for r in cut.collect():  # at most columns * bins
        out[r["column"]].append(r["v"])
    return [sorted(e)[1:] for e in out]


def binned(rows: DataFrame, columns: list[str], edges: list[list[float]], *more: str) -> DataFrame:
    """(columns as numbers of bins, more).  Rows with a null are left out, as in assembled()."""
    bins = [f"_bin_{c}" for c in columns]
    splits = [[-np.inf, *(e or [np.finfo(float).max]), np.inf] for e in edges]
    told = Bucketizer(splitsArray=splits, inputCols=columns, outputCols=bins, handleInvalid="skip").transform(rows)
    return told.select(*[F.col(b).alias(c) for b, c in zip(bins, columns, strict=True)], *more)


def counted(rows: DataFrame, columns: list[str], label: str, edges: list[list[float]], *more: str) -> DataFrame:
    """(columns as numbers of bins, label, more, n): how many rows are alike to a tree."""
    return shared_table(binned(rows, columns, edges, label, *more).groupBy(*columns, label, *more).agg(F.count("*").alias("n")), "counted")


def _drawn(groups: DataFrame, columns: list[str], label: str, trees: int, seed: int) -> DataFrame:
    """groups with w0, w1, ...: how many rows of a group the bootstrap of each tree has.

    A bootstrap takes each row a Poisson(1) number of times, so Poisson(n) times n rows. The group seeds its draws: reruns agree.
    """
    names = [*columns, label]
    seeded = groups.select(*[F.col(c).cast("double").alias(c) for c in names], F.col("n").cast("long").alias("n"), F.xxhash64(F.lit(seed), *names).alias("_seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, n, seeds = batch.columns
            drawn = [np.random.default_rng(s & (1 << 64) - 1).poisson(k, trees) for s, k in zip(seeds.to_pylist(), n.to_pylist(), strict=True)]
            w = np.array(drawn, np.float64).reshape(-1, trees)
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(w[:, t]) for t in range(trees)]], names=[*names, *[f"w{t}" for t in range(trees)]])

    return shared_table(seeded.mapInArrow(run, ", ".join(f"`{c}` double" for c in [*names, *[f"w{t}" for t in range(trees)]])), "drawn")


def _told(model: DecisionTreeRegressionModel) -> dict[str, np.ndarray]:
    """A tree as arrays by node in order of depth first, from its text: a node, its left side, `Else`, its right side."""
    feature, threshold, left, right, value, open_nodes = [], [], [], [], [], []
    for line in model.toDebugString.splitlines():
        line = line.strip()
        if line.startswith("Else"):
            right[open_nodes.pop()] = len(feature)
        elif got := re.match(r"If \(feature (\d+) <= (.+)\)|Predict: (.+)", line):
            if got[3] is None:
                open_nodes.append(len(feature))
            inner = got[3] is None
            left.append(len(feature) + 1 if inner else -1)
            right.append(-1)
            feature.append(int(got[1]) if inner else -1)
            threshold.append(float(got[2]) if inner else 0.0)
            value.append(0.0 if inner else float(got[3]))
    return {k: np.array(v) for k, v in (("feature", feature), ("threshold", threshold), ("left", left), ("right", right), ("value", value))}


def counted_forest(groups: DataFrame, columns: list[str], label: str, edges: list[list[float]], trees: int = TREES, depth: int = DEPTH, seed: int = 42) -> CountedForest:
    """A forest over counts of alike rows: its work grows with the combinations of bins, of which there is a bound, and not with the rows.

    It is for few columns; of many there are as many combinations as rows, and forest() has less to do.
    """
    drawn = _drawn(groups, columns, label, trees, seed)
    x = assembled(drawn.coalesce(-(-drawn.observed_rows // ROWS_A_TASK) or 1), columns)

    def one(t: int) -> DecisionTreeRegressionModel:
        own = x.select("_x", label, f"w{t}").where(F.col(f"w{t}") > 0)
        return DecisionTreeRegressor(featuresCol="_x", labelCol=label, weightCol=f"w{t}", maxDepth=depth, maxBins=BINS, seed=seed + t).fit(own)

    with ThreadPoolExecutor(TREES_AT_ONCE) as pool:
        made = list(pool.map(one, range(trees)))
    weights = sum(m.featureImportances.toArray() for m in made)
    return CountedForest([_told(m) for m in made], edges, weights / max(weights.sum(), 1e-300))


def counted_importances(model: CountedForest, columns: list[str], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(columns, model.weights.tolist(), strict=True)), "column string, importance double").orderBy(F.desc("importance"), "column")


def counted_predictions(model: CountedForest, groups: DataFrame, columns: list[str]) -> DataFrame:
    """groups with their prediction."""
    return _predicted(model.trees, groups, columns)


def _predicted(trees: list[dict[str, np.ndarray]], groups: DataFrame, columns: list[str]) -> DataFrame:
    names = groups.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, every = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]), np.arange(batch.num_rows)
            total = np.zeros(batch.num_rows)
            for tree in trees:
                at = np.zeros(batch.num_rows, np.int64)
                while (inner := tree["feature"][at] >= 0).any():
                    goes_left = x[every, tree["feature"][at]] <= tree["threshold"][at]
                    at = np.where(inner, np.where(goes_left, tree["left"][at], tree["right"][at]), at)
                total += tree["value"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total / len(trees))], names=[*names, "prediction"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema)
    return groups.mapInArrow(run, f"{kinds}, prediction double")


def _packed(parts: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Binned rows (columns, label, fold, _seed) as arrays of many rows each; bins go row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *x, y, fold, seed = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            made = [np.array(x, np.uint8).T.tobytes(), y.astype(np.float64).tobytes(), fold.astype(np.int64).tobytes(), seed.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.binary()) for m in made], names=["x", "y", "fold", "seed"])

    return shared_table(parts.select(*columns, label, "fold", "_seed").mapInArrow(run, "x binary, y binary, fold binary, seed binary"), "packed")


def _draws(seed: np.ndarray, stem: int) -> np.ndarray:
    """How many times a bootstrap takes each row, Poisson(1), from the row's seed and the tree's number: reruns and other partitions agree."""
    z = seed.view(np.uint64) + np.uint64((stem + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    at_most = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(18)])
    return np.searchsorted(at_most, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, side="right").astype(np.float64)


#: The splits of a level: the node that is split, where, for which lists of columns (as bits), and the means of both sides.
_SPLITS = ("node", "feature", "bin", "lists", "left", "right")


def _reached(levels: list[dict[str, np.ndarray]], x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, node of the last level): a row goes on by each split of its node; split j leads to nodes 2 * j and 2 * j + 1."""
    node = np.zeros(len(rows), np.int64)
    for level in levels:
        first = np.searchsorted(level["node"], node)
        times = np.searchsorted(level["node"], node, side="right") - first
        split = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        rows = np.repeat(rows, times)
        node = 2 * split + (x[rows, level["feature"][split]] > level["bin"][split])
    return rows, node


def _totals(x: np.ndarray, rows: np.ndarray, node: np.ndarray, w: np.ndarray, y: np.ndarray, n: int, sizes: list[int]) -> np.ndarray:
    """Sums of weights and of weighted labels by column, node and bin; `sizes` are the numbers of bins.

    Columns of few bins are added up together, by all their bins at once, and told apart afterwards. Where labels are 0 or 1, both sums are
    parts of one number: weights are whole, so they stay exact.
    """
    whole = bool(((y == 0) | (y == 1)).all()) and w.sum() < 1 << 26
    weights = [w * (1 << 26) + w * y] if whole else [w, w * y]
    groups, product = [], CELLS
    for f in sorted(range(x.shape[1]), key=lambda f: sizes[f]):
        if groups and n * product * sizes[f] <= CELLS:
            groups[-1].append(f)
            product *= sizes[f]
        else:
            groups.append([f])
            product = sizes[f]
    shapes = [(n, *(sizes[f] for f in own)) for own in groups]
    sums = [[np.zeros(math.prod(shape)) for shape in shapes] for _ in weights]
    for begin in range(0, len(rows), DRAWN):
        some, at = rows[begin : begin + DRAWN], node[begin : begin + DRAWN]
        drawn, bins = [v[some] for v in weights], x[some]  # a row's bins lie together
        for g, own in enumerate(groups):
            where = at
            for f in own:
                where = where * sizes[f] + bins[:, f]
            for i, v in enumerate(drawn):
                sums[i][g] += np.bincount(where, v, len(sums[i][g]))
    out = np.zeros((2, x.shape[1], n, BINS))
    for i, of in enumerate(sums):
        for own, shape, flat in zip(groups, shapes, of, strict=True):
            for k, f in enumerate(own):
                out[i, f, :, : sizes[f]] = flat.reshape(shape).sum(tuple(a for a in range(1, len(shape)) if a != k + 1))
    if whole:
        out[1] = out[0] % (1 << 26)
        out[0] = np.floor(out[0] / (1 << 26))
    return out


def _best(totals: np.ndarray, lists: np.ndarray, named: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The splits that lessen the squared error most, for each list of columns that comes to a node; lists with the same split share it."""
    (w, s), (below_w, below_s) = totals.sum(3)[:, 0], totals.cumsum(3)
    with np.errstate(all="ignore"):
        whole = (s**2 / w)[:, None]
        gain = below_s**2 / below_w + (s[:, None] - below_s) ** 2 / (w[:, None] - below_w) - whole
        gain[(below_w <= 0) | (below_w >= w[:, None]) | ~(gain > 1e-12 * whole)] = -np.inf
    at, gain, every = gain.argmax(2), gain.max(2), np.arange(len(lists))
    found = [np.empty((0, 2), np.int64)]
    for i, own in enumerate(named):
        if len(own):
            f = own[gain[own].argmax(0)]
            n = np.flatnonzero((lists >> i & 1 > 0) & (gain[f, every] > -np.inf))
            found.append(np.column_stack([(n * len(at) + f[n]) * BINS + at[f[n], n], np.full(len(n), 1 << i)]))
    keys, back = np.unique(np.concatenate(found)[:, 0], return_inverse=True)
    shared = np.zeros(len(keys), np.int64)
    np.bitwise_or.at(shared, back, np.concatenate(found)[:, 1])
    node, f, b = keys // BINS // len(at), keys // BINS % len(at), keys % BINS
    left_w, left_s = below_w[f, node, b], below_s[f, node, b]
    return dict(zip(_SPLITS, (node, f, b, shared, left_s / left_w, (s[node] - left_s) / (w[node] - left_w)), strict=True))


def _held(batches: Iterator[pa.RecordBatch], columns: int, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(id, bins, labels, folds, seeds) of all packed rows, `most` at most."""
    x, y, fold, seed = np.empty((most, columns), np.uint8), np.empty(most), np.empty(most, np.uint8), np.empty(most, np.int64)
    end, number = 0, None
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in ("id", "x", "y", "fold", "seed")}
            number, begin, end = r["id"], end, end + len(r["y"]) // 8
            x[begin:end] = np.frombuffer(r["x"], np.uint8).reshape(-1, columns)
            y[begin:end], fold[begin:end], seed[begin:end] = (np.frombuffer(r[c], t) for c, t in (("y", np.float64), ("fold", np.int64), ("seed", np.int64)))
    return None if number is None else (number, x[:end], y[:end], fold[:end], seed[:end])


def _grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, named: list[np.ndarray], depth: int, sizes: list[int]) -> tuple[float, list[dict[str, np.ndarray]]]:
    """(mean, levels of splits) of one tree: of the two sides of a split the smaller one is added up, the other is the rest of the node."""
    parts, lists = [np.flatnonzero(w)], np.array([(1 << len(named)) - 1])
    exact = bool(((y == 0) | (y == 1)).all())

    def added(some: list[np.ndarray]) -> np.ndarray:
        return _totals(x, np.concatenate(some), np.repeat(np.arange(len(some)), [len(r) for r in some]), w, y, len(some), sizes)

    totals = added(parts)
    all_w, all_s = totals[:, 0, 0].sum(1)
    levels: list[dict[str, np.ndarray]] = []
    for level in range(depth):
        best = _best(totals, lists, named)
        if not len(best["node"]):
            break
        levels.append(best)
        if level == depth - 1:
            break
        sides = []
        for node, f, b in zip(best["node"], best["feature"], best["bin"], strict=True):
            right = x[parts[node], f] > b
            sides += [parts[node][~right], parts[node][right]]
        lists = np.repeat(best["lists"], 2)
        if exact:
            lesser = np.array([2 * j + (len(sides[2 * j]) > len(sides[2 * j + 1])) for j in range(len(best["node"]))])
            own = added([sides[i] for i in lesser])
            whole, totals = totals[:, :, best["node"]], np.empty((2, x.shape[1], len(sides), BINS))
            totals[:, :, lesser], totals[:, :, lesser ^ 1] = own, whole - own
        else:
            totals = added(sides)
        parts = sides
    return float(all_s / max(all_w, 1)), levels


def grown(parts: DataFrame, columns: list[str], label: str, named: list[np.ndarray], folds: int, trees: int, depth: int = DEPTH) -> list[tuple[float, list[dict[str, np.ndarray]]]]:
    """(mean, levels of splits) of `trees` trees for each fold left out, over binned rows (columns, label, fold, _seed).

    A tree is that of all lists of columns (`named`, places in columns) at once: lists have the same draws, so they share each node
    up to where their best splits differ.  A task grows some trees over all rows, if these are ROWS_AT_ONCE at most.  Of more, a level is
    a job: tasks of some trees and a block of rows each sum up labels by node, column and bin, and sums of several blocks are added by a
    shuffle.  Trees come to the driver, as many nodes as they have.
    """
    spark, blocks = parts.sparkSession, -(-parts.observed_rows // ROWS_AT_ONCE) or 1
    packed, most, every = _packed(parts, columns, label), parts.observed_rows, (1 << len(named)) - 1
    key = [("stem", pa.int64()), ("first", pa.int64())]
    kinds = pa.schema([*key, ("mean", pa.float64()), *[(c, pa.list_(pa.float64() if c in ("left", "right") else pa.int64())) for c in _SPLITS]])
    told_kinds = "stem long, first long, mean double, " + ", ".join(f"{c} array<{'double' if c in ('left', 'right') else 'long'}>" for c in _SPLITS)

    def dealt(tasks: int, rows: DataFrame) -> DataFrame:
        return spark.range(0, tasks, 1, tasks).crossJoin(rows.hint("shuffle_replicate_nl"))

    def sizes_of(x: np.ndarray) -> list[int]:
        return (x.max(0).astype(int) + 1).tolist() if len(x) else [1] * len(columns)

    if blocks == 1:

        def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if (held := _held(batches, len(columns), most)) is None:
                return
            number, x, y, fold, seed = held
            sizes = sizes_of(x)
            for stem in range(number * TREES_A_TASK, min((number + 1) * TREES_A_TASK, folds * trees)):
                mean, levels = _grown(x, y, np.where(fold == stem // trees, 0.0, _draws(seed, stem)), named, depth, sizes)
                for first, level in enumerate(levels or [{c: np.empty(0, np.int64) for c in _SPLITS}]):
                    yield pa.RecordBatch.from_pydict({"stem": [stem], "first": [first], "mean": [mean], **{c: [v] for c, v in level.items()}}, kinds)

        means, levels = [0.0] * (folds * trees), [[] for _ in range(folds * trees)]
        got = dealt(-(-folds * trees // TREES_A_TASK), packed.coalesce(1)).mapInArrow(planted, told_kinds).toArrow().sort_by([("stem", "ascending"), ("first", "ascending")]).combine_chunks()
        for i, (stem, mean) in enumerate(zip(got["stem"].to_pylist(), got["mean"].to_pylist(), strict=True)):
            means[stem], level = mean, {c: got[c][i].values.to_numpy() for c in _SPLITS}
            if len(level["node"]):
                levels[stem].append(level)
        return list(zip(means, levels, strict=True))

    packed = packed.coalesce(blocks)
    means, levels = [0.0] * (folds * trees), [[] for _ in range(folds * trees)]
    came = lambda stem: np.repeat(levels[stem][-1]["lists"], 2) if levels[stem] else np.array([every])

    def told(stem: int, first: int, totals: np.ndarray) -> pa.RecordBatch:
        best = _best(totals, came(stem)[first : first + totals.shape[2]], named)
        w, s = totals[:, 0, 0].sum(1)
        return pa.RecordBatch.from_pydict({"stem": [stem], "first": [first], "mean": [float(s / max(w, 1))], **{c: [v] for c, v in best.items()}}, kinds)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (held := _held(batches, len(columns), most)) is None:
            return
        number, x, y, fold, seed = held
        sizes = sizes_of(x)
        for stem in growing[number * TREES_A_TASK :][:TREES_A_TASK]:
            w, n = np.where(fold == stem // trees, 0.0, _draws(seed, stem)), len(came(stem))
            totals = _totals(x, *_reached(levels[stem], x, np.flatnonzero(w)), w, y, n, sizes)
            for first in range(0, n, NODES_A_ROW):
                yield pa.RecordBatch.from_pydict({"stem": [stem], "first": [first], "totals": [totals[:, :, first : first + NODES_A_ROW].tobytes()]}, sums)

    def merged(table: pa.Table) -> pa.Table:
        totals = sum(np.frombuffer(t, np.float64) for t in table["totals"].to_pylist())
        return pa.Table.from_batches([told(table["stem"][0].as_py(), table["first"][0].as_py(), totals.reshape(2, len(columns), -1, BINS))])

    sums = pa.schema([*key, ("totals", pa.binary())])
    growing = list(range(folds * trees))
    for _ in range(depth):
        made = dealt(-(-len(growing) // TREES_A_TASK), packed).mapInArrow(summed, "stem long, first long, totals binary").groupBy("stem", "first").applyInArrow(merged, told_kinds)
        got, next_splits = made.toArrow().sort_by([("stem", "ascending"), ("first", "ascending")]).combine_chunks(), {}
        for i, (stem, first) in enumerate(zip(got["stem"].to_pylist(), got["first"].to_pylist(), strict=True)):
            level = {c: got[c][i].values.to_numpy() for c in _SPLITS}
            next_splits.setdefault(stem, []).append(level | {"node": level["node"] + first})
            if not levels[stem] and first == 0:
                means[stem] = got["mean"][i].as_py()
        growing = []
        for stem, some in next_splits.items():
            if any(len(level["node"]) for level in some):
                growing.append(stem)
                levels[stem].append({c: np.concatenate([level[c] for level in some]) for c in _SPLITS})
        if not growing:
            break
    return list(zip(means, levels, strict=True))


def _tree_of(mean: float, levels: list[dict[str, np.ndarray]], which: int) -> dict[str, np.ndarray]:
    """The tree of one list of columns, as arrays by node."""
    mine = [np.flatnonzero(level["lists"] >> which & 1) for level in levels]
    size = 1 + 2 * sum(map(len, mine))
    out = {"feature": np.full(size, -1), "threshold": np.zeros(size), "left": np.full(size, -1), "right": np.full(size, -1), "value": np.full(size, mean)}
    number, free = np.zeros(1, np.int64), 1
    for level, own in zip(levels, mine, strict=True):
        at, left = number[level["node"][own]], free + 2 * np.arange(len(own))
        for c, v in (("feature", level["feature"][own]), ("threshold", level["bin"][own]), ("left", left), ("right", left + 1)):
            out[c][at] = v
        out["value"][left], out["value"][left + 1] = level["left"][own], level["right"][own]
        number = np.full(2 * len(level["node"]), -1)
        number[2 * own], number[2 * own + 1] = left, left + 1
        free += 2 * len(own)
    return out


def cross_validated(rows: DataFrame, columns: list[str] | dict[str, list[str]], label: str, key: str, k: int = FOLDS, trees: int = TREES, seed: int = 42) -> DataFrame:
    """(fold, accuracy, precision, recall, f1) of forests that each leave one fold out; with several lists of columns also (columns), the name of the list.

    All forests grow together, so rows are read once a level and not once for each forest and level.
    """
    named = columns if isinstance(columns, dict) else {"all": columns}
    if len(named) > 62:
        raise ValueError(f"{len(named)} lists of columns are too many to share trees; 62 at most")
    every = list(dict.fromkeys(c for some in named.values() for c in some))
    edges = bin_edges(rows, every)
    parts = shared_table(binned(folded(rows, key, k).withColumn("_seed", F.xxhash64(F.lit(seed), key)), every, edges, label, "fold", "_seed"), "folds")
    stems = grown(parts, every, label, [np.array([every.index(c) for c in some], np.int64) for some in named.values()], k, trees)

    def one(task: tuple[int, int]) -> tuple:
        which, i = task
        told = _predicted([_tree_of(*stem, which) for stem in stems[i * trees :][:trees]], parts.where(F.col("fold") == i), every)
        got = confusion(told, F.col(label) >= 0.5, F.col("prediction") >= 0.5).first()
        return (list(named)[which], i, got["accuracy"], got["precision"], got["recall"], got["f1"])

    with ThreadPoolExecutor(AT_ONCE) as pool:
        made = list(pool.map(one, [(which, i) for which in range(len(named)) for i in range(k)]))
    out = rows.sparkSession.createDataFrame(made, "columns string, fold int, accuracy double, precision double, recall double, f1 double")
    return out if isinstance(columns, dict) else out.drop("columns")


def counted_cross_validated(rows: DataFrame, columns: list[str], label: str, key: str, k: int = FOLDS, trees: int = TREES) -> DataFrame:
    """cross_validated() with counted forests: rows are read for the bins and for the counts, and no more."""
    edges = bin_edges(rows, columns)
    parts = counted(folded(rows, key, k), columns, label, edges, "fold")

    def one(i: int) -> tuple:
        seen = parts.where(F.col("fold") != i).groupBy(*columns, label).agg(F.sum("n").alias("n"))
        told = counted_predictions(counted_forest(seen, columns, label, edges, trees, seed=42 + i), parts.where(F.col("fold") == i), columns)
        got = confusion(told, F.col(label) >= 0.5, F.col("prediction") >= 0.5, "n").first()
        return (i, got["accuracy"], got["precision"], got["recall"], got["f1"])

    return rows.sparkSession.createDataFrame([one(i) for i in range(k)], "fold int, accuracy double, precision double, recall double, f1 double")


def _walk(tree: dict[str, np.ndarray], x: np.ndarray, n: np.ndarray, covers: np.ndarray) -> None:
    """Adds to covers[feature, leaf] the rows (n of each kind) that come to a leaf if that feature may have any value.

    A row goes its own way; at a split it also goes the other way, from where on the split's
    feature is the one that is free, if none was.
    """
    free_all = -1
    todo = [(0, np.arange(len(x)), np.full(len(x), free_all))]
    while todo:
        node, rows, free = todo.pop()
        if not len(rows):
            continue
        feature = tree["feature"][node]
        if feature < 0:
            turned = free != free_all
            covers[:, node] += np.bincount(free[turned], n[rows[turned]], len(covers)).astype(np.int64) + n[rows[~turned]].sum()
            continue
        goes_left = x[rows, feature] <= tree["threshold"][node]
        for child, own in ((tree["left"][node], goes_left), (tree["right"][node], ~goes_left)):
            turned = ~own & ((free == free_all) | (free == feature))
            todo.append((child, np.concatenate([rows[own], rows[turned]]), np.concatenate([free[own], np.full(int(turned.sum()), feature)])))


def _ranges(tree: dict[str, np.ndarray], features: int) -> tuple[np.ndarray, np.ndarray]:
    """(above, up to) of each feature at each node."""
    low, high = np.full((features, len(tree["feature"])), -np.inf), np.full((features, len(tree["feature"])), np.inf)
    for node, feature in enumerate(tree["feature"]):  # a node comes before its children
        if feature >= 0:
            left, right, t = tree["left"][node], tree["right"][node], tree["threshold"][node]
            for child in (left, right):
                low[:, child], high[:, child] = low[:, node], high[:, node]
            high[feature, left] = min(high[feature, left], t)
            low[feature, right] = max(low[feature, right], t)
    return low, high


def grids(rows: DataFrame, columns: list[str], points: int = GRID) -> dict[str, np.ndarray]:
    """Per column its values, if they are fewer than `points`, else as many equal steps from the 1st to the 99th percentile."""
    ends = {r["column"]: (r["lo"], r["hi"]) for r in summaries(rows, columns, {"lo": 0.01, "hi": 0.99}).collect()}
    values = placed_values(rows, columns).where("v is not null")
    few = values.groupBy("column").agg(F.count("*").alias("k")).where(F.col("k") < points).select("column")
    known: dict[int, list[float]] = {}
    for r in values.join(F.broadcast(few), "column").select("column", "v").collect():
        known.setdefault(r["column"], []).append(r["v"])
    return {c: np.array(sorted(known[i])) if i in known else np.linspace(*ends[c], points) for i, c in enumerate(columns) if c in ends}


def _covers(trees: list[dict[str, np.ndarray]], rows: DataFrame, columns: list[str]) -> np.ndarray:
    """covers[feature, leaf] of all trees' nodes one after another; rows may be counts (n) of equal rows."""
    starts, k = np.concatenate([[0], np.cumsum([len(t["feature"]) for t in trees])]), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covers = np.zeros((k, starts[-1]), np.int64)
        for batch in batches:
            *own, n = (c.cast("double").to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.column_stack(own)
            whole = ~np.isnan(x).any(1)
            for tree, begin, end in zip(trees, starts, starts[1:], strict=False):
                _walk(tree, x[whole], n[whole].astype(np.int64), covers[:, begin:end])
        at = np.flatnonzero(covers)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(covers.ravel()[at])], names=["i", "n"])

    n = F.col("n") if "n" in rows.columns and "n" not in columns else F.lit(1)
    got = rows.select(*columns, n.cast("long").alias("_n")).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
    covers = np.zeros(k * int(starts[-1]))
    for i, n in got.collect():  # as many as leaves and columns
        covers[i] = n
    return covers.reshape(k, -1)


def _means(trees: list[dict[str, np.ndarray]], covers: np.ndarray, at: dict[str, np.ndarray], columns: list[str], spark: SparkSession) -> DataFrame:
    bounds = [_ranges(t, len(columns)) for t in trees]
    low, high = (np.concatenate([b[x] for b in bounds], 1) for x in (0, 1))
    value, leaf = np.concatenate([t["value"] for t in trees]), np.concatenate([t["feature"] for t in trees]) < 0
    made = []
    for c, grid in at.items():
        i = columns.index(c)
        weight = np.where(leaf, covers[i] * value, 0.0)
        for v in grid.tolist():
            inside = (v > low[i]) & (v <= high[i]) & leaf
            made.append((c, float(v), float(weight[inside].sum() / max(covers[i][inside].sum(), 1))))
    return spark.createDataFrame(made, "column string, value double, mean_prediction double")


def partial_dependence(model: RandomForestRegressionModel, rows: DataFrame, columns: list[str], points: int = GRID) -> DataFrame:
    """(column, value, mean_prediction): the mean prediction if a column had a value in all rows, for all columns.

    Rows are read once and never copied: each row passes through each tree once, with one feature free
    at a time, and adds to the covers of the leaves that it can reach; the mean at a value is the
    sum of the leaves there, weighted by their covers.
    """
    trees = nodes(model, rows.sparkSession)
    some = rows.select(*columns)
    return _means(trees, _covers(trees, some, columns), grids(rows, columns, points), columns, rows.sparkSession)


def counted_partial_dependence(model: CountedForest, groups: DataFrame, rows: DataFrame, columns: list[str], points: int = GRID) -> DataFrame:
    """partial_dependence() of a counted forest: counts of alike rows pass through its trees, and rows are read for the values only."""
    return _means(model.unbinned(), _covers(model.trees, groups, columns), grids(rows, columns, points), columns, rows.sparkSession)
