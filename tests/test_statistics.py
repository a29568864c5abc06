"""Statistics and models against numpy, dense matrices and versions that do all the work."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import common, forests, stats


def full_fisher(tt, tf, ft, ff):
    r, c, n = tt + tf, tt + ft, tt + tf + ft + ff
    p = {x: math.comb(c, x) * math.comb(n - c, r - x) for x in range(max(0, r + c - n), min(r, c) + 1)}
    return sum(q for q in p.values() if q * 10**9 <= p[tt] * (10**9 + 100)) / math.comb(n, r)


def test_fisher_equals_the_full_sum():
    rng = random.Random(3)
    tables = [(3, 1, 1, 3), (0, 0, 0, 0), (5, 0, 0, 5), (0, 9, 9, 0), (1, 0, 0, 0), (0, 3, 0, 4), (900, 3000, 2000, 4000), (10, 4000, 4000, 10), (0, 700, 900, 0)]
    tables += [tuple(rng.randrange(60) for _ in range(4)) for _ in range(120)]
    for t in tables:
        assert stats.fisher_p(*t) == pytest.approx(full_fisher(*t), rel=1e-8, abs=1e-300)


def test_fisher_of_large_counts():
    began = time.perf_counter()
    for _ in range(10):
        p = stats.fisher_p(250_010_000, 249_990_000, 249_990_000, 250_010_000)
    assert (time.perf_counter() - began) / 10 < 0.05
    z = 40_000 * math.sqrt(1e9) / 1e9  # close to a normal distribution at such counts
    assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)
    assert stats.fisher_p(500_000_000, 0, 0, 500_000_000) == 0.0


def table_of(spark, x, names, **more):
    extra = list(more.items())
    rows = [(*map(lambda v: None if v is None else float(v), r), *(v[i].item() for _, v in extra)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + "".join(f", {k} {'long' if v.dtype.kind == 'i' else 'double'}" for k, v in extra))


@pytest.mark.parametrize("most", [200_000, 0])
def test_all_columns_at_once(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "BROADCAST_ROWS", most)  # 0: counts are ordered by ranges
    rng = np.random.default_rng(2)
    x = np.c_[rng.integers(0, 5, 300), rng.normal(size=300).round(1), np.full(300, 7.0), rng.exponential(size=300)]
    names = ["a", "b", "c", "d"]
    df = table_of(spark, x, names)
    ranks = np.array([[(np.sum(col < v) + (np.sum(col == v) + 1) / 2) for v in col] for col in x.T]).T
    got = {(r.a, r.b): r.rho for r in stats.spearman(df, names).collect()}
    assert len(got) == 6
    for i, a in enumerate(names):
        for j in range(i + 1, 4):
            rho = got[a, names[j]]
            assert rho is None if "c" in (a, names[j]) else rho == pytest.approx(np.corrcoef(ranks[:, i], ranks[:, j])[0, 1], abs=1e-9)
    told = {r["column"]: r for r in stats.summaries(df, names, {"q1": 0.25, "p99": 0.99}).collect()}
    for i, a in enumerate(names):
        want = [300, x[:, i].mean(), x[:, i].std(ddof=1), x[:, i].min(), *np.quantile(x[:, i], [0.25, 0.99]), x[:, i].max()]
        assert np.allclose([told[a][c] for c in ("n", "mean", "std", "least", "q1", "p99", "most")], want)


def test_summaries_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None), (2.0, None)], "a double, b double")
    got = stats.summaries(df, ["a", "b"]).collect()
    assert [(r["column"], r["n"], r["mean"], r["median"], r["least"], r["most"]) for r in got] == [("a", 3, 2.0, 2.0, 1.0, 3.0)]
    assert stats.summaries(df.limit(0), ["a", "b"]).count() == 0


def test_mixed_model_equals_dense_reml(spark):
    rng = np.random.default_rng(4)
    n, sizes = 400, [1, 1, 1, 5, 5, 20, 30, 60, 60, 217]
    g = np.repeat(np.arange(len(sizes)), sizes)
    x = np.c_[rng.normal(size=(n, 2)), rng.uniform(size=n)]
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=len(sizes))[g] * 0.8 + rng.normal(size=n)
    df = table_of(spark, x, ["x0", "x1", "x2"], y=y, g=g)
    fit = stats.random_intercepts(df, ["x0", "x1", "x2"], "y", "g")
    z = (g[:, None] == np.arange(len(sizes))).astype(float)

    def reml(t):
        v = np.eye(n) + t * z @ z.T
        inverse = np.linalg.inv(v)
        xx = x.T @ inverse @ x
        beta = np.linalg.solve(xx, x.T @ inverse @ y)
        rss = (y - x @ beta) @ inverse @ (y - x @ beta)
        return (n - 3) * math.log(rss / (n - 3)) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1], beta, rss / (n - 3), xx

    ratio = fit.group_variance / fit.scale
    value, beta, scale, xx = reml(ratio)
    assert np.allclose(fit.estimates, beta, atol=1e-9) and fit.scale == pytest.approx(scale, abs=1e-9)
    assert np.allclose(fit.errors, np.sqrt(scale * np.diag(np.linalg.inv(xx))), atol=1e-9)
    assert all(value <= reml(ratio * k)[0] for k in (0.5, 0.9, 1.1, 2.0))
    assert fit.rows == n


def test_partial_dependence_equals_exploded_rows(spark):
    rng = np.random.default_rng(5)
    x = np.c_[rng.integers(0, 9, 500), rng.normal(size=500), rng.normal(size=500)]
    x[:, 2] = x[:, 1] + x[:, 2] / 3
    y = (x[:, 0] > 4) * x[:, 1] + np.sin(x[:, 2])
    names = ["a", "b", "c"]
    df = table_of(spark, x, names, y=y)
    model = forests.forest(df, names, "y", trees=6, depth=5)
    got = {c: {} for c in names}
    for r in forests.partial_dependence(model, df, names, points=12).collect():
        got[r["column"]][r["value"]] = r["mean_prediction"]
    assert sorted(got["a"]) == list(range(9)) and len(got["b"]) == len(got["c"]) == 12
    assert np.allclose(sorted(got["b"]), np.linspace(*np.quantile(x[:, 1], [0.01, 0.99]), 12))
    for c in names:
        spread = df.withColumn("v", F.explode(F.array(*[F.lit(float(v)) for v in got[c]]))).withColumn(c, F.col("v"))
        for r in model.transform(stats.assembled(spread, names)).groupBy("v").agg(F.avg("prediction").alias("m")).collect():
            assert got[c][r["v"]] == pytest.approx(r["m"], abs=1e-9)


def test_ranks_of_many_and_few_values(spark, monkeypatch):
    """Columns of many values are joined row by row, and those of few values exploded only if there are many such columns; ranks equal those by counting, nulls and ties included."""
    rng = np.random.default_rng(9)
    x = np.c_[rng.integers(0, 5, 600), rng.integers(0, 200, 600), rng.normal(size=600)]
    df = table_of(spark, x, ["few", "some", "many"]).withColumn("some", F.when(F.col("some") > 20, F.col("some")))
    monkeypatch.setattr(stats, "BROADCAST_ROWS", 50)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 50)
    monkeypatch.setattr(common, "ROWS_A_TASK", 100)
    v = np.where(np.isin(np.arange(3), [1]) & (x <= 20), -1.0, x)
    want = np.column_stack([(v[:, [j]] > v[:, j]).sum(1) + ((v[:, [j]] == v[:, j]).sum(1) + 1) / 2 for j in range(3)])
    for at_hand, exploded in ((0, 1), (8, 0)):
        monkeypatch.setattr(stats, "AT_HAND", at_hand)
        ranked = stats.average_ranks(df, ["few", "some", "many"])
        assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, want.tolist()))
        assert ranked._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == exploded


def test_rows_are_not_shuffled_for_ranks_at_hand(spark, monkeypatch):
    """Ranks of values at hand need no exchange; columns of more values travel with codes of the others; nulls, NaN, zeros of both signs and ties included."""
    rng = np.random.default_rng(10)
    x = np.c_[rng.integers(0, 5, 700), rng.integers(0, 300, 700), rng.normal(size=700), rng.integers(-1, 2, 700) * 0.0, rng.integers(0, 3, 700)]
    x[:40, 4] = np.nan
    names = ["few", "some", "many", "zero", "odd"]
    df = table_of(spark, x, names).withColumn("some", F.when(F.col("some") > 20, F.col("some"))).withColumn("few", F.col("few").cast("int"))
    v = x.copy()
    v[x[:, 1] <= 20, 1], v[:40, 4] = -1.0, np.inf
    want = np.column_stack([(v[:, [j]] > v[:, j]).sum(1) + ((v[:, [j]] == v[:, j]).sum(1) + 1) / 2 for j in range(5)]) - 350
    for room, joins in ((10_000, 0), (400, 1), (5, 3), (0, 5)):
        monkeypatch.setattr(stats, "VALUES_AT_HAND", room)
        ranked = stats._centred_ranks(df, names)
        assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, want.tolist()))
        plan = ranked._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == joins and "posexplode" not in plan and "Aggregate" not in plan


def test_counted_forest(spark):
    """Alike rows as counts: as many groups as combinations of bins, predictions and dependence as by the rows, and a forest as good as one over rows."""
    rng = np.random.default_rng(8)
    x = np.c_[rng.integers(0, 9, 4000), rng.integers(0, 400, 4000) / 10.0]
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 20)).astype(float)
    names = ["a", "b"]
    df = table_of(spark, x, names, y=y, k=np.arange(4000))
    edges = forests.bin_edges(df, names)
    assert edges[0] == list(range(1, 9)) and len(edges[1]) == 31
    groups = forests.counted(df, names, "y", edges)
    assert groups.count() <= 9 * 32 * 2 and groups.agg(F.sum("n")).first()[0] == 4000
    model = forests.counted_forest(groups, names, "y", edges, trees=4, depth=5)
    assert model.weights.sum() == pytest.approx(1)
    again = forests.counted_forest(groups.repartition(3), names, "y", edges, trees=4, depth=5)
    assert [t["value"].tolist() for t in model.trees] == [t["value"].tolist() for t in again.trees]

    def by_rows(at):
        def one(tree, row, node=0):
            while tree["feature"][node] >= 0:
                node = tree["left"][node] if row[tree["feature"][node]] <= tree["threshold"][node] else tree["right"][node]
            return tree["value"][node]

        return np.mean([np.mean([one(t, row) for t in model.unbinned()]) for row in at])

    told = forests.counted_predictions(model, groups, names)
    assert told.agg(F.sum(F.col("n") * F.col("prediction")) / F.sum("n")).first()[0] == pytest.approx(by_rows(x), abs=1e-9)
    got = {(r["column"], r["value"]): r["mean_prediction"] for r in forests.counted_partial_dependence(model, groups, df, names, points=10).collect()}
    assert len(got) == 19
    for (c, v), mean in list(got.items())[::5]:
        fixed = x.copy()
        fixed[:, names.index(c)] = v
        assert mean == pytest.approx(by_rows(fixed), abs=1e-9)
    assert forests.counted_cross_validated(df, names, "y", "k", k=2, trees=3).agg(F.min("f1")).first()[0] > 0.9


def test_forests_that_grow_together(spark, monkeypatch):
    """Trees of several lists of columns are those that each list grows alone, whatever the blocks of rows, and splits are the best by all rows."""
    rng = np.random.default_rng(12)
    x = rng.integers(0, 12, (900, 3)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 3)).astype(float)
    names = ["a", "b", "c"]
    df = table_of(spark, x, names, y=y, k=np.arange(900))
    edges = forests.bin_edges(df, names)
    parts = common.shared_table(forests.binned(forests.folded(df, "k", 2).withColumn("_seed", F.xxhash64(F.lit(1), "k")), names, edges, "y", "fold", "_seed"), "folds")
    lists = [np.array(own) for own in ([0, 1, 2], [1, 2], [0, 2])]
    stems = forests.grown(parts, names, "y", lists, 2, 3, depth=4)
    alike = lambda a, b: all(np.allclose(a[c], b[c]) for c in a)
    for i, own in enumerate(lists):
        alone = forests.grown(parts, names, "y", [own], 2, 3, depth=4)
        assert all(alike(forests._tree_of(*s, i), forests._tree_of(*t, 0)) for s, t in zip(stems, alone, strict=True))
    monkeypatch.setattr(forests, "ROWS_A_TASK", 200)
    monkeypatch.setattr(forests, "NODES_A_ROW", 3)
    dealt = parts.repartition(5)
    dealt.observed_rows = 900
    blocks = forests.grown(dealt, names, "y", lists, 2, 3, depth=4)
    assert all(alike(forests._tree_of(*s, i), forests._tree_of(*t, i)) for s, t in zip(stems, blocks, strict=True) for i in range(3))
    # a tree by hand: the rows of the other fold, as often as they are drawn
    seen = parts.where("fold <> 1").toPandas()
    w = forests._draws(seen["_seed"].to_numpy(), 3)
    assert w.mean() == pytest.approx(1, abs=0.15) and w.min() == 0
    rows = np.repeat(np.arange(len(seen)), w.astype(int))

    def grow(rows, own, left):
        bins, labels = seen[names].to_numpy()[rows], seen["y"].to_numpy()[rows]
        best = (0.0, None)
        for f in own:
            for b in range(11):
                low = bins[:, f] <= b
                if left and low.any() and not low.all():
                    gain = len(rows) * labels.var() - low.sum() * labels[low].var() - (~low).sum() * labels[~low].var()
                    best = max(best, (gain, (f, b)), key=lambda g: g[0] - (1e-9 if g[1] else 0))
        if best[1] is None or best[0] < 1e-6:
            return dict.fromkeys(rows.tolist(), labels.mean())
        low = bins[:, best[1][0]] <= best[1][1]
        return grow(rows[low], own, left - 1) | grow(rows[~low], own, left - 1)

    for i, own in enumerate(lists):
        want, tree = grow(rows, own, 4), forests._tree_of(*stems[3], i)
        for r, v in want.items():
            at = 0
            while tree["feature"][at] >= 0:
                at = tree["left"][at] if seen[names].to_numpy()[r, tree["feature"][at]] <= tree["threshold"][at] else tree["right"][at]
            assert tree["value"][at] == pytest.approx(v)


def test_trees_of_rows_at_hand_and_in_blocks(spark, monkeypatch):
    """A tree that a task grows whole, whose larger sides are what the smaller ones leave, is the one of blocks level by level; labels of 0 and 1 or others."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, k, 600) for k in (2, 3, 30, 7, 5)]).astype(float)
    names = ["a", "b", "c", "d", "e"]
    for y in (((x[:, 2] > 11) ^ (x[:, 1] > 1)).astype(float), x[:, 2] / 7 + x[:, 3]):
        df = table_of(spark, x, names, y=y, k=np.arange(600))
        parts = common.shared_table(forests.binned(forests.folded(df, "k", 2).withColumn("_seed", F.xxhash64(F.lit(1), "k")), names, forests.bin_edges(df, names), "y", "fold", "_seed"), "folds")
        lists = [np.array([0, 1, 2, 3, 4]), np.array([1, 3])]
        at_hand = forests.grown(parts, names, "y", lists, 2, 2, depth=4)
        monkeypatch.setattr(forests, "ROWS_AT_ONCE", 250)
        dealt = parts.repartition(3)
        dealt.observed_rows = 600
        blocks = forests.grown(dealt, names, "y", lists, 2, 2, depth=4)
        monkeypatch.undo()
        for (m, own), (n, other) in zip(at_hand, blocks, strict=True):
            assert m == pytest.approx(n) and len(own) == len(other) == 4
            assert all(np.allclose(a[c], b[c]) for a, b in zip(own, other, strict=True) for c in a)


def test_sums_of_columns_together(monkeypatch):
    rng = np.random.default_rng(8)
    x = np.array([rng.integers(0, k, 500) for k in (2, 3, 30, 7)], np.uint8)
    rows, w = np.repeat(np.arange(500), 2), rng.integers(0, 4, 500).astype(float)
    node = rng.integers(0, 5, 1000)
    for y in (rng.integers(0, 2, 500).astype(float), rng.normal(size=500)):
        want = np.zeros((2, 4, 5, forests.BINS))
        for f in range(4):
            np.add.at(want, (0, f, node, x[f][rows]), w[rows])
            np.add.at(want, (1, f, node, x[f][rows]), (w * y)[rows])
        for cells in (1, 40, 1 << 15):
            monkeypatch.setattr(forests, "CELLS", cells)
            monkeypatch.setattr(forests, "DRAWN", 300)
            assert np.allclose(forests._totals(x.T.copy(), rows, node, w, y, 5, [2, 3, 30, 7]), want)


def test_folds_of_several_lists(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 2))
    df = table_of(spark, x, ["a", "b"], y=(x[:, 0] > 0).astype(float), k=np.arange(200))
    got = forests.cross_validated(df, {"both": ["a", "b"], "b": ["b"]}, "y", "k", k=3, trees=5).groupBy("columns").agg(F.count("*").alias("n"), F.avg("f1").alias("f1")).collect()
    told = {r["columns"]: r for r in got}
    assert told["both"]["n"] == told["b"]["n"] == 3 and told["both"]["f1"] > 0.9 > told["b"]["f1"]


def test_quantiles_are_those_of_summaries(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 1, 8, 2.5]], "v double")
    assert common.quantiles(df, "v", [0.25, 0.5]) == [stats.summaries(df, ["v"]).first()[c] for c in ("q1", "median")]
