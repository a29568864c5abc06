"""Small cases worked out by hand, and brute force on random rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.people import author
from tidemark.operators import cleaning, common, explore, graph, identity, registry, stats
from tidemark.operators.point_in_time import earlier_sums, first_seen, greedy_chunks, rate


def stream(spark, rows):
    return spark.createDataFrame(rows, "id long, seq long, ts long, a long, n long, k long")


@pytest.mark.parametrize(("window", "inclusive", "counts"), [(10, False, [0, 1, 0, 1, 0]), (10, True, [0, 1, 2, 3, 0]), (None, False, [0, 1, 2, 3, 4])])
def test_ties_and_bounds(spark, window, inclusive, counts):
    rows = stream(spark, [(i, i, t, 1, 1, int(i in (0, 2))) for i, t in enumerate([0, 0, 10, 10, 21])])
    got = earlier_sums(rows.select("id", "seq", "ts", "a"), rows, ["a"], ["n", "k"], window, inclusive).orderBy("id").collect()
    assert [r.n for r in got] == counts


@pytest.mark.parametrize("window", [7, 50, None])
def test_earlier_sums_by_brute_force(spark, window):
    rng = random.Random(window)
    rows = [(i, i, t, rng.randrange(3), rng.randrange(4), 0) for i, t in enumerate(sorted(rng.randrange(120) for _ in range(300)))]
    df = stream(spark, rows)
    got = {r.id: r.n for r in earlier_sums(df.select("id", "seq", "ts", "a"), df, ["a"], ["n"], window).collect()}
    for i, s, t, a, _, _ in rows:
        want = sum(n for _, s2, t2, a2, n, _ in rows if a2 == a and (t2, s2) < (t, s) and (window is None or t2 > t - window))
        assert got[i] == want


def test_chunks_and_first_seen(spark):
    df = spark.createDataFrame([(t, i) for i, t in enumerate([0, 10, 11, 21, 22])], "ts long, seq long")
    assert [r.chunk_id for r in greedy_chunks(df, 10).orderBy("seq").collect()] == [0, 0, 1, 1, 2]
    assert greedy_chunks(df.limit(0), 10).count() == 0
    seen = spark.createDataFrame([("p", 1, 0, 0), ("p", 1, 1, 1), ("q", 1, 2, 2), ("p", 2, 3, 3)], "p string, u long, ts long, seq long")
    assert [r.f for r in first_seen(seen, ["p", "u"], "f").orderBy("seq").collect()] == [True, False, True, True]


def test_rate_without_history(spark):
    assert spark.range(1).select(rate(F.lit(0), F.lit(0)).alias("r")).first().r == 0.0


def test_filters_reject_in_order(spark):
    rows = [("Ghost", "User", "2020-01-01T00:00:00Z"), ("x[bot]", "User", "2020-01-01T00:00:00Z"), ("MrsFlux", "User", "2020-01-01T00:00:00Z"), ("a", "Bot", "2020-01-01T00:00:00Z"), ("b", "User", "2020-01-12T00:00:00Z"), ("c", "User", "2020-01-12T00:00:01Z"), (None, "User", "2020-01-01T00:00:00Z")]
    df = spark.createDataFrame([(i, *r, "2020-01-01T00:00:00Z") for i, r in enumerate(rows)], "i int, login string, user_type string, closed_at string, created_at string")
    got = cleaning.filter_chain(df, "pcuabn", cleaning.row_filters("2020-01-12 00:00:00")).orderBy("i").collect()
    assert [r.rejected_by for r in got] == ["a", "n", "b", "u", None, "c", "a"]


def test_unequal_streams_are_refused(spark):
    with pytest.raises(ValueError, match="tags"):
        cleaning.ordered_union([spark.range(1)], ["a", "b"])


def test_closure_and_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "focal long, other long")
    assert {tuple(r) for r in graph.transitive_closure(edges).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} | {(7, 8)}
    assert graph.transitive_closure(edges, 1).count() == 4
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.component for r in graph.min_label_components(chain).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_second_order_degree(spark):
    edges = spark.createDataFrame([(9, 1, "c", t, t, 0) for t in (5, 8)] + [(7, 9, "c", t, t, 0) for t in (3, 6)], "src long, tgt long, label string, ts long, seq long, project long")
    queries = spark.createDataFrame([(50, 10, 10, 1, 0)], "id long, ts long, seq long, u long, project long")
    assert graph.second_order_degree(queries, edges.withColumn("m", F.lit(1)), 20, "intra", "in", ("c",)).first().degree == 4
    assert graph.second_order_degree(queries, edges.withColumn("m", F.lit(1)), 20, "ecosystem", "in", ("c",)).count() == 0


def test_statistics_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.logistic(size=300) > 0).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t), int(i % 7)) for i, (r, t) in enumerate(zip(x, y))], "x0 double, x1 double, x2 double, y double, g int")
    names = ["x0", "x1", "x2"]
    g = x.T @ x
    want = np.diag(g) * np.diag(np.linalg.inv(g))
    assert np.allclose([r.vif for r in stats.vif(df, names).collect()], want)
    beta = np.zeros(4)
    a = np.c_[np.ones(300), x]
    for _ in range(30):
        mu = 1 / (1 + np.exp(-a @ beta))
        beta += np.linalg.solve(a.T @ (a * (mu * (1 - mu))[:, None]), a.T @ (y - mu))
    assert np.allclose(stats.logit(df, names, "y"), beta, atol=1e-4)
    w = mu * (1 - mu)
    h = np.einsum("ij,jk,ik->i", a, np.linalg.inv(a.T @ (a * w[:, None])), a) * w
    cook = ((y - mu) / np.sqrt(w)) ** 2 / 4 * h / (1 - h) ** 2
    got = sorted(r.cooks_distance for r in stats.influence(df, names, "y").collect())
    assert np.allclose(got, np.sort(cook), atol=1e-5)
    assert abs(stats.fisher_p(3, 1, 1, 3) - 0.4857142857) < 1e-9


def test_capped_sample(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("g"))
    got = explore.capped_sample(df, "g", "id", 100)
    assert got.where("g = 0").count() == 100
    assert got.where("g > 0").count() == 1000
    assert got.exceptAll(explore.capped_sample(df, "g", "id", 100)).count() == 0


def test_empty_tables(spark):
    none = stream(spark, [])
    assert earlier_sums(none.select("id", "seq", "ts", "a"), none, ["a"], ["n"], 10).count() == 0
    assert explore.log_odds(spark.createDataFrame([], "x double, y boolean"), "x", "y", [0.0, 1.0]).count() == 0
    assert graph.transitive_closure(spark.createDataFrame([], "focal long, other long")).count() == 0


def test_names(spark):
    mails = spark.createDataFrame([(1, "a", "A B", " Ann@Mail.org "), (2, "b", "b", "none"), (3, "c", "c", "x@example.com"), (4, "d", "d", "host.(none)"), (5, "e", "A B", None)], "uid long, login string, name string, email string")
    rows = {r.uid: r.email for r in identity.normalised(mails).collect()}
    assert rows == {1: "ann@mail.org", 2: None, 3: None, 4: "host.(none)", 5: None}
    links = identity.arbitrated(identity.clue_pairs(identity.normalised(mails)))
    assert [(r.a, r.b) for r in links.collect()] == [(1, 5)]


def test_dependency_map_by_hand(spark):
    packages = spark.createDataFrame([("1", "2"), ("1", "1"), ("1", "2"), ("3", "")], "focal string, other string")
    repositories = spark.createDataFrame([("A/x", "2"), ("unknown", "2"), ("a/x", "")], "repo string, other string")
    projects = spark.createDataFrame([("7", "a/X", 0), ("1", "a/x", 1)], "id string, repo string, place int")
    assert {tuple(r) for r in registry.dependency_map(packages, repositories, projects).collect()} == {("1", "2"), ("3", "")}
    assert [r.repo for r in registry.unresolved(repositories, projects).collect()] == ["unknown"]


def test_inclusion_by_hand(spark):
    stamp = "timestamp '2019-01-01'"
    prs = spark.sql(f"select * from values ('a/x','GitHub','closed',{stamp},{stamp}), ('a/x','GitHub','open',{stamp},{stamp}), ('b/y','GitLab','merged',{stamp},timestamp '2021-01-01'), ('b/y','GitLab','closed',{stamp},{stamp}), ('c/z','other','closed',{stamp},{stamp}) as t(repo, host, state, created_at, updated_at)")
    closed = registry.closed_counts(prs, "2020-01-12 00:00:00")
    assert {r.repo: r.closed for r in closed.collect()} == {"a/x": 1, "b/y": 1, "c/z": 0}
    rows = spark.createDataFrame([("1", "a/x"), ("2", "a/x"), ("3", "c/z"), ("4", ""), ("5", "none")], "id string, repo string")
    loud = spark.createDataFrame([("1", "m1", 4), ("1", "m1", 7), ("2", "m1", 9), ("3", "m1", 99)], "id string, month string, downloads int")
    got = {r.id: (r.enough_prs, r.enough_downloads, r.included) for r in registry.included(rows, closed, loud, 1, 10).collect()}
    assert got == {"1": (True, True, True), "2": (True, False, False), "3": (False, True, False), "5": (False, False, False)}


def test_tables_that_are_kept(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert registry.kept_table(spark, str(tmp_path / "t"), make).count() == 3
    assert registry.kept_table(spark, str(tmp_path / "t"), make).count() == 3
    assert made == [1]


def test_p_values():
    for x, k, p in ((3.841458820694124, 1, 0.05), (11.070497693516351, 5, 0.05), (0.0, 3, 1.0), (1.0, 2, np.exp(-0.5)), (60.0, 4, 2.9015e-12)):
        assert stats.chi_square_p(x, k) == pytest.approx(p, rel=1e-4)


def test_coefficients_agree_with_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] - 0.7 * x[:, 1] + rng.logistic(size=400) > 0).astype(float)
    a, beta = np.c_[x, np.ones(400)], np.zeros(3)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-a @ beta))
        inverse = np.linalg.inv(a.T @ (a * (mu * (1 - mu))[:, None]))
        beta = beta + inverse @ (a.T @ (y - mu))
    got = stats.coefficients(spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "u double, v double, y double"), ["u", "v"], "y").collect()
    assert [r.term for r in got] == ["u", "v", "const"]
    assert np.allclose([r.estimate for r in got], beta, atol=1e-4)
    assert np.allclose([r.std_error for r in got], np.sqrt(np.diag(inverse)), atol=1e-4)
    assert np.allclose([r.odds for r in got], np.exp(beta), atol=1e-3)


def test_columns_and_clusters_of_columns():
    names = ["eco_pr", "intra_pr", "pr_eco"]
    assert stats.matching(names, ["eco"]) == ["eco_pr"]
    assert stats.matching(names, ["eco", ".*_pr$"], keep=False) == ["pr_eco"]
    assert stats.correlation_clusters([("a", "b"), ("c", "d"), ("b", "c"), ("e", "f")]) == [["a", "b", "c"], ["c", "d", "b"], ["e", "f"]]


def test_quantiles_and_medians(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), float(rng.randrange(40))) for _ in range(500)] + [(0, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    cuts = [0.0, 0.1, 0.5, 0.98, 1.0]
    values = [v for _, v in rows if v is not None]
    assert np.allclose(common.quantiles(df, "v", cuts), np.quantile(values, cuts))
    assert common.quantiles(df.limit(0), "v", cuts) is None
    got = {r.g: r.m for r in common.grouped_medians(df, "g", "v", "m").collect()}
    assert got == {g: float(np.median([v for h, v in rows if h == g and v is not None])) for g in range(3)}


def test_authors(spark):
    lines = ["John Hopkins <j.hopkins@hospitals.com>", "J.H. Hopkins <hopkins@jh.hospitals.com>", "plain <p@q>", "a-b_c <x@y>"]
    got = [r.a for r in spark.createDataFrame([(x,) for x in lines], "l string").select(author(F.col("l")).alias("a")).collect()]
    assert [(a.last_name, a.user_name) for a in got] == [("Hopkins", "j.hopkins"), ("Hopkins", "hopkins"), ("plain", "p"), ("c", "x")]
    # halving at every character: ((1 / 2 + 1) / 2) / 2 = 0.375 out of place, so (2 + 5.625 / 6) / 3, and 0.3 of the rest for three equal first characters
    assert jaro_winkler("martha", "marhta", True) == pytest.approx(0.97916667 + 0.3 * 0.02083333, abs=1e-6)


def test_accounts_merge_by_cluster(spark):
    accounts = spark.createDataFrame([(1, "a@x"), (2, "a@x"), (3, "b@x"), (4, "c@x"), (5, "c@x"), (6, "d@x"), (7, "e@x"), (8, "f@x")], "uid long, email string")
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (8, 6)], "uid long, cluster long")
    labels = spark.createDataFrame([(1, 2, "EMAIL"), (2, 3, "COMP_EMAIL_PREFIX"), (4, 5, "EMAIL"), (6, 7, "FULL_NAME"), (7, 8, "FULL_NAME")], "a long, b long, rule string")
    got = {(r.uid, r.representative) for r in identity.merged_accounts(accounts, members, labels).collect()}
    assert got == {(2, 1), (5, 4), (7, 6), (8, 6)}  # the first is split by address, the others are valid as they are
    assert identity.member_pairs(members.where("cluster = 6")).count() == 3


def test_second_order_by_brute_force(spark):
    rng = random.Random(12)
    labels, window = ("c", "e"), 20
    edges = [(rng.randrange(5), rng.randrange(5), rng.choice(labels), t, i, rng.randrange(2), rng.randrange(1, 3)) for i, t in enumerate(sorted(rng.randrange(90) for _ in range(120)))]
    queries = [(1000 + i, rng.randrange(90), 500 + i, rng.randrange(5), rng.randrange(2)) for i in range(25)]
    df = spark.createDataFrame(edges, "src long, tgt long, label string, ts long, seq long, project long, m long")
    asked = spark.createDataFrame(queries, "id long, ts long, seq long, u long, project long")
    for scope in ("intra", "ecosystem"):
        for direction in ("in", "out"):
            want: dict = {}
            for q, ts, seq, u, project in queries:
                near: dict = {}
                for s, t, c, at, n, p, m in edges:
                    if t == u and s != t and (p == project) == (scope == "intra") and at > ts - window and (at, n) < (ts, seq):
                        near.setdefault((s, c), []).extend([(at, n)] * m)
                for (n, c), conn in near.items():
                    for i, (at, _) in enumerate(sorted(conn)):
                        for s, t, e, when, _, _, m in edges:
                            end, far = (t, s) if direction == "in" else (s, t)
                            if s != t and end == n and far != u and ts - window < when < at:
                                want[q, c, e] = want.get((q, c, e), 0) + (len(conn) - i) * m
            got = {(r.id, r.c, r.e): r.degree for r in graph.second_order_degree(asked, df, window, scope, direction, labels).collect()}
            assert got == want


def test_neighbours_and_fills_of_a_group_over_all_ranges(spark):
    rng = random.Random(9)
    rows = [(("x" if i % 5 else rng.choice(["y", None])), i // 2, i, i if rng.random() < 0.1 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, t long, id long, v long").repartition(3)
    filled = {r.id: r.v for r in common.fill_forward(df, ["g"], ["t", "id"], ["v"]).collect()}
    beside = {r.id: (r.p, r.n) for r in common.neighbours(df, ["g"], ["t", "id"], "id", "p", "n").collect()}
    for g in ("x", "y", None):
        mine, last = [r for r in rows if r[0] == g], None
        for k, (_, _, i, v) in enumerate(mine):
            last = v if v is not None else last
            assert filled[i] == last
            assert beside[i] == (mine[k - 1][2] if k else None, mine[k + 1][2] if k + 1 < len(mine) else None)
