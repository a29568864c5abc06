"""What a job shuffles, holds and counts as its tables grow."""

from pyspark.sql import functions as F

from tidemark.operators.point_in_time import earlier_sums
from tidemark.plans import activity as A
from tidemark.plans import features

SF = "/root/testdata/sf0.001"


def test_earlier_sums_shuffle_once(spark):
    df = spark.range(50).select("id", F.col("id").alias("seq"), (F.col("id") * 3).alias("ts"), (F.col("id") % 3).alias("a"), F.lit(1).cast("long").alias("n"))
    plan = earlier_sums(df.select("id", "seq", "ts", "a"), df, ["a"], ["n"], 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_rows_without_a_key_see_nothing(spark):
    df = spark.createDataFrame([(1, 1, 1, None, 1), (2, 2, 2, None, 1), (3, 3, 3, 7, 1), (4, 4, 4, 7, 1)], "id long, seq long, ts long, a long, n long")
    for window in (10, None):
        got = earlier_sums(df.select("id", "seq", "ts", "a"), df, ["a"], ["n"], window)
        assert {r.id: r.n for r in got.collect()} == {1: 0, 2: 0, 3: 0, 4: 1}


def test_only_people_that_are_asked_about_are_paired(spark):
    acts = A.activities(spark, SF)
    one = lambda c: spark.createDataFrame([(1,)], f"{c} long")
    whole = features.Log(acts, A.comments(spark, SF))
    asked = features.Log(whole.activities, whole.comments, one("a"), one("b"))
    for kind in ("integrated", "commented", "discussion"):
        pairs = features._pairs(kind, False, False)
        want = {tuple(r) for r in pairs(whole).where("a = 1 and b = 1").collect()}
        assert {tuple(r) for r in pairs(asked).collect()} == want


def test_pairs_of_large_keys_are_told_apart_as_in_sql(spark, tmp_path):
    import duckdb

    from tests.oracle import compare
    from tidemark.plans import catalog

    con = duckdb.connect()
    for name in ("part", "orders", "lineitem"):
        con.execute(f"CREATE TABLE all_{name} AS SELECT * FROM '{SF}/{name}.parquet'")
    con.execute("UPDATE all_lineitem SET l_suppkey = CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 1005 ELSE 2 + 3 * (l_orderkey % 2) END")
    for name in ("part", "orders", "lineitem"):
        con.execute(f"COPY all_{name} TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    assert compare(con, catalog.QUERIES["edge_counts_by_label"](spark, str(tmp_path)), catalog.ORACLE_SQL["edge_counts_by_label"]) == ""


def test_models_without_rows_or_varying_columns(spark):
    from tidemark.plans import models

    rows = spark.range(40).select("id", (F.col("id") % 4).alias("project"), F.lit(1.0).alias("x"), (F.col("id") % 3 == 0).cast("double").alias("label"))
    got = {r.term: r for r in models.pipeline(rows, ["x"]).collect()}
    assert set(got) == {"_scale", "_group_variance"} and got["_scale"].rows == 40 and got["_scale"].estimate > 0
    none = models.pipeline(rows.where("id < 0"), ["x"]).collect()
    assert [(r.term, r.estimate, r.rows, r.outliers) for r in none] == [("_scale", None, 0, 0), ("_group_variance", None, 0, 0)]


def test_a_model_stores_what_it_is_fitted_from(spark, monkeypatch):
    from tidemark.plans import models

    rows = spark.range(60).selectExpr("id", "id % 4 project", "id % 7 / 6.0 x", "1.0D fixed", "rand(1) other", "cast(id % 3 = 0 as double) label")
    stored, keep = [], models.shared_table
    monkeypatch.setattr(models, "shared_table", lambda df, label: stored.append(keep(df, label)) or stored[-1])
    got = {r.term: r for r in models.pipeline(rows, ["x", "fixed"]).collect()}
    assert set(got) == {"x", "_scale", "_group_variance"} and got["x"].rows == 60
    assert all("other" not in t.columns and "id" not in t.columns for t in stored) and len(stored) == 1


def test_a_large_table_is_dealt_by_its_rows(spark, monkeypatch):
    from tidemark.operators import common

    monkeypatch.setattr(common, "ROWS_A_TASK", 10)
    big = spark.range(100)
    assert common.spread(big, big, "id").rdd.getNumPartitions() == 10 and common.spread(big.limit(5), big.limit(5), "id").columns == ["id"]


def test_second_order_stores_no_query_with_each_edge(spark, monkeypatch):
    from tidemark.operators import graph
    from tidemark.plans.graphs import LABELS

    edges = spark.range(30).select(F.col("id").alias("ts")).selectExpr("1L src", "0L tgt", f"'{LABELS[1]}' label", "7L project", "ts", "ts seq", "1L m")
    edges = edges.unionByName(spark.sql(f"select 2L src, 1L tgt, '{LABELS[0]}' label, 7L project, -1L ts, -1L seq, 1L m"))
    queries = spark.range(300).selectExpr("id", "40L ts", "100 + id seq", "0L u", "7L project")
    stored, keep = [], graph.shared_table
    monkeypatch.setattr(graph, "shared_table", lambda df, label: stored.append(keep(df, label)) or stored[-1])
    for scope, some in (("intra", queries), ("ecosystem", queries.withColumn("project", F.lit(8).cast("long")))):
        got = graph.second_order_degree(some, edges, 1000, scope, "in", LABELS).collect()
        assert {(r.c, r.e, r.degree) for r in got} == {(LABELS[1], LABELS[0], 30 * 31 // 2)} and len(got) == 300
    assert max(t.observed_rows for t in stored) < 300 * 30 / 4
