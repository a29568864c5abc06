"""An activity log derived from the order tables: pull requests, issues, comments, dependencies.

Spark views and the SQL that yields the same rows stand side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECTS, PEOPLE = 25, 100
WINDOW = 90 * 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts) -> F.Column:
    return F.unix_seconds(F.to_timestamp(ts))


def opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order without what its lines tell: id, seq, ts, project, submitter, merged, is_issue."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("seq"),
        seconds(F.col("o_orderdate")).alias("ts"),
        (F.col("o_orderkey") % PROJECTS).alias("project"),
        (F.col("o_custkey") % PEOPLE).alias("submitter"),
        (F.col("o_orderstatus") == "F").alias("merged"),
        F.substring("o_orderpriority", 1, 1).isin("1", "2").alias("is_issue"),
    )


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: id, seq, ts, project, submitter, merged, is_issue, comments, integrator."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("integrator"), F.count("*").alias("comments"))
    acts = opened(spark, sf_dir)
    return acts.join(lines, acts.id == lines.l_orderkey, "left").select(*acts.columns, F.coalesce("comments", F.lit(0)).alias("comments"), "integrator")


def comments(spark: SparkSession, sf_dir: str, acts: DataFrame | None = None) -> DataFrame:
    """One row per order line: the activity it belongs to and its commenter; `acts` may be stored activities."""
    acts = (activities(spark, sf_dir) if acts is None else acts).select("id", "seq", "ts", "project", "submitter", "merged", "is_issue", "integrator")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("commenter")).join(acts, "id")


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (focal, other) between packages, one for each part.

    A package belongs to the project that its number has modulo PROJECTS, and depends
    on a package of about half its number, in its own project or one of three others.
    """
    p, half = F.col("p_partkey"), F.floor(F.col("p_partkey") / 2)
    other = half - F.pmod(half - p + F.col("p_size") % 4, F.lit(PROJECTS))
    return table(spark, sf_dir, "part").select(p.alias("focal"), other.cast("long").alias("other")).where("other >= 1")


def project_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges (focal, other) between the projects of packages, those of a project to itself included."""
    return packages(spark, sf_dir).select((F.col("focal") % PROJECTS).alias("focal"), (F.col("other") % PROJECTS).alias("other")).distinct()


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges (focal, other) between different projects."""
    return project_edges(spark, sf_dir).where("focal <> other")


#: The same as common table expressions: act, com, pr, pkg (edges of packages), dep_all (of projects), dep.
SQL = f"""
lines AS (SELECT l_orderkey, min(l_suppkey) AS integrator, count(*) AS comments FROM lineitem GROUP BY l_orderkey),
act AS (SELECT o_orderkey AS id, o_orderkey AS seq, CAST(epoch(o_orderdate) AS BIGINT) AS ts, o_orderkey % {PROJECTS} AS project,
    o_custkey % {PEOPLE} AS submitter, o_orderstatus = 'F' AS merged, substr(o_orderpriority, 1, 1) IN ('1', '2') AS is_issue,
    coalesce(comments, 0) AS comments, integrator FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey),
com AS (SELECT l_orderkey AS id, l_suppkey AS commenter, seq, ts, project, submitter, merged, is_issue, integrator FROM lineitem JOIN act ON id = l_orderkey),
pr AS (SELECT * FROM act WHERE NOT is_issue),
pkg AS (SELECT focal, other FROM (SELECT p_partkey AS focal, p_partkey // 2 - ((p_partkey // 2 - p_partkey + p_size % 4) % {PROJECTS} + {PROJECTS}) % {PROJECTS} AS other FROM part) WHERE other >= 1),
dep_all AS (SELECT DISTINCT focal % {PROJECTS} AS focal, other % {PROJECTS} AS other FROM pkg),
dep AS (SELECT focal, other FROM dep_all WHERE focal <> other)"""


def sql(body: str, more: str = "") -> str:
    return f"WITH {SQL}{', ' + more if more else ''} {body}"
