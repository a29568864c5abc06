"""Queries of the remaining operators: repairs, lookups, classifications, samples, wide feature tables and ablation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import explore as E
from ..operators import stats as S
from ..operators.common import cumulative, quantiles, shared_path, shared_table, small
from ..operators.point_in_time import earlier_sums, first_seen, greedy_chunks
from ..sources.readers import repository
from . import activity as A
from . import features
from .activity import sql, table
from .cleaning import CHUNKED, recursive

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _experience(key: str):
    """Earlier pull requests of a project by who handled them (intended), or by whether they were merged (as the feature was once computed)."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        prs = A.activities(spark, d).where("not is_issue").select("id", "ts", "seq", "project", F.col(key).alias("k")).where("k is not null")
        return earlier_sums(prs, prs.withColumn("n", F.lit(1).cast("long")), ["project", "k"], ["n"], A.WINDOW).select("id", F.col("n").alias("experience"))

    return run


for _key, _name in (("integrator", "integrator_experience"), ("merged", "integrator_experience_faithful")):
    QUERIES[_name] = _experience(_key)
    ORACLE_SQL[_name] = sql(f"SELECT q.id, count(e.id) AS experience FROM pr q LEFT JOIN pr e ON e.project = q.project AND e.{_key} = q.{_key} AND e.ts > q.ts - {A.WINDOW} AND (e.ts < q.ts OR (e.ts = q.ts AND e.seq < q.seq)) WHERE q.{_key} IS NOT NULL GROUP BY q.id")


@query(recursive("SELECT id, chunk_id, row_number() OVER (PARTITION BY chunk_id, project, submitter ORDER BY ts, seq) = 1 AS first_time FROM chunked WHERE NOT is_issue", CHUNKED))
def first_time_in_chunk(spark: SparkSession, d: str) -> DataFrame:
    """First-time contributors as seen within greedy chunks only."""
    chunked = greedy_chunks(A.activities(spark, d), A.WINDOW).where("not is_issue")
    return first_seen(chunked, ["chunk_id", "project", "submitter"], "first_time").select("id", "chunk_id", "first_time")


@query(sql("SELECT id, CASE WHEN flagged THEN row_number() OVER (PARTITION BY project, submitter, flagged ORDER BY ts, seq) = 1 ELSE false END AS repaired FROM (SELECT *, id % 3 = 0 AS flagged FROM pr)"))
def ftc_repair(spark: SparkSession, d: str) -> DataFrame:
    """Of the rows flagged as first-time, only the first of each person and project keeps the flag."""
    prs = A.activities(spark, d).where("not is_issue").withColumn("flagged", F.col("id") % 3 == 0)
    kept = first_seen(prs.where("flagged"), ["project", "submitter"], "first").select("id", "first")
    return prs.join(kept, "id", "left").select("id", F.coalesce("first", F.lit(False)).alias("repaired"))


@query(sql("SELECT a.id, b.id AS referenced FROM pr a JOIN act b ON b.project = a.project AND b.id = (a.id - 25 * (a.submitter % 9))"))
def referenced_activities(spark: SparkSession, d: str) -> DataFrame:
    """Activities of the same project that a link names: the key is read back from a link's text."""
    acts = A.activities(spark, d)
    link = F.concat_ws("/", F.lit("https://host"), "project", F.lit("pull"), (F.col("id") - 25 * (F.col("submitter") % 9)).cast("string"))
    part = lambda i: F.regexp_extract("link", r"https://host/(\d+)/pull/(\d+)", i)
    links = acts.where("not is_issue").select("id", link.alias("link")).select("id", part(1).try_cast("long").alias("project"), part(2).try_cast("long").alias("referenced"))
    return links.join(acts.select("project", F.col("id").alias("referenced")), ["project", "referenced"]).select("id", "referenced")


@query(sql("SELECT list, count(*) AS n, count(*) FILTER (WHERE has_dep) AS to_core, count(*) FILTER (WHERE has_inverse) AS from_core FROM (SELECT project, CASE WHEN project % 2 = 0 THEN 'even' ELSE 'odd' END AS list, project IN (SELECT focal FROM dep WHERE other < 5) AS has_dep, project IN (SELECT other FROM dep WHERE focal < 5) AS has_inverse FROM (SELECT DISTINCT project FROM act WHERE project >= 5)) GROUP BY 1"))
def core_dependency_coverage(spark: SparkSession, d: str) -> DataFrame:
    dep = A.dependencies(spark, d)
    out = small(dep.where("other < 5").select(F.col("focal").alias("project")).distinct().withColumn("o", F.lit(1)))
    into = small(dep.where("focal < 5").select(F.col("other").alias("project")).distinct().withColumn("i", F.lit(1)))
    names = A.activities(spark, d).select("project").where("project >= 5").distinct()
    kind = F.when(F.col("project") % 2 == 0, "even").otherwise("odd")
    return names.join(out, "project", "left").join(into, "project", "left").groupBy(kind.alias("list")).agg(F.count("*").alias("n"), F.count("o").alias("to_core"), F.count("i").alias("from_core"))


@query(sql("SELECT count(DISTINCT focal) AS with_out, count(DISTINCT other) AS with_in, count(*) FILTER (WHERE focal = other) AS own FROM dep_all WHERE focal IN (SELECT project FROM act) AND other IN (SELECT project FROM act)"))
def count_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return A.project_edges(spark, d).agg(F.countDistinct("focal").alias("with_out"), F.countDistinct("other").alias("with_in"), F.count_if(F.col("focal") == F.col("other")).alias("own"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")
def id_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey = 77").select("o_orderkey", "o_custkey").limit(1)


@query(sql("SELECT project, count(DISTINCT submitter) AS listed, count(DISTINCT submitter) FILTER (WHERE seq <= last_seen) AS seen FROM (SELECT *, max(CASE WHEN submitter < 10 THEN seq END) OVER (PARTITION BY project) AS last_seen FROM pr) GROUP BY 1"))
def progress_positions(spark: SparkSession, d: str) -> DataFrame:
    """How many people a project has, and how many before its last row of a listed person."""
    prs = A.activities(spark, d).where("not is_issue")
    last = prs.groupBy("project").agg(F.max(F.when(F.col("submitter") < 10, F.col("seq"))).alias("last_seen"))
    both = prs.join(small(last), "project")
    return both.groupBy("project").agg(F.countDistinct("submitter").alias("listed"), F.countDistinct(F.when(F.col("seq") <= F.col("last_seen"), F.col("submitter"))).alias("seen"))


@query("SELECT l_orderkey, max(CAST(greatest(l_discount, l_tax) > 0.07 AS INT)) AS any_flag, max(CASE WHEN l_quantity <= 12 THEN 'Q1' WHEN l_quantity <= 25 THEN 'Q2' WHEN l_quantity <= 38 THEN 'Q3' ELSE 'Q4' END) AS quartile FROM lineitem GROUP BY 1")
def group_flags(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    box = F.when(q <= 12, "Q1").when(q <= 25, "Q2").when(q <= 38, "Q3").otherwise("Q4")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max((F.greatest("l_discount", "l_tax") > 0.07).cast("int")).alias("any_flag"), F.max(box).alias("quartile"))


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders) SELECT CASE WHEN o_totalprice <= a THEN 0 WHEN o_totalprice <= b THEN 1 WHEN o_totalprice <= c THEN 2 ELSE 3 END AS box, least(count(*), 10) AS n FROM orders, q GROUP BY 1")
def quartile_box_sample(spark: SparkSession, d: str) -> DataFrame:
    """At most ten seeded rows of each quartile."""
    rows = table(spark, d, "orders")
    a, b, c = quantiles(rows, "o_totalprice", [0.25, 0.5, 0.75])
    box = F.when(F.col("o_totalprice") <= a, 0).when(F.col("o_totalprice") <= b, 1).when(F.col("o_totalprice") <= c, 2).otherwise(3)
    return E.capped_sample(rows.withColumn("box", box), "box", "o_orderkey", 10, seed=42).groupBy("box").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS platform, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1 UNION ALL SELECT 'unknown', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) HAVING count(*) > 0")
def platform_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows routed by the platform of their project; untracked ones are dropped, those without a known project are 'unknown'."""
    platform = small(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("platform")))
    named = table(spark, d, "orders").join(platform, "o_custkey", "left").withColumn("platform", F.coalesce("platform", F.lit("unknown")))
    return named.where("platform <> 'BUILDING'").groupBy("platform").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey % 4 AS share, count(*) AS n FROM customer GROUP BY 1")
def token_shares(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy(F.pmod("c_nationkey", F.lit(4)).alias("share")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, 'own' || (o_orderkey % 25) || '/repo' || (o_custkey % 7) AS repo, (o_orderkey % 25) || ':' || o_orderkey AS pr_key FROM orders")
def repository_names(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/data/raw/own"), (F.col("o_orderkey") % 25).cast("string"), F.lit("--repo"), (F.col("o_custkey") % 7).cast("string"), F.lit("--with-issue-data.json"))
    return table(spark, d, "orders").select("o_orderkey", repository(path).alias("repo"), F.concat_ws(":", F.col("o_orderkey") % 25, "o_orderkey").alias("pr_key"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.missing'), 'none') AS fallback, strpos(event_type, 'i') - 1 AS place, contains(event_type, 'ic') AS inside FROM events")
def safe_access(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("fallback"), (F.instr("event_type", "i") - 1).cast("long").alias("place"), F.coalesce(F.contains("event_type", F.lit("ic")), F.lit(False)).alias("inside"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND greatest(l_discount, l_tax) > 0")
def between_and_any(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where(F.col("l_quantity").between(10, 20) & (F.greatest("l_discount", "l_tax") > 0)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_returnflag, k AS feature, round(avg(v), 6) AS mean FROM (SELECT l_returnflag, l_discount, l_tax FROM lineitem) UNPIVOT (v FOR k IN (l_discount, l_tax)) GROUP BY 1, 2")
def melted_means(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_discount", "l_tax")
    return rows.unpivot("l_returnflag", ["l_discount", "l_tax"], "feature", "v").groupBy("l_returnflag", "feature").agg(F.round(F.avg("v"), 6).alias("mean"))


@query("SELECT round(count(*) FILTER (WHERE a > b) * 1.0 / count(*), 6) AS share FROM (SELECT l_suppkey, sum(l_discount) AS a, sum(l_tax) AS b FROM lineitem GROUP BY 1) WHERE a <> 0 AND b <> 0")
def importance_comparison(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_discount").alias("a"), F.sum("l_tax").alias("b")).where("a <> 0 and b <> 0")
    return per.agg(F.round(F.count_if(F.col("a") > F.col("b")) / F.count("*"), 6).alias("share"))


@query()
def probability_guess(spark: SparkSession, d: str) -> DataFrame:
    """Scores of guesses that are right as often as the share of merged rows, by a seeded hash."""
    prs = A.activities(spark, d).where("not is_issue")
    share = prs.agg(F.avg(F.col("merged").cast("double"))).first()[0] or 0.0
    draw = F.pmod(F.xxhash64(F.lit(42), "id"), F.lit(1_000_000)) / 1e6
    return S.confusion(prs, F.col("merged"), draw < share)


def _wide_sql() -> str:
    each = [(f.name, features.sql_of(f)) for f in features.registry()]
    names = ", ".join(n for n, _ in each)
    return f"SELECT id, {names} FROM " + " JOIN ".join(f"({q}) t{i}" + (" USING (id)" if i else "") for i, (_, q) in enumerate(each))


@query(_wide_sql())
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    """All features of every pull request side by side, from one pass for each set of keys."""
    return features.compute_all(features.registry(), spark, d)


_NAMES = [f.name for f in features.registry()]


@query(f"WITH wide AS ({_wide_sql()}), long AS (UNPIVOT (SELECT id, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in _NAMES)} FROM wide) ON {', '.join(_NAMES)} INTO NAME feature VALUE v), r AS (SELECT id, feature, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS place FROM long), vary AS (SELECT * FROM r WHERE feature IN (SELECT feature FROM r GROUP BY 1 HAVING min(place) < max(place))) SELECT a.feature AS a, b.feature AS b, round(corr(a.place, b.place), 6) AS rho FROM vary a JOIN vary b ON a.id = b.id AND a.feature < b.feature GROUP BY 1, 2")
def feature_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlations of all features, each pair once by name; features that never vary are left out."""
    got = S.spearman(shared_table(feature_table(spark, d), "features"), _NAMES).where("rho is not null")
    return got.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("rho", 6).alias("rho"))


@query(f"WITH wide AS ({_wide_sql()}), long AS (UNPIVOT (SELECT id, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in _NAMES)} FROM wide) ON {', '.join(_NAMES)} INTO NAME feature VALUE v) SELECT feature AS column, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS least, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, round(quantile_cont(v, 0.9), 6) AS p90, max(v) AS most FROM long GROUP BY 1")
def feature_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts, means, spreads and quantiles of all features at once."""
    got = S.summaries(shared_table(feature_table(spark, d), "features"), _NAMES, {"q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9})
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q1", "median", "q3", "p90")})


def halves(spark: SparkSession, d: str) -> list[str]:
    """Two folders with the first and the last half of the stream, each with its own lines and all packages."""
    orders = table(spark, d, "orders")
    (middle,) = quantiles(orders.select(A.seconds(F.col("o_orderdate")).alias("t")), "t", [0.5]) or [0.0]
    first = A.seconds(F.col("o_orderdate")) <= middle
    out = []
    for mine in (first, ~first):
        folder = shared_path(spark, "half")
        some = orders.where(mine)
        some.write.parquet(f"{folder}/orders.parquet")
        table(spark, d, "lineitem").join(some.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").write.parquet(f"{folder}/lineitem.parquet")
        table(spark, d, "part").write.parquet(f"{folder}/part.parquet")
        out.append(folder)
    return out


@query(_wide_sql())
def feature_table_by_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All features of a log that arrives in two chunks: the second run reads its own chunk and the state that the first left."""
    early, late = halves(spark, d)
    state = shared_path(spark, "state")
    first = features.compute_all(features.registry(), spark, early, next_state=f"{state}/1")
    return first.unionByName(features.compute_all(features.registry(), spark, late, state=f"{state}/1", next_state=f"{state}/2"))


def _sweep_sql() -> str:
    from dataclasses import replace

    base = next(f for f in features.registry() if f.name == "intra_pr_count")
    days = (30, 90, 365)
    return " UNION ALL ".join(f"SELECT {n} AS days, id, intra_pr_count FROM ({features.sql_of(replace(base, window=n * 86_400))})" for n in days)


@query(_sweep_sql())
def window_sweep(spark: SparkSession, d: str) -> DataFrame:
    """One feature for several window lengths."""
    from dataclasses import replace

    base = next(f for f in features.registry() if f.name == "intra_pr_count")
    parts = [features.compute(replace(base, window=n * 86_400), spark, d).select(F.lit(n).alias("days"), "id", "intra_pr_count") for n in (30, 90, 365)]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(sql("SELECT project, string_agg(submitter::VARCHAR, ',' ORDER BY submitter) AS people FROM (SELECT DISTINCT project, submitter FROM pr WHERE merged) GROUP BY 1"))
def project_user_lists(spark: SparkSession, d: str) -> DataFrame:
    people = A.activities(spark, d).where("not is_issue and merged").select("project", "submitter").distinct()
    return people.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list("submitter")), lambda x: x.cast("string")), ",").alias("people"))


@query(sql("SELECT submitter, n, rank() OVER (ORDER BY n DESC) AS place FROM (SELECT submitter, count(*) AS n FROM pr GROUP BY 1)"))
def submitter_frequency(spark: SparkSession, d: str) -> DataFrame:
    counts = A.activities(spark, d).where("not is_issue").groupBy("submitter").agg(F.count("*").alias("n"))
    # places from counts of counts, so that only as many rows as there are different counts are ordered
    sizes = counts.groupBy("n").agg(F.count("*").alias("_k"))
    place = cumulative(sizes.withColumn("_down", -F.col("n")), ["_down"], "_k", out="place").select("n", (F.col("place") + 1).cast("long").alias("place"))
    return counts.join(small(place), "n").select("submitter", "n", "place")
