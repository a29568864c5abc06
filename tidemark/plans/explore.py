"""Queries of the exploratory, sampling, statistics, model and streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import explore as E
from ..operators import forests as R
from ..operators import stats as S
from ..operators.common import quantiles, shared_table, small
from ..streaming import windows as W
from . import activity as A
from . import graphs
from .activity import sql, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return A.activities(spark, d).where("not is_issue").groupBy("submitter").agg(F.count("*").alias("n"))


@query(sql("SELECT t AS threshold, count(*) FILTER (WHERE n >= t) AS groups, CAST(coalesce(sum(n) FILTER (WHERE n >= t), 0) AS BIGINT) AS total FROM (SELECT submitter, count(*) AS n FROM pr GROUP BY 1), (VALUES (60), (85), (95), (110)) v(t) GROUP BY 1"))
def threshold_table(spark: SparkSession, d: str) -> DataFrame:
    return E.threshold_table(_counts(spark, d), "n", [60, 85, 95, 110])


@query("SELECT k AS suppkey, bool_or(total >= 4000) AS enough, max(total) AS best FROM (SELECT l_suppkey AS k, date_trunc('month', l_shipdate) AS m, sum(l_quantity) AS total FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def monthly_any_threshold(spark: SparkSession, d: str) -> DataFrame:
    months = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey"), F.trunc("l_shipdate", "month").alias("m")).agg(F.sum("l_quantity").alias("total"))
    return months.groupBy("suppkey").agg(F.max(F.col("total") >= 4000).alias("enough"), F.max("total").alias("best"))


@query("SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, count(*) AS n FROM orders GROUP BY 1, 2")
def year_month_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))


@query(sql("SELECT project, u, count(*) FILTER (WHERE kind = 'issue') AS issue, count(*) FILTER (WHERE kind = 'issue_comment') AS issue_comment, count(*) FILTER (WHERE kind = 'pr') AS pr, count(*) FILTER (WHERE kind = 'pr_comment') AS pr_comment FROM (SELECT project, submitter AS u, CASE WHEN is_issue THEN 'issue' ELSE 'pr' END AS kind FROM act UNION ALL SELECT project, commenter, CASE WHEN is_issue THEN 'issue_comment' ELSE 'pr_comment' END FROM com) GROUP BY 1, 2"))
def activity_pivot(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("is_issue"), "issue").otherwise("pr")
    led = A.activities(spark, d).select("project", F.col("submitter").alias("u"), kind.alias("kind"))
    said = A.comments(spark, d).select("project", F.col("commenter").alias("u"), F.concat(kind, F.lit("_comment")).alias("kind"))
    return led.unionByName(said).groupBy("project", "u").pivot("kind", ["issue", "issue_comment", "pr", "pr_comment"]).count().na.fill(0)


@query("WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin, count(*) AS n FROM orders, e GROUP BY 1")
def histogram30(spark: SparkSession, d: str) -> DataFrame:
    return E.histogram(table(spark, d, "orders"), "o_totalprice", 30)


@query("SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS least, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, max(o_totalprice) AS most FROM orders")
def describe_prices(spark: SparkSession, d: str) -> DataFrame:
    got = E.describe(table(spark, d, "orders"), "o_totalprice")
    return got.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q1", "median", "q3")})


@query(sql("SELECT project, round(count(*) FILTER (WHERE merged) * 1.0 / count(*), 9) AS share FROM pr GROUP BY 1"))
def merged_share(spark: SparkSession, d: str) -> DataFrame:
    return A.activities(spark, d).where("not is_issue").groupBy("project").agg(F.round(F.count_if(F.col("merged")) / F.count("*"), 9).alias("share"))


@query("WITH s AS (SELECT * FROM lineitem WHERE l_discount <> 0), q AS (SELECT quantile_cont(l_quantity, 0) AS a, quantile_cont(l_quantity, 0.25) AS b, quantile_cont(l_quantity, 0.5) AS c, quantile_cont(l_quantity, 0.75) AS d, quantile_cont(l_quantity, 1) AS e FROM lineitem WHERE l_quantity <> 0), bins AS (SELECT 0 AS bin, a AS lo, b AS hi FROM q UNION ALL SELECT 1, b, c FROM q UNION ALL SELECT 2, c, d FROM q UNION ALL SELECT 3, d, e FROM q) SELECT bin, quantile_cont(l_quantity, 0.5) AS middle, round(ln(avg(CAST(l_returnflag = 'R' AS INT)) / (1 - avg(CAST(l_returnflag = 'R' AS INT)))), 6) AS log_odds FROM lineitem JOIN bins ON l_quantity BETWEEN lo AND hi WHERE l_quantity <> 0 GROUP BY 1")
def log_odds_by_quantile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    return E.log_odds(rows, "l_quantity", "returned", [0.0, 0.25, 0.5, 0.75, 1.0]).withColumn("log_odds", F.round("log_odds", 6))


@query("SELECT count(*) FILTER (WHERE l_discount > 0.05 AND l_tax > 0.04) AS hh, count(*) FILTER (WHERE l_discount > 0.05 AND l_tax < 0.04) AS hl, count(*) FILTER (WHERE l_discount < 0.05 AND l_tax > 0.04) AS lh, count(*) FILTER (WHERE l_discount < 0.05 AND l_tax < 0.04) AS ll FROM lineitem")
def quadrants(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_discount"), F.col("l_tax")
    return table(spark, d, "lineitem").agg(F.count_if((x > 0.05) & (y > 0.04)).alias("hh"), F.count_if((x > 0.05) & (y < 0.04)).alias("hl"), F.count_if((x < 0.05) & (y > 0.04)).alias("lh"), F.count_if((x < 0.05) & (y < 0.04)).alias("ll"))


@query("SELECT k AS \"column\", zeros, n - zeros AS others, round(zeros * 100.0 / n, 6) AS percent, zeros * 100.0 / n > 80 AS is_rare FROM (SELECT count(*) AS n, count(*) FILTER (WHERE l_discount = 0) AS a, count(*) FILTER (WHERE l_tax = 0) AS b FROM lineitem), (VALUES ('l_discount'), ('l_tax')) v(k), LATERAL (SELECT CASE k WHEN 'l_discount' THEN a ELSE b END AS zeros)")
def zero_inflation(spark: SparkSession, d: str) -> DataFrame:
    return E.zero_inflation(table(spark, d, "lineitem"), ["l_discount", "l_tax"]).withColumn("percent", F.round("percent", 6))


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.9) AS c, quantile_cont(o_totalprice, 1) AS d FROM orders) SELECT CASE WHEN o_totalprice > a AND o_totalprice <= b THEN 0 WHEN o_totalprice > b AND o_totalprice <= c THEN 1 WHEN o_totalprice > c AND o_totalprice <= d THEN 2 END AS box, count(*) AS n FROM orders, q WHERE o_totalprice > a GROUP BY 1")
def percentile_boxes(spark: SparkSession, d: str) -> DataFrame:
    return E.percentile_boxes(table(spark, d, "orders"), "o_totalprice", [0.0, 0.5, 0.9, 1.0])


@query("WITH q AS (SELECT quantile_cont(l_quantity, 0.98) AS a, quantile_cont(l_extendedprice, 0.98) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem, q WHERE l_quantity > a OR l_extendedprice > b GROUP BY 1, 2")
def top_percentile_members(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    (a,), (b,) = (quantiles(rows, c, [0.98]) for c in ("l_quantity", "l_extendedprice"))
    return rows.where((F.col("l_quantity") > a) | (F.col("l_extendedprice") > b)).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT round((SELECT avg(l_quantity) FROM lineitem), 6) AS micro, round(avg(m), 6) AS macro FROM (SELECT avg(l_quantity) AS m FROM lineitem GROUP BY l_orderkey)")
def macro_micro_mean(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("s"), F.count("*").alias("n"))
    return per.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("s") / F.col("n")), 6).alias("macro"))


@query("WITH c AS (SELECT split_part(regexp_extract(url, '^https?://([^/]+)', 1), '.', 1) AS owner, count(*) AS n FROM pages GROUP BY 1) SELECT count(*) AS owners, count(*) FILTER (WHERE n > 3) AS large, round(coalesce(sum(n) FILTER (WHERE n > 3), 0) * 1.0 / sum(n), 6) AS share FROM c")
def owner_concentration(spark: SparkSession, d: str) -> DataFrame:
    owner = F.split_part(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("."), F.lit(1))
    c = table(spark, d, "pages").groupBy(owner.alias("owner")).agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("owners"), F.count_if(F.col("n") > 3).alias("large"), F.round(F.coalesce(F.sum(F.when(F.col("n") > 3, F.col("n"))), F.lit(0)) / F.sum("n"), 6).alias("share"))


@query(sql("SELECT t AS threshold, round(count(*) FILTER (WHERE k < t) * 100.0 / count(*), 6) AS people, round(sum(n) FILTER (WHERE k < t) * 100.0 / sum(n), 6) AS prs FROM (SELECT submitter, count(DISTINCT project) AS k, count(*) AS n FROM pr GROUP BY 1), (VALUES (23), (24), (25)) v(t) GROUP BY 1"))
def projects_per_submitter(spark: SparkSession, d: str) -> DataFrame:
    per = A.activities(spark, d).where("not is_issue").groupBy("submitter").agg(F.countDistinct("project").alias("k"), F.count("*").alias("n"))
    each = per.select("k", "n", F.explode(F.array(F.lit(23), F.lit(24), F.lit(25))).alias("threshold"))
    less = F.col("k") < F.col("threshold")
    return each.groupBy("threshold").agg(F.round(F.count_if(less) * 100.0 / F.count("*"), 6).alias("people"), F.round(F.sum(F.when(less, F.col("n"))) * 100.0 / F.sum("n"), 6).alias("prs"))


@query("SELECT event_type, round(avg(event_id), 4) AS middle, round(stddev_pop(event_id), 4) AS spread, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def progress_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("event_id"), 4).alias("middle"), F.round(F.stddev_pop("event_id"), 4).alias("spread"), F.countDistinct("user_id").alias("users"))


@query(sql("SELECT label, round((1 - n * 1.0 / sum(n) OVER ()) / (count(*) OVER () - 1), 9) AS weight FROM (SELECT label, count(*) AS n FROM edges GROUP BY 1)", graphs._EDGES))
def edge_weights(spark: SparkSession, d: str) -> DataFrame:
    counts = graphs.received(spark, d).groupBy("label").agg(F.sum("n").alias("n"))
    return E.edge_weights(counts).withColumn("weight", F.round("weight", 9))


_WEIGHED = f"{graphs._EDGES}, w AS (SELECT label, (1 - n * 1.0 / sum(n) OVER ()) / (count(*) OVER () - 1) AS weight FROM (SELECT label, count(*) AS n FROM edges GROUP BY 1))"


@query(sql("SELECT tgt AS person, round(sum(weight), 6) AS centrality FROM edges JOIN w USING (label) GROUP BY 1", _WEIGHED))
def weighted_centrality(spark: SparkSession, d: str) -> DataFrame:
    per = shared_table(graphs.received(spark, d), "received")
    weights = E.edge_weights(per.groupBy("label").agg(F.sum("n").alias("n")))
    return per.join(small(weights), "label").groupBy(F.col("tgt").alias("person")).agg(F.round(F.sum(F.col("n") * F.col("weight")), 6).alias("centrality"))


@query(sql("SELECT src, tgt, round(sum(weight), 6) AS strength FROM edges JOIN w USING (label) GROUP BY 1, 2", _WEIGHED))
def link_strength(spark: SparkSession, d: str) -> DataFrame:
    per, labels = graphs.links(spark, d)
    weights = E.edge_weights(labels)
    return per.join(small(weights), "label").groupBy("src", "tgt").agg(F.round(F.sum(F.col("n") * F.col("weight")), 6).alias("strength"))


@query("WITH x AS (SELECT o_orderkey, ln(1 + o_totalprice) AS v FROM orders), e AS (SELECT min(v) AS lo, max(v) AS hi FROM x) SELECT o_orderkey, round((v - lo) / (hi - lo), 6) AS scaled FROM x, e")
def log1p_minmax(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.log1p("o_totalprice").alias("scaled"))
    return E.min_max(rows, ["scaled"]).withColumn("scaled", F.round("scaled", 6))


@query("SELECT o_orderkey, round(log10(1 + x), 9) AS log10, round(ln(1 + x), 9) AS log1p, round(sqrt(1 + x), 9) AS sqrt, round(cbrt(1 + x), 9) AS cbrt, round(1 / (1 + x), 9) AS inverse, round(x * x, 9) AS square, round(x * x * x, 9) AS cube, round(ln(1 + ln(1 + x)), 9) AS loglog, round(ln(0.1 + x), 9) AS log_point_1, round(ln(0.01 + x), 9) AS log_point_01, round(ln(0.001 + x), 9) AS log_point_001, round(1 - x, 9) AS complement FROM (SELECT o_orderkey, o_totalprice / 1000000 AS x FROM orders)")
def transform_library(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("o_totalprice") / 1000000
    return table(spark, d, "orders").select("o_orderkey", *[F.round(f(x), 9).alias(n) for n, f in E.TRANSFORMS.items()])


@query(sql("SELECT max(n) AS cap FROM (SELECT n, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS k FROM (SELECT submitter, count(*) AS n FROM pr GROUP BY 1)) WHERE r <= floor(k * 0.9)"))
def sample_caps(spark: SparkSession, d: str) -> DataFrame:
    return E.sample_cap(_counts(spark, d), "n", 0.9)


@query(sql("SELECT submitter, least(count(*), 80) AS n FROM pr GROUP BY 1"))
def capped_sample_sizes(spark: SparkSession, d: str) -> DataFrame:
    return E.capped_sample(A.activities(spark, d).where("not is_issue"), "submitter", "id", 80).groupBy("submitter").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, CAST(ceil(1.96 * 1.96 * 0.787 / (0.0025 + 1.96 * 1.96 * 0.787 / (1000 * (n_nationkey + 1)))) AS BIGINT) AS needed FROM nation")
def sample_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", E.sample_size((F.col("n_nationkey") + 1) * 1000, 0.787).cast("long").alias("needed"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier QUALIFY place <= 10")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10)
    return top.select("s_suppkey", F.row_number().over(Window.orderBy(F.desc("s_acctbal"), "s_suppkey")).cast("long").alias("place"))


@query(sql("SELECT id, 0 AS payload, 42 + dense_rank() OVER (ORDER BY first) AS project_code FROM (SELECT id, min(seq) OVER (PARTITION BY project) AS first FROM pr)"))
def obfuscate(spark: SparkSession, d: str) -> DataFrame:
    prs = A.activities(spark, d).where("not is_issue")
    codes = prs.groupBy("project").agg(F.min("seq").alias("first")).select("project", (F.row_number().over(Window.orderBy("first")) + 42).cast("long").alias("project_code"))
    return prs.join(small(codes), "project").select("id", F.lit(0).alias("payload"), "project_code")


_RANKS = "r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b, rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2.0 AS c FROM lineitem)"


@query(f"WITH {_RANKS} SELECT 'l_quantity' AS a, 'l_discount' AS b, round(corr(a, b), 6) AS rho FROM r UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(a, c), 6) FROM r UNION ALL SELECT 'l_discount', 'l_tax', round(corr(b, c), 6) FROM r")
def spearman_pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.spearman(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).withColumn("rho", F.round("rho", 6))


@query(sql("SELECT round(sum((n - m) * (n - m) / m), 6) AS statistic, count(*) - 1 AS degrees FROM (SELECT n, avg(n) OVER () AS m FROM (SELECT project, count(*) AS n FROM pr GROUP BY 1))"))
def chi2_statistic(spark: SparkSession, d: str) -> DataFrame:
    counts = A.activities(spark, d).where("not is_issue").groupBy("project").agg(F.count("*").alias("n"))
    return S.chi_square(counts).withColumn("statistic", F.round("statistic", 6))


_TABLE = "t AS (SELECT count(*) FILTER (WHERE merged AND comments > 3)::DOUBLE AS tt, count(*) FILTER (WHERE merged AND NOT comments > 3)::DOUBLE AS tf, count(*) FILTER (WHERE NOT merged AND comments > 3)::DOUBLE AS ft, count(*) FILTER (WHERE NOT merged AND NOT comments > 3)::DOUBLE AS ff FROM pr)"


@query(sql("SELECT round((tt + tf + ft + ff) * power(greatest(abs(tt * ff - tf * ft) - (tt + tf + ft + ff) / 2, 0), 2) / ((tt + tf) * (ft + ff) * (tt + ft) * (tf + ff)), 6) AS statistic, round(tt * ff / (tf * ft), 6) AS odds_ratio FROM t", _TABLE))
def contingency_odds(spark: SparkSession, d: str) -> DataFrame:
    got = S.contingency(A.activities(spark, d).where("not is_issue"), F.col("merged"), F.col("comments") > 3)
    return got.select(F.round("statistic", 6).alias("statistic"), F.round("odds_ratio", 6).alias("odds_ratio"))


@query(sql("SELECT tt AS tp, ft AS fp, tf AS fn, ff AS tn, round((tt + ff) / (tt + tf + ft + ff), 6) AS accuracy, round(tt / (tt + ft), 6) AS precision, round(tt / (tt + tf), 6) AS recall, round(2 * tt / (2 * tt + ft + tf), 6) AS f1 FROM t", _TABLE))
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    got = S.confusion(A.activities(spark, d).where("not is_issue"), F.col("merged"), F.col("comments") > 3)
    return got.select(*[F.col(c).cast("double").alias(c) for c in ("tp", "fp", "fn", "tn")], *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _model_rows(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return E.min_max(lines, _FEATURES).withColumn("label", (F.col("l_returnflag") == "R").cast("double")).withColumn("row_key", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


def _determinant(rows: tuple[int, ...], columns: tuple[int, ...]) -> str:
    """A determinant of sums of products g<i><j>, as SQL, by its first row."""
    if not rows:
        return "1.0"
    first, rest = rows[0], rows[1:]
    terms = [f"{'-' if k % 2 else '+'} g{min(first, j)}{max(first, j)} * ({_determinant(rest, columns[:k] + columns[k + 1 :])})" for k, j in enumerate(columns)]
    return " ".join(terms).removeprefix("+ ")


def _vif_sql() -> str:
    scaled = ", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS x{i}" for i, c in enumerate(_FEATURES))
    sums = ", ".join(f"sum(x{i} * x{j}) AS g{i}{j}" for i in range(4) for j in range(i, 4))
    every = (0, 1, 2, 3)
    minors = [(tuple(x for x in every if x != i), i) for i in every]
    return f"WITH x AS (SELECT {scaled} FROM lineitem), g AS (SELECT {sums} FROM x) " + " UNION ALL ".join(f"SELECT '{_FEATURES[i]}' AS column, round(g{i}{i} * ({_determinant(m, m)}) / ({_determinant(every, every)}), 6) AS vif FROM g" for m, i in minors)


@query(_vif_sql())
def vif(spark: SparkSession, d: str) -> DataFrame:
    return S.vif(_model_rows(spark, d), _FEATURES).withColumn("vif", F.round("vif", 6))


@query()
def glm_outliers(spark: SparkSession, d: str) -> DataFrame:
    return S.influence(_model_rows(spark, d), _FEATURES, "label").select("row_key", "cooks_distance", "residual_z", "outlier")


@query()
def mixed_model(spark: SparkSession, d: str) -> DataFrame:
    return S.random_intercepts(_model_rows(spark, d).withColumn("project", F.col("l_orderkey") % 25), _FEATURES, "label", "project").table(spark)


@query()
def rf_importance(spark: SparkSession, d: str) -> DataFrame:
    rows = _model_rows(spark, d)
    edges = R.bin_edges(rows, _FEATURES)
    return R.counted_importances(R.counted_forest(R.counted(rows, _FEATURES, "label", edges), _FEATURES, "label", edges), _FEATURES, spark)


@query()
def rf_cross_validation(spark: SparkSession, d: str) -> DataFrame:
    return R.counted_cross_validated(_model_rows(spark, d), _FEATURES, "label", "row_key")


@query()
def rf_partial_dependence(spark: SparkSession, d: str) -> DataFrame:
    """Partial dependence on all columns, from the 1st to the 99th percentile."""
    rows = _model_rows(spark, d)
    edges = R.bin_edges(rows, _FEATURES)
    groups = R.counted(rows, _FEATURES, "label", edges)
    return R.counted_partial_dependence(R.counted_forest(groups, _FEATURES, "label", edges), groups, rows, _FEATURES)


@query(sql(f"SELECT 'smoothed' AS kind, round((tt + 1) * (ff + 1) / ((tf + 1) * (ft + 1)), 6) AS odds_ratio FROM t", _TABLE))
def fisher_odds(spark: SparkSession, d: str) -> DataFrame:
    prs = A.activities(spark, d).where("not is_issue")
    a, b = F.col("merged"), F.col("comments") > 3
    n = prs.agg(F.count_if(a & b).alias("tt"), F.count_if(a & ~b).alias("tf"), F.count_if(~a & b).alias("ft"), F.count_if(~a & ~b).alias("ff"))
    return n.select(F.lit("smoothed").alias("kind"), F.round((F.col("tt") + 1) * (F.col("ff") + 1) / ((F.col("tf") + 1) * (F.col("ft") + 1)), 6).alias("odds_ratio"))




def _events(spark: SparkSession, d: str) -> DataFrame:
    return W.source(spark, d, table(spark, d, "events"), "events.parquet").withColumn("ts", F.to_timestamp("ts"))


def _plain_start(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in df.columns if c in ("start", "end")})


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _plain_start(W.drained(W.tumbling(_events(spark, d), "1 day"), "tumbling", "complete"))


@query("SELECT strftime(b + to_hours(CAST(k AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS b FROM events), (VALUES (0), (-1), (-2)) v(k) GROUP BY 1")
def events_sliding_count(spark: SparkSession, d: str) -> DataFrame:
    return _plain_start(W.drained(W.sliding(_events(spark, d), "3 hours", "1 hour"), "sliding", "complete"))


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 2 HOURS, '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _plain_start(W.drained(W.sessions(_events(spark, d), "2 hours"), "sessions", "complete"))
