"""Queries of the cleaning, ordering, join and nested-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators.common import cumulative, fill_forward, neighbours, observed_write, shared_path, small
from ..operators.point_in_time import first_seen, greedy_chunks
from . import activity as A
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


def _people(spark: SparkSession, d: str) -> DataFrame:
    """Customers as accounts: some are bots, ghosts or blocked."""
    k = F.col("c_custkey") % 50
    login = F.when(k == 0, "Ghost").when(k == 1, F.concat(F.lit("x"), F.col("c_custkey").cast("string"), F.lit("[bot]"))).when(k == 2, "MrsFlux").otherwise(F.col("c_name"))
    return table(spark, d, "customer").select(
        "c_custkey",
        login.alias("login"),
        F.when(F.col("c_custkey") % 37 == 5, "Bot").otherwise("User").alias("user_type"),
        F.concat(F.lit("u"), (F.col("c_custkey") % 400).cast("string"), F.lit("@mail.org")).alias("email"),
        F.col("c_name").alias("name"),
    )


_PEOPLE = """people AS (SELECT c_custkey, CASE c_custkey % 50 WHEN 0 THEN 'Ghost' WHEN 1 THEN 'x' || c_custkey || '[bot]' WHEN 2 THEN 'MrsFlux' ELSE c_name END AS login,
  CASE WHEN c_custkey % 37 = 5 THEN 'Bot' ELSE 'User' END AS user_type, 'u' || (c_custkey % 400) || '@mail.org' AS email, c_name AS name FROM customer)"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").join(_people(spark, d), F.col("o_custkey") == F.col("c_custkey"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    odd = F.col("o_orderkey") % 41 == 0
    rows = orders.select(F.col("o_orderkey").alias("id"), "login", "user_type", "email", "name", F.when(odd, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(stamp("o_orderdate")).alias("created_at"), F.when(F.col("o_orderkey") % 29 > 0, stamp("o_orderdate")).alias("closed_at"))
    listed = _people(spark, d).where("c_custkey % 61 = 3").select("name", "email")
    logins = _people(spark, d).where("c_custkey % 71 = 4").select("login")
    return C.mark_listed(rows, listed, logins)


_RAW = f"""{_PEOPLE}, raw AS (SELECT o_orderkey AS id, login, user_type, email, name,
  o_orderkey % 41 <> 0 AS p, o_orderkey % 29 > 0 AND o_orderdate <= TIMESTAMP '2000-01-12' AS c, lower(user_type) <> 'bot' AS u, lower(login) <> 'ghost' AS a,
  NOT (email IN (SELECT email FROM people WHERE c_custkey % 61 = 3) OR lower(login) IN (SELECT lower(name) FROM people WHERE c_custkey % 61 = 3) OR lower(name) IN (SELECT lower(name) FROM people WHERE c_custkey % 61 = 3)) AS d,
  lower(login) NOT IN (SELECT lower(login) FROM people WHERE c_custkey % 71 = 4) AS g,
  lower(login) NOT IN ('fabric8cd', 'mrsflux', 'greenkeeperio-bot', 'ovh-ux-cds') AS b, login NOT LIKE '%[bot]%' AS n FROM orders JOIN people ON o_custkey = c_custkey)"""


@query(f"WITH {_RAW} SELECT CASE WHEN NOT p THEN 'p' WHEN NOT c THEN 'c' WHEN NOT u THEN 'u' WHEN NOT a THEN 'a' WHEN NOT d THEN 'd' WHEN NOT g THEN 'g' WHEN NOT b THEN 'b' WHEN NOT n THEN 'n' ELSE 'kept' END AS verdict, count(*) AS n_rows FROM raw GROUP BY 1")
def filter_chain_rejections(spark: SparkSession, d: str) -> DataFrame:
    chained = C.filter_chain(_raw(spark, d), "pcuadgbn", C.row_filters("2000-01-12 00:00:00"))
    return chained.groupBy(F.coalesce("rejected_by", F.lit("kept")).alias("verdict")).agg(F.count("*").alias("n_rows"))


@query(f"WITH {_RAW} SELECT CASE WHEN NOT p THEN 'p' WHEN NOT c THEN 'c' WHEN NOT u THEN 'u' WHEN NOT a THEN 'a' WHEN NOT d THEN 'd' WHEN NOT g THEN 'g' WHEN NOT b THEN 'b' WHEN NOT n THEN 'n' ELSE 'kept' END AS verdict, count(*) AS n_rows FROM raw GROUP BY 1")
def filter_chain_observed(spark: SparkSession, d: str) -> DataFrame:
    """The same counts, taken while the rows that are kept are written: no pass of their own."""
    chained = C.filter_chain(_raw(spark, d), "pcuadgbn", C.row_filters("2000-01-12 00:00:00"))
    path = shared_path(spark, "kept")
    verdict = F.coalesce("rejected_by", F.lit("kept"))
    seen = observed_write(chained, lambda rows: rows.where("rejected_by is null").write.parquet(path), **{v: F.count_if(verdict == v) for v in (*"pcuadgbn", "kept")})
    kept = spark.read.parquet(path).count()
    if kept != seen["kept"]:
        raise RuntimeError(f"{kept} rows were written and {seen['kept']} observed")
    return spark.createDataFrame([(v, n) for v, n in seen.items() if n and not v.startswith("_")], "verdict string, n_rows long")


@query(f"WITH {_RAW} SELECT id FROM raw WHERE p AND c AND u AND a AND d AND g AND b AND n")
def filter_chain_kept(spark: SparkSession, d: str) -> DataFrame:
    return C.filter_chain(_raw(spark, d), "pcuadgbn", C.row_filters("2000-01-12 00:00:00")).where("rejected_by is null").select("id")


@query(sql("SELECT id, ts, dataset_idx, CASE dataset_idx WHEN 0 THEN 'issues' ELSE 'pull-requests' END AS data_type, row_number() OVER (ORDER BY ts, dataset_idx, seq) AS place FROM (SELECT *, CASE WHEN is_issue THEN 0 ELSE 1 END AS dataset_idx FROM act)"))
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    """The merged stream; places come from ranges of its order, not from one global sort."""
    acts = A.activities(spark, d)
    both = C.ordered_union([acts.where("is_issue"), acts.where("not is_issue")], ["issues", "pull-requests"])
    placed = cumulative(both.withColumn("_one", F.lit(1)), ["ts", "dataset_idx", "seq"], "_one", out="place")
    return placed.select("id", "ts", "dataset_idx", "data_type", (F.col("place") + 1).cast("long").alias("place"))


@query("SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2")
def keep_first_dedup(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return C.keep_first(lines, ["l_orderkey", "l_linenumber"], ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT l_orderkey, count(*) - count(DISTINCT l_linenumber) AS n_repeated FROM lineitem GROUP BY 1")
def duplicate_entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.count("*") - F.countDistinct("l_linenumber")).alias("n_repeated"))


@query("SELECT coalesce(a.k, b.k) AS k, n_orders, n_items FROM (SELECT o_custkey % 500 * 2 AS k, count(*) AS n_orders FROM orders GROUP BY 1) a FULL JOIN (SELECT l_partkey % 700 AS k, count(*) AS n_items FROM lineitem GROUP BY 1) b ON a.k = b.k")
def merge_same_key_rows(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").groupBy((F.col("o_custkey") % 500 * 2).alias("k")).agg(F.count("*").alias("n_orders"))
    b = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 700).alias("k")).agg(F.count("*").alias("n_items"))
    return a.join(b, "k", "full")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1")
def day_bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


#: The chain of chunk starts, as SQL, and each activity's chunk.
_CHAIN = "chain AS (SELECT min(ts) AS s FROM act UNION ALL SELECT (SELECT min(ts) FROM act WHERE ts > chain.s + 7776000) FROM chain WHERE (SELECT min(ts) FROM act WHERE ts > chain.s + 7776000) IS NOT NULL)"
CHUNKED = f"{_CHAIN}, chunked AS (SELECT act.*, chunk_id FROM act JOIN (SELECT s, lead(s) OVER (ORDER BY s) AS e, row_number() OVER (ORDER BY s) - 1 AS chunk_id FROM chain) ON ts >= s AND (e IS NULL OR ts < e))"


def recursive(body: str, more: str) -> str:
    return sql(body, more).replace("WITH ", "WITH RECURSIVE ", 1)


@query(recursive("SELECT id, chunk_id FROM chunked", CHUNKED))
def greedy_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return greedy_chunks(A.activities(spark, d).select("id", "ts"), A.WINDOW).select("id", "chunk_id")


@query(sql("SELECT id FROM act WHERE submitter IN (SELECT submitter FROM act GROUP BY 1 HAVING count(*) >= 155)"))
def min_activity_groups(spark: SparkSession, d: str) -> DataFrame:
    return C.group_at_least(A.activities(spark, d), ["submitter"], 155).select("id")


@query(sql("SELECT id FROM act WHERE is_issue AND submitter IN (SELECT submitter FROM pr GROUP BY 1 HAVING count(*) >= 95)"))
def issues_of_kept_groups(spark: SparkSession, d: str) -> DataFrame:
    acts = A.activities(spark, d)
    kept = acts.where("not is_issue").groupBy("submitter").count().where("count >= 95").select("submitter")
    return acts.where("is_issue").join(small(kept), "submitter", "left_semi").select("id")


#: Numbers that several activities of a project share, so that some issues are pull requests and some aren't.
NUMBERS = 7000
_SIDES = f"p AS (SELECT project, id % {NUMBERS} AS number, seq, comments AS note, submitter FROM pr), i AS (SELECT project, id % {NUMBERS} AS number, max(seq) AS seq, max_by(integrator, seq) AS note, max_by(ts, seq) AS ts FROM act WHERE is_issue GROUP BY 1, 2)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    acts = A.activities(spark, d).withColumn("number", F.col("id") % NUMBERS)
    prs = acts.where("not is_issue").select("project", "number", "seq", F.col("comments").alias("note"), "submitter")
    return prs, acts.where("is_issue").select("project", "number", "seq", F.col("integrator").alias("note"), "ts")


@query(sql("SELECT project, number, p.seq, coalesce(p.note, i.note) AS note, submitter, ts FROM p JOIN i USING (project, number)", _SIDES))
def pr_issue_merge(spark: SparkSession, d: str) -> DataFrame:
    prs, issues = _sides(spark, d)
    return C.merge_pr_issue(prs, issues, ["project", "number"])


@query(sql(f"SELECT id FROM act WHERE is_issue AND NOT EXISTS (SELECT 1 FROM p WHERE p.project = act.project AND p.number = act.id % {NUMBERS})", _SIDES))
def issues_not_prs(spark: SparkSession, d: str) -> DataFrame:
    prs, _ = _sides(spark, d)
    return A.activities(spark, d).where("is_issue").withColumn("number", F.col("id") % NUMBERS).join(prs, ["project", "number"], "left_anti").select("id")


@query(sql("SELECT id, merged, NULL::BIGINT AS closed_by FROM pr WHERE merged UNION ALL SELECT id, merged, s_suppkey FROM pr JOIN supplier ON s_suppkey = id % 150 WHERE NOT merged"))
def closed_by_backfill(spark: SparkSession, d: str) -> DataFrame:
    prs = A.activities(spark, d).where("not is_issue").select("id", "merged", (F.col("id") % 150).alias("k"))
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").alias("closed_by"))
    return C.backfill(prs, known, ["k"], "closed_by").select("id", "merged", "closed_by")


@query(sql("SELECT id FROM pr WHERE NOT merged AND integrator IS NULL"))
def closed_by_to_fetch(spark: SparkSession, d: str) -> DataFrame:
    return A.activities(spark, d).where("not is_issue and not merged and integrator is null").select("id")


@query("SELECT l_partkey AS k FROM lineitem INTERSECT SELECT o_custkey FROM orders")
def list_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).intersect(table(spark, d, "orders").select("o_custkey"))


@query("SELECT l_partkey AS k FROM lineitem EXCEPT SELECT o_custkey FROM orders")
def list_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).subtract(table(spark, d, "orders").select("o_custkey"))


@query("SELECT l_partkey AS k FROM lineitem UNION SELECT o_custkey FROM orders")
def list_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).union(table(spark, d, "orders").select("o_custkey")).distinct()


@query(sql("SELECT CASE WHEN integrator IS NULL THEN 'no integrator' WHEN comments = 0 THEN 'no comments' WHEN submitter IS NULL THEN 'no submitter' ELSE 'valid' END AS reason, count(*) AS n_rows FROM pr GROUP BY 1"))
def invalid_reasons(spark: SparkSession, d: str) -> DataFrame:
    rules = [("no integrator", F.col("integrator").isNull()), ("no comments", F.col("comments") == 0), ("no submitter", F.col("submitter").isNull())]
    return A.activities(spark, d).where("not is_issue").groupBy(F.coalesce(C.first_reason(rules), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n_rows"))


@query("SELECT l_orderkey AS id, count(*) AS n_comments, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) AS commenters FROM lineitem GROUP BY 1")
def nested_projection(spark: SparkSession, d: str) -> DataFrame:
    raw = F.struct(F.struct(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("mood")).alias("user_data"), F.col("l_quantity").alias("size"))
    nested = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(raw).alias("comments_data"))
    kept = nested.select("id", F.transform("comments_data", lambda c: F.struct(c["user_data"]["id"].alias("id"))).alias("comments_data"))
    return kept.select("id", F.size("comments_data").cast("long").alias("n_comments"), F.array_join(F.transform(F.array_sort(F.transform("comments_data", lambda c: c["id"])), lambda x: x.cast("string")), ",").alias("commenters"))


@query(sql("SELECT commenter, count(*) AS n FROM com WHERE NOT is_issue GROUP BY 1"))
def comments_per_user(spark: SparkSession, d: str) -> DataFrame:
    return A.comments(spark, d).where("not is_issue").groupBy("commenter").agg(F.count("*").alias("n"))


@query(sql("SELECT project, count(DISTINCT u) AS n_people FROM (SELECT project, submitter AS u FROM act UNION ALL SELECT project, integrator FROM act UNION ALL SELECT project, commenter FROM com) WHERE u IS NOT NULL GROUP BY 1"))
def people_per_project(spark: SparkSession, d: str) -> DataFrame:
    said = A.comments(spark, d).select("project", F.col("commenter").alias("u"))
    led = A.activities(spark, d).select("project", F.explode(F.array_compact(F.array("submitter", "integrator"))).alias("u"))
    return led.unionByName(said).distinct().groupBy("project").agg(F.count("*").alias("n_people"))


@query(sql("SELECT round(count(*) FILTER (WHERE comments > 0) * 100.0 / count(*), 6) AS percent, count(*) FILTER (WHERE integrator IS NULL) AS n_without FROM act"))
def nonempty_array_share(spark: SparkSession, d: str) -> DataFrame:
    return A.activities(spark, d).agg(F.round(F.count_if(F.col("comments") > 0) * 100.0 / F.count("*"), 6).alias("percent"), F.count_if(F.col("integrator").isNull()).alias("n_without"))


@query(sql("SELECT id, coalesce(submitter = integrator, false) AS same_user, comments > 0 AS has_comments, round((closed - ts) / 60.0, 6) AS minutes FROM pr LEFT JOIN ended ON ended.k = id", "ended AS (SELECT l_orderkey AS k, max(CAST(epoch(l_shipdate) AS BIGINT)) AS closed FROM lineitem GROUP BY 1)"))
def row_controls(spark: SparkSession, d: str) -> DataFrame:
    """Flags of a row, and how many minutes it was open: from its order to its last shipment."""
    ended = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max(A.seconds(F.col("l_shipdate"))).alias("closed"))
    rows = A.activities(spark, d).where("not is_issue").join(ended, "id", "left")
    return rows.select("id", F.coalesce(F.col("submitter") == F.col("integrator"), F.lit(False)).alias("same_user"), (F.col("comments") > 0).alias("has_comments"), F.round((F.col("closed") - F.col("ts")) / 60.0, 6).alias("minutes"))


@query("SELECT doc_id, coalesce(text LIKE '%#%', false) AS has_hashtag, contains(coalesce(text, ''), '[') AS has_bracket, round(ln(1 + coalesce(n_chars, 0)), 6) AS ln_chars FROM documents")
def has_hashtag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.contains("text", F.lit("#")), F.lit(False)).alias("has_hashtag"), F.contains(F.coalesce("text", F.lit("")), F.lit("[")).alias("has_bracket"), F.round(F.log1p(F.coalesce("n_chars", F.lit(0))), 6).alias("ln_chars"))


@query(sql("SELECT id, row_number() OVER (PARTITION BY project, submitter ORDER BY ts, seq) = 1 AS first_time FROM pr"))
def first_time_contributor(spark: SparkSession, d: str) -> DataFrame:
    return first_seen(A.activities(spark, d).where("not is_issue"), ["project", "submitter"], "first_time").select("id", "first_time")


@query(sql("SELECT pr.id, coalesce(bool_or(c.commenter <> pr.submitter AND c.commenter <> coalesce(pr.integrator, -1) AND NOT EXISTS (SELECT 1 FROM pr m WHERE m.merged AND m.project = pr.project AND m.submitter = c.commenter AND (m.ts < pr.ts OR (m.ts = pr.ts AND m.seq < pr.seq)))), false) AS external FROM pr LEFT JOIN com c ON c.id = pr.id GROUP BY 1"))
def external_comment(spark: SparkSession, d: str) -> DataFrame:
    """Whether someone comments who neither submitted, integrated nor had a merged pull request in the project before."""
    prs = A.activities(spark, d).where("not is_issue")
    known = prs.where("merged").groupBy("project", F.col("submitter").alias("commenter")).agg(F.min(F.struct("ts", "seq")).alias("since"))
    said = A.comments(spark, d).where("not is_issue").join(known, ["project", "commenter"], "left")
    outside = (F.col("commenter") != F.col("submitter")) & (F.col("commenter") != F.coalesce("integrator", F.lit(-1))) & (F.col("since").isNull() | (F.col("since") >= F.struct("ts", "seq")))
    hit = said.groupBy("id").agg(F.max(outside).alias("external"))
    return prs.select("id").join(hit, "id", "left").select("id", F.coalesce("external", F.lit(False)).alias("external"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '([^/]+)$', 1) AS last_part, split_part(regexp_extract(url, '^https?://([^/]+)', 1), '.', 1) AS first_label FROM pages")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return table(spark, d, "pages").select("page_id", host.alias("host"), F.regexp_extract("url", "([^/]+)$", 1).alias("last_part"), F.split_part(host, F.lit("."), F.lit(1)).alias("first_label"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%-m-%Y') AS month FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_format("ts", "M-yyyy").alias("month"))


@query("SELECT event_id, last_value(e IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS e FROM events)")
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("filled"))
    return fill_forward(rows, ["user_id"], ["event_id"], ["filled"]).select("event_id", "filled")


@query("SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events")
def neighbour_pairs(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], "event_id", "prev", "next").select("event_id", "prev", "next")
