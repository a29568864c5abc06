"""Queries of the registry, account merging, model tables, samples, nested data and file formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import people as P
from ..operators import cleaning as C
from ..operators import explore as E
from ..operators import graph as G
from ..operators import identity as I
from ..operators import registry as R
from ..operators import stats as S
from ..operators.common import cumulative, quantiles, shared_path, shared_table, small
from ..operators.point_in_time import first_seen, greedy_chunks
from ..sources import readers, writers
from . import activity as A
from . import cleaning, explore, graphs
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


# Parts as registry rows, in file order by p_partkey: several packages share a repository, some have none.
_REG = """reg AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS place, 'pkg' || p_partkey AS name,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'Own' || (p_partkey % 7) || '/Repo' || (p_partkey % 300) END AS repo,
  CASE WHEN p_size % 13 = 0 THEN 'true' ELSE 'false' END AS fork, CASE p_partkey % 4 WHEN 0 THEN 'GitLab' WHEN 1 THEN 'Bitbucket' ELSE 'GitHub' END AS host,
  CASE WHEN p_size % 5 = 0 THEN 'Pypi' ELSE 'NPM' END AS platform FROM part),
dp AS (SELECT CAST(p_partkey AS VARCHAR) AS focal, CASE WHEN p_size % 10 = 0 THEN '' WHEN p_size % 10 = 1 THEN CAST(p_partkey AS VARCHAR) ELSE CAST(p_partkey // 2 AS VARCHAR) END AS other FROM part),
dr AS (SELECT 'OWN' || (p_partkey % 7) || '/repo' || (p_partkey % 330) AS repo, CASE WHEN p_size % 9 = 0 THEN '' ELSE CAST(p_partkey // 3 AS VARCHAR) END AS other FROM part),
ids AS (SELECT lower(repo) AS name, max_by(id, place) AS id FROM reg GROUP BY 1),
dmap AS (SELECT focal, other FROM dp WHERE focal <> other UNION SELECT ids.id, dr.other FROM dr JOIN ids ON ids.name = lower(dr.repo) WHERE dr.other <> '')"""


def _registry(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = table(spark, d, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    repo = F.when(k % 11 == 0, "").otherwise(text("Own", k % 7, "/Repo", k % 300))
    host = F.when(k % 4 == 0, "GitLab").when(k % 4 == 1, "Bitbucket").otherwise("GitHub")
    projects = part.select(k.cast("string").alias("id"), k.alias("place"), text("pkg", k).alias("name"), repo.alias("repo"), F.when(size % 13 == 0, "true").otherwise("false").alias("fork"), host.alias("host"), F.when(size % 5 == 0, "Pypi").otherwise("NPM").alias("platform"))
    other = F.when(size % 10 == 0, "").when(size % 10 == 1, k.cast("string")).otherwise(F.floor(k / 2).cast("string"))
    packages = part.select(k.cast("string").alias("focal"), other.alias("other"))
    repositories = part.select(text("OWN", k % 7, "/repo", k % 330).alias("repo"), F.when(size % 9 == 0, "").otherwise(F.floor(k / 3).cast("string")).alias("other"))
    return packages, repositories, projects


@query(f"WITH {_REG} SELECT focal, other FROM dmap")
def dependency_map(spark: SparkSession, d: str) -> DataFrame:
    return R.dependency_map(*_registry(spark, d))


@query(f"WITH {_REG} SELECT focal, other FROM dmap")
def dependency_map_kept(spark: SparkSession, d: str) -> DataFrame:
    """The map as it is stored by a first call and read by a second."""
    path = shared_path(spark, "dependency-map")
    R.kept_table(spark, path, lambda: R.dependency_map(*_registry(spark, d)))
    return R.kept_table(spark, path, lambda: spark.range(0))


@query(f"WITH {_REG} SELECT count(*) AS missing FROM dr WHERE lower(repo) NOT IN (SELECT name FROM ids)")
def unresolved_repositories(spark: SparkSession, d: str) -> DataFrame:
    _, repositories, projects = _registry(spark, d)
    return R.unresolved(repositories, projects).agg(F.count("*").alias("missing"))


@query(f"WITH {_REG} SELECT dr.repo, max(a.id) AS any_case, max(b.id) AS exact_case FROM (SELECT DISTINCT repo FROM dr) dr LEFT JOIN ids a ON a.name = lower(dr.repo) LEFT JOIN ids b ON b.name = dr.repo GROUP BY 1")
def name_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Ids of repositories looked up by name: without case, and as they are written (names are stored in lower case)."""
    _, repositories, projects = _registry(spark, d)
    ids = small(R.ids_by_name(projects))
    names = repositories.select("repo").distinct()
    any_case = names.join(ids, F.lower("repo") == F.col("name"), "left").select("repo", F.col("id").alias("any_case"))
    return any_case.join(ids, F.col("repo") == F.col("name"), "left").select("repo", "any_case", F.col("id").alias("exact_case"))


@query(f"WITH {_REG} SELECT count(*) FILTER (WHERE repo <> '' AND fork <> 'true') AS matching, count(*) AS n_rows FROM reg")
def inclusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return _registry(spark, d)[2].agg(F.count_if(R.may_include()).alias("matching"), F.count("*").alias("n_rows"))


@query(f"WITH {_REG} SELECT host, count(*) AS n FROM reg WHERE platform = 'NPM' GROUP BY 1")
def projects_per_host(spark: SparkSession, d: str) -> DataFrame:
    return _registry(spark, d)[2].where("platform = 'NPM'").groupBy("host").agg(F.count("*").alias("n"))


_INCLUDED = f"""{_REG}, prs AS (SELECT 'Own' || (o_orderkey % 7) || '/Repo' || (o_orderkey % 300) AS repo, CASE o_orderkey % 3 WHEN 0 THEN 'gitlab' WHEN 1 THEN 'github' ELSE 'other' END AS host,
  CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'opened' ELSE 'merged' END AS state, o_orderdate AS created_at, o_orderdate + INTERVAL 300 DAY AS updated_at FROM orders),
closed AS (SELECT repo, count(*) FILTER (WHERE (host = 'github' AND state = 'closed') OR (host = 'gitlab' AND state <> 'opened' AND created_at <= TIMESTAMP '1998-06-01' AND updated_at <= TIMESTAMP '1998-06-01')) AS closed FROM prs GROUP BY 1),
loud AS (SELECT id, bool_or(n >= 100) AS enough FROM (SELECT CAST(l_partkey AS VARCHAR) AS id, date_trunc('month', l_shipdate) AS m, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1)"""


@query(f"WITH {_INCLUDED} SELECT id, repo, coalesce(closed >= 3, false) AS enough_prs, coalesce(enough, false) AS enough_downloads, coalesce(closed >= 3, false) AND coalesce(enough, false) AS included FROM reg LEFT JOIN closed USING (repo) LEFT JOIN loud USING (id) WHERE repo <> ''")
def included_projects(spark: SparkSession, d: str) -> DataFrame:
    """Which registry rows have enough closed pull requests and a month with enough downloads."""
    k = F.col("o_orderkey")
    repo = F.concat(F.lit("Own"), (k % 7).cast("string"), F.lit("/Repo"), (k % 300).cast("string"))
    host = F.when(k % 3 == 0, "gitlab").when(k % 3 == 1, "github").otherwise("other")
    state = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "opened").otherwise("merged")
    made = F.to_timestamp("o_orderdate")
    prs = table(spark, d, "orders").select(repo.alias("repo"), host.alias("host"), state.alias("state"), made.alias("created_at"), (made + F.expr("interval 300 days")).alias("updated_at"))
    downloads = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("id"), F.trunc("l_shipdate", "month").alias("month"), F.col("l_quantity").alias("downloads"))
    told = R.included(_registry(spark, d)[2], R.closed_counts(prs, "1998-06-01 00:00:00"), downloads, 3, 100)
    return told.select("id", "repo", "enough_prs", "enough_downloads", "included")


@query(f"WITH {_REG} SELECT id FROM reg WHERE repo IN (SELECT 'Own' || (o_custkey % 7) || '/Repo' || (o_custkey % 200) FROM orders)")
def named_registry_rows(spark: SparkSession, d: str) -> DataFrame:
    """Registry rows whose repository is in a list of names, case included."""
    k = F.col("o_custkey")
    names = table(spark, d, "orders").select(F.concat(F.lit("Own"), (k % 7).cast("string"), F.lit("/Repo"), (k % 200).cast("string")).alias("repo")).distinct()
    return _registry(spark, d)[2].join(small(names), "repo", "left_semi").select("id")


@query(f"WITH {_REG}, core AS (SELECT DISTINCT 'pkg' || l_suppkey AS name FROM lineitem), e AS (SELECT 'pkg' || focal AS focal_name, focal, 'pkg' || other AS other_name, other FROM dp) SELECT id FROM reg WHERE platform = 'NPM' AND lower(host) = 'github' AND fork <> 'true' AND name NOT IN (SELECT name FROM core) AND id IN (SELECT other FROM e WHERE focal_name IN (SELECT name FROM core) UNION SELECT focal FROM e WHERE other_name IN (SELECT name FROM core))")
def registry_periphery(spark: SparkSession, d: str) -> DataFrame:
    packages, _, projects = _registry(spark, d)
    name = lambda c: F.concat(F.lit("pkg"), c)
    edges = packages.select(name("focal").alias("focal_name"), "focal", name("other").alias("other_name"), "other")
    core = table(spark, d, "lineitem").select(name(F.col("l_suppkey").cast("string")).alias("name")).distinct()
    return R.periphery(edges, projects, core, "NPM", "github")


@query("SELECT count(DISTINCT c_custkey) FILTER (WHERE c_custkey % 4 <> 0) AS with_picture, count(DISTINCT c_custkey) AS people FROM customer")
def gravatar_users(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.md5(F.col("c_name").cast("binary"))).alias("gravatar_id"))
    return users.agg(F.countDistinct(F.when(F.col("gravatar_id") != "", F.col("c_custkey"))).alias("with_picture"), F.countDistinct("c_custkey").alias("people"))


def _links_sql(clues: str) -> str:
    return f"""{clues}, told AS (SELECT a, b, list(DISTINCT kind) AS ks FROM clues GROUP BY 1, 2),
 labels AS (SELECT a, b, 'EMAIL' AS rule FROM told WHERE list_contains(ks, 'EMAIL') UNION ALL SELECT a, b, unnest(ks) FROM told WHERE NOT list_contains(ks, 'EMAIL') AND len(ks) >= 2
   UNION ALL SELECT a, b, CASE WHEN list_contains(ks, 'FULL_NAME') THEN 'FULL_NAME' ELSE 'COMP_EMAIL_PREFIX' END FROM told WHERE len(ks) = 1 AND (list_contains(ks, 'FULL_NAME') OR list_contains(ks, 'COMP_EMAIL_PREFIX'))),
 links AS (SELECT DISTINCT a, b FROM labels),
 reach AS (SELECT DISTINCT n, n AS m FROM (SELECT a AS n FROM links UNION SELECT b FROM links) UNION SELECT reach.n, e.y FROM reach JOIN (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links) e ON e.x = reach.m),
 members AS (SELECT n AS uid, min(m) AS cluster FROM reach GROUP BY 1)"""


_MERGED = """, held AS (SELECT m.uid, cluster, email FROM members m JOIN al ON al.uid = m.uid), rules AS (SELECT cluster, count(*) FILTER (WHERE rule = 'EMAIL') AS mail, count(*) FILTER (WHERE rule = 'FULL_NAME') AS full_, string_agg(DISTINCT rule, ',' ORDER BY rule) AS kinds FROM labels JOIN members ON uid = a GROUP BY 1),
 sizes AS (SELECT cluster, count(*) AS n, min(uid) AS least_uid, count(DISTINCT email) AS mails FROM held GROUP BY 1),
 verdicts AS (SELECT cluster, least_uid, mail, mail >= n - 1 OR mails = 1 OR full_ >= n - 1 OR kinds IN ('EMAIL,FULL_NAME', 'EMAIL,FULL_NAME,SIMPLE_NAME', 'EMAIL,SIMPLE_NAME') AS valid FROM sizes JOIN rules USING (cluster)),
 gone AS (SELECT uid, representative FROM (SELECT uid, least_uid AS representative FROM held JOIN verdicts USING (cluster) WHERE valid UNION ALL SELECT uid, min(uid) OVER (PARTITION BY cluster, email) FROM held JOIN verdicts USING (cluster) WHERE NOT valid AND mail > 0) WHERE uid <> representative)"""
#: With all pairs of accounts of one address, as the clusters' rules count them.
_LINKS = _links_sql(graphs.clues_sql(graphs._ALL, 6, 3, all_mail=True))


def _clustered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    accounts = I.normalised(graphs._aliases(spark, d))
    labels = shared_table(I.link_labels(I.clue_pairs(accounts, most=6, prefix_length=3), accounts), "labels")
    members = G.min_label_components(labels.select("a", "b").distinct()).select(F.col("node").alias("uid"), F.col("component").alias("cluster"))
    return accounts, members, labels


@query("WITH RECURSIVE " + _LINKS + _MERGED + " SELECT uid, representative FROM gone")
def alias_merged(spark: SparkSession, d: str) -> DataFrame:
    return I.merged_accounts(*_clustered(spark, d))


@query("WITH RECURSIVE " + _LINKS + " SELECT cluster, uid, count(*) OVER (PARTITION BY cluster) - 1 AS others FROM members")
def alias_members(spark: SparkSession, d: str) -> DataFrame:
    """The members of each cluster, with the number of pairs that each is in; member_pairs() makes them where they are asked for."""
    members = _clustered(spark, d)[1]
    sizes = members.groupBy("cluster").agg((F.count("*") - 1).alias("others"))
    return members.join(sizes, "cluster").select("cluster", "uid", "others")


@query("WITH RECURSIVE " + _LINKS + " SELECT x.uid AS a, y.uid AS b, x.cluster FROM members x JOIN members y ON x.cluster = y.cluster AND x.uid < y.uid")
def alias_member_pairs(spark: SparkSession, d: str) -> DataFrame:
    return I.member_pairs(_clustered(spark, d)[1])


_BY_PROJECT = graphs._ALIAS.replace("alias AS (", "people AS (") + ", alias AS (SELECT DISTINCT (o_orderkey % 25) || ':' || lpad(p.uid::VARCHAR, 12, '0') AS uid, login, name, prefix, domain, (o_orderkey % 25)::VARCHAR AS g FROM orders JOIN people p ON p.uid = o_custkey)"


@query("WITH RECURSIVE " + _links_sql(graphs.clues_sql(_BY_PROJECT, 3, 4, all_mail=True)) + _MERGED + " SELECT CAST(split_part(uid, ':', 1) AS BIGINT) AS project, CAST(split_part(uid, ':', 2) AS BIGINT) AS uid, CAST(split_part(representative, ':', 2) AS BIGINT) AS representative FROM gone")
def alias_by_project(spark: SparkSession, d: str) -> DataFrame:
    """The accounts that give way to another within each project: all clues, clusters and verdicts, one run for all projects."""
    people = graphs._aliases(spark, d)
    project = (F.col("o_orderkey") % 25).cast("string")
    who = table(spark, d, "orders").select(project.alias("project"), F.col("o_custkey").alias("uid")).distinct().join(people, "uid").where("email is not null and name is not null")
    accounts = I.normalised(who.withColumn("uid", F.concat_ws(":", "project", F.lpad(F.col("uid").cast("string"), 12, "0"))), by="project")
    labels = shared_table(I.link_labels(I.clue_pairs(accounts, by="project"), accounts), "labels")
    members = G.min_label_components(labels.select("a", "b").distinct()).select(F.col("node").alias("uid"), F.col("component").alias("cluster"))
    gone = I.merged_accounts(accounts, members, labels)
    of = lambda c: F.substring_index(c, ":", -1).cast("long").alias(c)
    return gone.select(F.substring_index("uid", ":", 1).cast("long").alias("project"), of("uid"), of("representative"))


@query(r"WITH au AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'Ann-' ELSE 'bob' END || ' Lee' || (c_custkey % 17) AS name, 'u.' || (c_custkey % 40) || '@m' || (c_custkey % 5) || '.org' AS email FROM customer), p AS (SELECT *, trim(regexp_extract(name, '([\p{Lu}]?[^+\-_,.\p{Lu}]*)$', 1)) AS last_name, split_part(email, '@', 1) AS user_name FROM au) SELECT a.k, round(jaro_winkler_similarity(a.name, b.name), 6) AS name, round(jaro_winkler_similarity(a.email, b.email), 6) AS email, round(jaro_winkler_similarity(a.name, b.name), 6) AS first_name, round(jaro_winkler_similarity(a.last_name, b.last_name), 6) AS last_name, round(jaro_winkler_similarity(a.user_name, b.user_name), 6) AS user_name, round(jaro_winkler_similarity(a.name, b.last_name), 6) AS inverse_first_name FROM p a JOIN p b ON b.k = a.k + 1")
def author_likeness(spark: SparkSession, d: str) -> DataFrame:
    """Six likenesses of each customer to the next one, as authors of the form `name <address>`."""
    k = F.col("c_custkey")
    line = F.concat(F.when(k % 3 == 0, "Ann-").otherwise("bob"), F.lit(" Lee"), (k % 17).cast("string"), F.lit(" <u."), (k % 40).cast("string"), F.lit("@m"), (k % 5).cast("string"), F.lit(".org>"))
    authors = table(spark, d, "customer").select(k.alias("k"), P.author(line).alias("a"))
    both = authors.join(authors.select((F.col("k") - 1).alias("k"), F.col("a").alias("b")), "k")
    told = both.select("k", P.author_likeness(F.col("a"), F.col("b"), halving=False).alias("x")).select("k", "x.*")
    return told.select("k", *[F.round(c, 6).alias(c) for c in told.columns[1:]])


@query("SELECT c_custkey FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 100")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return E.seeded_sample(table(spark, d, "customer"), "c_custkey", 100).select("c_custkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) - 1 AS new_id FROM orders")
def shuffled_ids(spark: SparkSession, d: str) -> DataFrame:
    return E.shuffled(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "new_id", 7).select("o_orderkey", F.col("new_id").cast("long").alias("new_id"))


@query("SELECT 'l_quantity' AS \"column\", round(sum(l_quantity), 2) AS total FROM lineitem UNION ALL SELECT 'l_discount', round(sum(l_discount), 2) FROM lineitem UNION ALL SELECT 'l_tax', round(sum(l_tax), 2) FROM lineitem")
def columns_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the columns that are left after dropping by patterns, which match from a name's beginning."""
    lines = table(spark, d, "lineitem")
    left = S.matching(S.matching(lines.columns, ["l_.*key", "l_line", "l_ship", "l_ext", "quantity"], keep=False), ["l_q", "l_disc", "l_tax"])
    return lines.agg(*[F.round(F.sum(c), 2).alias(c) for c in left]).unpivot([], left, "column", "total")


@query("SELECT s_suppkey, 5 + 3 * (row_number() OVER (ORDER BY s_suppkey) - 1) AS place FROM supplier")
def stepped_places(spark: SparkSession, d: str) -> DataFrame:
    placed = cumulative(table(spark, d, "supplier").select("s_suppkey").withColumn("one", F.lit(1)), ["s_suppkey"], "one", out="place")
    return placed.select("s_suppkey", (F.col("place") * 3 + 5).cast("long").alias("place"))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    """Activities with nested people: (id, activity)."""
    said = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("body"), F.struct(F.col("l_suppkey").alias("id"), F.lit("x").alias("login")).alias("user_data"))).alias("c"))
    orders = table(spark, d, "orders").join(said, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast(said.schema["c"].dataType)
    user = F.struct((F.col("o_custkey") % 100).alias("id"), F.lit("y").alias("login"))
    return orders.select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), user.alias("user_data"), F.coalesce("c", none).alias("comments_data")).alias("activity"))


@query("SELECT o_orderkey AS id, string_agg(u::VARCHAR, ',' ORDER BY u) AS people, bool_or(own AND said) AS self_involved FROM (SELECT o_orderkey, u, bool_or(own) AS own, bool_or(NOT own) AS said FROM (SELECT o_orderkey, o_custkey % 100 AS u, true AS own FROM orders UNION ALL SELECT l_orderkey, l_suppkey, false FROM lineitem) GROUP BY 1, 2) GROUP BY 1")
def nested_people(spark: SparkSession, d: str) -> DataFrame:
    """All people that an activity names at any depth, and whether its submitter also comments."""
    rows = _nested(spark, d)
    kind = rows.schema["activity"].dataType
    people = C.people_in(kind, F.col("activity"))
    said = C.people_in(kind["comments_data"].dataType, F.col("activity.comments_data"))
    return rows.select("id", F.array_join(F.transform(people, lambda x: x.cast("string")), ",").alias("people"), F.array_contains(said, F.col("activity.user_data.id")).alias("self_involved"))


@query("SELECT o_orderkey AS id, o_custkey % 100 AS submitter, count(l_orderkey) > 0 AS has_comments, coalesce(sum(l_suppkey), 0)::BIGINT AS commenters, '{\"id\":' || o_orderkey || ',\"user_data\":{\"id\":' || (o_custkey % 100) || '}}' AS short FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey")
def whitelisted(spark: SparkSession, d: str) -> DataFrame:
    """Nested rows cut to a whitelist; an empty list is left out."""
    rows = _nested(spark, d)
    kind = rows.schema["activity"].dataType
    kept = C.whitelist(kind, {"id": True, "user_data": {"id": True}, "comments_data": {"user_data": {"id": True}}}, F.col("activity"), ignore_empty=True)
    short = C.whitelist(kind, {"id": True, "user_data": {"id": True}}, F.col("activity"))
    some = rows.select("id", kept.alias("k"), F.to_json(short).alias("short"))
    total = F.aggregate(F.coalesce("k.comments_data", F.array().cast(some.schema["k"].dataType["comments_data"].dataType)), F.lit(0).cast("long"), lambda a, c: a + c["user_data"]["id"])
    return some.select("id", F.col("k.user_data.id").alias("submitter"), F.col("k.comments_data").isNotNull().alias("has_comments"), total.alias("commenters"), "short")


@query(f"WITH {cleaning._PEOPLE}, v AS (SELECT c_custkey, email IN (SELECT email FROM people WHERE c_custkey % 61 = 3) OR lower(name) IN (SELECT lower(name) FROM people WHERE c_custkey % 61 = 3) AS d, c_custkey % 71 = 4 AS g, lower(login) IN ('fabric8cd', 'mrsflux', 'greenkeeperio-bot', 'ovh-ux-cds') AS b FROM people) SELECT c_custkey, d OR g OR b AS bot, d AND g AND b AS bot_faithful FROM v")
def bot_votes(spark: SparkSession, d: str) -> DataFrame:
    """Whether an account is a bot: if any list says so, and as once computed only if all three do."""
    people = cleaning._people(spark, d)
    k = F.col("c_custkey")
    listed = people.where(k % 61 == 3)
    mails, names = (small(listed.select(c.alias("_v")).distinct()) for c in (F.col("email"), F.lower("name")))
    flag = lambda rows, key, some, out: rows.join(some.withColumn(out, F.lit(True)), key == F.col("_v"), "left").drop("_v")
    told = flag(flag(people, F.col("email"), mails, "_e"), F.lower("name"), names, "_n")
    votes = [F.coalesce("_e", "_n", F.lit(False)), k % 71 == 4, F.lower("login").isin(C.BLOCKED_LOGINS)]
    return told.select("c_custkey", reduce(lambda a, b: a | b, votes).alias("bot"), reduce(lambda a, b: a & b, votes).alias("bot_faithful"))


@query("WITH n AS (SELECT project, count(*) FILTER (WHERE NOT is_issue) AS prs, count(*) FILTER (WHERE is_issue) AS issues FROM (SELECT o_custkey AS project, substr(o_orderpriority, 1, 1) IN ('1', '2') AS is_issue FROM orders) GROUP BY 1), q AS (SELECT quantile_cont(prs, 0) AS a, quantile_cont(prs, 0.2) AS b, quantile_cont(prs, 0.4) AS c, quantile_cont(prs, 0.6) AS d, quantile_cont(prs, 0.8) AS e, quantile_cont(prs, 1) AS f FROM n) SELECT box, sum(prs)::BIGINT AS prs, sum(issues)::BIGINT AS issues, round(sum(prs) * 1.0 / sum(prs + issues), 6) AS share FROM (SELECT *, CASE WHEN prs <= a THEN NULL WHEN prs <= b THEN 0 WHEN prs <= c THEN 1 WHEN prs <= d THEN 2 WHEN prs <= e THEN 3 ELSE 4 END AS box FROM n, q) WHERE box IS NOT NULL GROUP BY 1")
def activity_mix(spark: SparkSession, d: str) -> DataFrame:
    """Activity by kind in five boxes of pull request counts; the least ones are in none."""
    issue = F.substring("o_orderpriority", 1, 1).isin("1", "2")
    n = shared_table(table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(~issue).alias("prs"), F.count_if(issue).alias("issues")), "mix")
    edges = quantiles(n, "prs", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) or [0.0] * 6
    box = F.when(F.col("prs") <= edges[0], None)
    for i, top in enumerate(edges[1:]):
        box = box.when(F.col("prs") <= top, i)
    boxed = n.withColumn("box", box.cast("int")).where("box is not null")
    return boxed.groupBy("box").agg(F.sum("prs").alias("prs"), F.sum("issues").alias("issues"), F.round(F.sum("prs") / F.sum(F.col("prs") + F.col("issues")), 6).alias("share"))


@query(sql("SELECT merged, comments > 0 AS some, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY merged), 6) AS share FROM pr GROUP BY 1, 2"))
def value_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a value within each group."""
    counts = A.activities(spark, d).where("not is_issue").groupBy("merged", (F.col("comments") > 0).alias("some")).agg(F.count("*").alias("n"))
    total = counts.groupBy(F.col("merged").alias("_m")).agg(F.sum("n").alias("_all"))
    return counts.join(small(total), F.col("merged").eqNullSafe(F.col("_m"))).select("merged", "some", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


@query(sql("SELECT CASE WHEN merged THEN 1 ELSE 0 END AS bin, count(*) AS n, count(*) FILTER (WHERE comments <> 0) AS others FROM pr GROUP BY 1"))
def histogram_flags(spark: SparkSession, d: str) -> DataFrame:
    """Two bins of a yes/no column, over all rows and over those whose count isn't zero."""
    rows = A.activities(spark, d).where("not is_issue")
    return rows.groupBy(F.col("merged").cast("int").alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("comments") != 0).alias("others"))


@query(sql("SELECT id, first_time, NOT first_time AND comments > 0 AS known_and_discussed FROM (SELECT *, row_number() OVER (PARTITION BY project, submitter ORDER BY ts, seq) = 1 AS first_time FROM pr) WHERE first_time OR comments > 0"))
def contributor_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Rows of first-time contributors, and of others where there is a comment."""
    rows = first_seen(A.activities(spark, d).where("not is_issue"), ["project", "submitter"], "first_time")
    return rows.where("first_time or comments > 0").select("id", "first_time", (~F.col("first_time") & (F.col("comments") > 0)).alias("known_and_discussed"))


_LINES = "id bigint, state string, comments_data array<struct<id:bigint,user_data:struct<id:bigint,login:string>>>, user_data struct<id:bigint,login:string>, __source_path string"


def _written(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d).select("activity.*")


@query("SELECT o_orderkey AS id, o_orderstatus AS state, o_custkey % 100 AS submitter, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_comments FROM orders")
def json_lines_scan(spark: SparkSession, d: str) -> DataFrame:
    """Nested activities written as JSON lines, compressed, and read back with a schema."""
    path = shared_path(spark, "lines")
    writers.json_lines(_written(spark, d), path, "gzip")
    return readers.json_lines(spark, path, _LINES).select("id", "state", F.col("user_data.id").alias("submitter"), F.coalesce(F.size("comments_data"), F.lit(0)).cast("long").alias("n_comments"))


def _array_files(spark: SparkSession, d: str, record: Column, text: Column | None = None) -> str:
    """Orders as files of one array each, for each repository and thousand of keys, in a folder for each repository.

    A row is a file: folders of their own would each be made, listed and moved. Tasks move their files into the new folder themselves.
    """
    path = shared_path(spark, "arrays")
    k = F.col("o_orderkey")
    groups = table(spark, d, "orders").groupBy((k % 5).alias("r"), F.floor(k / 1000).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), record.alias("t")))), lambda x: x["t"]), ","), F.lit("]")).alias("value"))
    named = groups.select(F.col("value") if text is None else text.alias("value"), F.concat(F.lit("own"), F.col("r").cast("string"), F.lit("--repo")).alias("from"))
    named.write.partitionBy("from").option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
    return path


def _repository(path: Column) -> Column:
    return readers.repository(F.concat(F.regexp_extract(path, "from=([^/]+)", 1), F.lit(".json")))


@query("SELECT 'own' || (o_orderkey % 5) || '/repo' AS repo, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders GROUP BY 1")
def json_array_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files of arrays of records, a folder of files for each repository; where a record came from tells its repository."""
    path = _array_files(spark, d, F.to_json(F.struct(F.col("o_orderkey").alias("id"))))
    rows = readers.json_arrays(spark, path, "id bigint, __source_path string", nested=True, glob="*.txt")
    return rows.groupBy(_repository(F.col("__source_path")).alias("repo")).agg(F.count("*").alias("n"), F.sum("id").alias("total"))


_CUT = "o_orderkey % 5 = 2 AND (o_orderkey // 1000) % 3 = 1"


@query(
    f"SELECT 'good' AS what, 'own' || (o_orderkey % 5) || '/repo' AS repo, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders WHERE NOT ({_CUT}) AND o_orderkey % 97 <> 0 GROUP BY 2 "
    f"UNION ALL SELECT 'record', 'own' || (o_orderkey % 5) || '/repo', count(*), sum(place)::BIGINT FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey % 5, o_orderkey // 1000 ORDER BY o_orderkey) - 1 AS place FROM orders) WHERE NOT ({_CUT}) AND o_orderkey % 97 = 0 GROUP BY 2 "
    f"UNION ALL SELECT 'file', 'own2/repo', count(DISTINCT o_orderkey // 1000), NULL FROM orders WHERE {_CUT} HAVING count(*) > 0"
)
def json_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Arrays with planted damage, records of a wrong type and files cut short: what is good, and what goes where."""
    k = F.col("o_orderkey")
    record = F.when(k % 97 == 0, F.lit('{"id": "x"}')).otherwise(F.to_json(F.struct(k.alias("id"))))
    cut = F.when((F.col("r") == 2) & (F.col("file") % 3 == 1), F.expr("substring(value, 1, length(value) - 3)")).otherwise(F.col("value"))
    path = _array_files(spark, d, record, cut)
    told = readers.told_arrays(spark, path, "id bigint, __source_path string", nested=True, glob="*.txt")
    good = F.col("what") == "good"
    repo = _repository(F.when(good, F.col("record.__source_path")).otherwise(F.col("file")))
    return told.groupBy("what", repo.alias("repo")).agg(F.count("*").alias("n"), F.sum(F.when(good, F.col("record.id")).otherwise(F.col("place"))).alias("total"))


@query(f"WITH {_REG} SELECT id, repo, fork, name || ', \"' || host || '\"' AS quoted FROM reg")
def registry_scan(spark: SparkSession, d: str) -> DataFrame:
    """Registry rows written as CSV with quotes and commas inside, and read back."""
    path = shared_path(spark, "registry")
    rows = _registry(spark, d)[2].select("id", "repo", "fork", F.concat("name", F.lit(', "'), "host", F.lit('"')).alias("quoted"))
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    back = readers.registry_csv(spark, path, "id string, repo string, fork string, quoted string")
    return back.select("id", F.coalesce("repo", F.lit("")).alias("repo"), "fork", "quoted")


@query("SELECT DISTINCT lower('Own' || (c_custkey % 40) || '/Repo') AS name FROM customer")
def name_list_scan(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "names")
    table(spark, d, "customer").select(F.concat(F.lit("  Own"), (F.col("c_custkey") % 40).cast("string"), F.lit("/Repo "))).write.text(path)
    return readers.name_list(spark, path, lower=True)


@query("SELECT DISTINCT 'Bot ' || (c_custkey % 60) AS name, 'b' || (c_custkey % 60) || '@m.org' AS email FROM customer")
def bot_list_scan(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "bots")
    n = (F.col("c_custkey") % 60).cast("string")
    table(spark, d, "customer").select(F.concat(F.lit("Bot "), n, F.lit(" <b"), n, F.lit("@m.org>;x;y"))).write.text(path)
    return readers.bot_list(spark, path)


@query("SELECT c_mktsegment AS platform, count(*) AS n, sum(c_custkey)::BIGINT AS total FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1")
def split_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows written to a folder for each platform and read back from those folders."""
    path = shared_path(spark, "platforms")
    rows = table(spark, d, "customer").withColumn("platform", F.col("c_mktsegment"))
    kept = [r[0] for r in rows.select("platform").distinct().collect() if r[0] != "BUILDING"]
    writers.split_by(rows, path, "platform", kept)
    return spark.read.parquet(path).groupBy("platform").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("total"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders")
def chronological_files(spark: SparkSession, d: str) -> DataFrame:
    """Rows written in order of time; a row's place is its number in its file after all rows of the files before."""
    path = shared_path(spark, "ordered")
    writers.chronological(table(spark, d, "orders").select("o_orderkey", F.to_timestamp("o_orderdate").alias("at")), path, "at", "o_orderkey")
    return readers.placed(spark, path, "at").select("o_orderkey", F.col("__place").alias("place"))


@query(cleaning.recursive("SELECT chunk_id, count(*) AS n, min(id) AS least, max(id) AS most FROM chunked GROUP BY 1", cleaning.CHUNKED))
def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    """Activities written to a folder for each chunk of time, one chunk of them written anew, and read back as one table."""
    path = shared_path(spark, "chunks")
    chunks = greedy_chunks(A.activities(spark, d).select("id", "ts"), A.WINDOW).select("id", "chunk_id")
    writers.chunks(chunks, path, "chunk_id")
    writers.chunks(chunks.where("chunk_id = 1"), path, "chunk_id")
    return spark.read.parquet(path).groupBy(F.col("chunk_id").cast("long").alias("chunk_id")).agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))


@query(sql("SELECT src, tgt, round(sum(weight), 6) AS strength FROM (SELECT src, tgt, CASE WHEN label LIKE '%commenter_commenter' THEN weight * weight ELSE weight END AS weight FROM edges JOIN w USING (label)) GROUP BY 1, 2", explore._WEIGHED))
def link_strength_faithful(spark: SparkSession, d: str) -> DataFrame:
    """Link strengths as they were once computed: discussions are weighted twice."""
    per, labels = graphs.links(spark, d)
    weights = E.edge_weights(labels)
    twice = F.when(F.endswith("label", F.lit("commenter_commenter")), F.col("weight") * F.col("weight")).otherwise(F.col("weight"))
    return per.join(small(weights), "label").groupBy("src", "tgt").agg(F.round(F.sum(F.col("n") * twice), 6).alias("strength"))


@query("SELECT o_orderkey, o_custkey % 100 AS submitter_id, 'y' AS submitter_login, o_orderkey AS sizes_0, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS sizes_1 FROM orders")
def feature_csv(spark: SparkSession, d: str) -> DataFrame:
    """A table with a struct and a list written as a flat CSV and read back."""
    path = shared_path(spark, "csv")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    listed = table(spark, d, "orders").select(k.alias("o_orderkey"), F.when(c % 2 == 0, F.array(k, c)).otherwise(F.array(k)).alias("sizes"))
    rows = _nested(spark, d).select(F.col("id").alias("o_orderkey"), F.col("activity.user_data").alias("submitter")).join(listed, "o_orderkey")
    writers.csv(rows, path)
    return spark.read.option("header", True).schema("o_orderkey long, submitter_id long, submitter_login string, sizes_0 long, sizes_1 long").csv(path)


@query(sql("SELECT project, count(*) AS n, min(submitter) AS least, max(submitter) AS most, sum(submitter)::BIGINT AS total FROM (SELECT DISTINCT project, submitter FROM pr WHERE merged) GROUP BY 1"))
def project_user_files(spark: SparkSession, d: str) -> DataFrame:
    """The people of each project written to a folder for each, and read back by the list of projects."""
    path = shared_path(spark, "people")
    people = A.activities(spark, d).where("not is_issue and merged").select("project", "submitter").distinct()
    listed = writers.user_files(people, path, "project")
    back = spark.read.schema("project long, submitter long, _group long").json(path)
    return back.join(listed, "project").groupBy("project").agg(F.max("n").alias("n"), F.min("submitter").alias("least"), F.max("submitter").alias("most"), F.sum("submitter").alias("total"))


@query()
def glm_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """The coefficient table of a binomial model, as it is written to CSV and read back."""
    path = shared_path(spark, "coefficients")
    writers.csv(S.coefficients(explore._model_rows(spark, d), explore._FEATURES, "label"), path)
    return spark.read.option("header", True).schema("term string, estimate double, std_error double, z double, p double, odds double").csv(path)


@query(sql("SELECT 'equal counts' AS test, round(1 - (SELECT sum(exp(-s / 2 + (k / 2 + i) * ln(s / 2) - lgamma(k / 2 + i + 1))) FROM range(4000) t(i)), 9) AS p FROM chi UNION ALL SELECT 'contingency', round(1 - (SELECT sum(exp(-y / 2 + (0.5 + i) * ln(y / 2) - lgamma(1.5 + i))) FROM range(4000) t(i)), 9) FROM yates UNION ALL SELECT 'fisher', round(least(1.0, (SELECT sum(exp(lp)) FROM each WHERE lp <= (SELECT lp FROM each, t WHERE x = tt) + 1e-7)), 9)", explore._TABLE + ", chi AS (SELECT sum((n - m) * (n - m) / m) AS s, count(*) - 1.0 AS k FROM (SELECT n, avg(n) OVER () AS m FROM (SELECT project, count(*) AS n FROM pr GROUP BY 1))), yates AS (SELECT (tt + tf + ft + ff) * power(greatest(abs(tt * ff - tf * ft) - (tt + tf + ft + ff) / 2, 0), 2) / ((tt + tf) * (ft + ff) * (tt + ft) * (tf + ff)) AS y FROM t), each AS (SELECT x, lgamma(c + 1) - lgamma(x + 1) - lgamma(c - x + 1) + lgamma(n - c + 1) - lgamma(r - x + 1) - lgamma(n - c - r + x + 1) - lgamma(n + 1) + lgamma(r + 1) + lgamma(n - r + 1) AS lp FROM (SELECT tt + tf AS r, tt + ft AS c, tt + tf + ft + ff AS n, unnest(range(CAST(greatest(0, tt + tf + tt + ft - (tt + tf + ft + ff)) AS BIGINT), CAST(least(tt + tf, tt + ft) AS BIGINT) + 1)) AS x FROM t))"))
def p_values(spark: SparkSession, d: str) -> DataFrame:
    """p of the chi-square tests and of Fisher's exact test on one table of counts."""
    prs = A.activities(spark, d).where("not is_issue")
    counts = S.chi_square(prs.groupBy("project").agg(F.count("*").alias("n"))).first()
    table2 = S.contingency(prs, F.col("merged"), F.col("comments") > 3).first()
    a, b = F.col("merged"), F.col("comments") > 3
    n = prs.agg(F.count_if(a & b), F.count_if(a & ~b), F.count_if(~a & b), F.count_if(~a & ~b)).first()
    made = [("equal counts", S.chi_square_p(counts["statistic"], counts["degrees"])), ("contingency", S.chi_square_p(table2["statistic"], 1)), ("fisher", S.fisher_p(*n))]
    return spark.createDataFrame([(k, round(float(p), 9)) for k, p in made], "test string, p double")


@query()
def correlated_columns(spark: SparkSession, d: str) -> DataFrame:
    """Groups of columns whose ranks correlate by a half or more."""
    lines = table(spark, d, "lineitem").withColumn("price_again", F.col("l_extendedprice") * 2)
    strong = S.spearman(lines, ["l_quantity", "l_extendedprice", "price_again", "l_tax"]).where(F.abs("rho") >= 0.5)
    groups = S.correlation_clusters([(r["a"], r["b"]) for r in strong.orderBy("a", "b").collect()])
    return spark.createDataFrame([(i, c) for i, g in enumerate(groups) for c in g], "cluster long, column string")
