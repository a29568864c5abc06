"""Point-in-time features of pull requests as a registry of specifications."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import shared_table, small
from ..operators.incremental import carry_on, last_window, merged_sums, with_past
from ..operators.point_in_time import UNBOUNDED_STRETCH, earlier_sums, rate
from . import activity as A


@dataclass(frozen=True)
class Log:
    """Activities and comments, and the distinct people (a) and counterparts (b) that pull requests ask about, if only these matter."""

    activities: DataFrame
    comments: DataFrame
    people: DataFrame | None = None
    others: DataFrame | None = None

    def asked(self, rows: DataFrame) -> DataFrame:
        """The rows of entries whose people are asked about."""
        rows = rows if self.people is None else rows.join(self.people, "a", "left_semi")
        return rows if self.others is None or "b" not in rows.columns else rows.join(self.others, "b", "left_semi")


#: What a feature counts: rows (a, project, ts, seq, n, k), or with b for pairs of people.
Entries = Callable[[Log], DataFrame]


def _prs(issue: bool) -> Entries:
    return lambda log: log.asked(log.activities.where(F.col("is_issue") == issue).select(F.col("submitter").alias("a"), "project", "ts", "seq", F.lit(1).cast("long").alias("n"), F.col("merged").cast("long").alias("k")))


def _comments(issue: bool, distinct: bool) -> Entries:
    def of(log: Log) -> DataFrame:
        rows = log.asked(log.comments.where(F.col("is_issue") == issue).select(F.col("commenter").alias("a"), "project", "ts", "seq", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("k")))
        return rows.distinct() if distinct else rows

    return of


def _pairs(kind: str, issue: bool, inverse: bool) -> Entries:
    def of(log: Log) -> DataFrame:
        if kind == "integrated":
            rows = log.activities.where(F.col("is_issue") == issue).select(F.col("submitter").alias("a"), F.col("integrator").alias("b"), "project", "ts", "seq")
        elif kind == "commented":
            rows = log.comments.where(F.col("is_issue") == issue).select(F.col("submitter").alias("a"), F.col("commenter").alias("b"), "project", "ts", "seq")
        else:  # each pair of people that discuss, as often as their comments multiply; who isn't asked about goes before people are paired
            said = log.comments.where(F.col("is_issue") == issue)
            count = lambda name: said.select("id", F.col("commenter").alias(name), "project", "ts", "seq")
            mine = log.asked(count("a")).groupBy("id", "a", "project", "ts", "seq").agg(F.count("*").alias("_mine"))
            other = Log(log.activities, log.comments, None, log.others).asked(count("b").select("id", "b")).groupBy("id", "b").agg(F.count("*").alias("_m"))
            return mine.join(other, "id").where("a <> b").select("a", "b", "project", "ts", "seq", (F.col("_mine") * F.col("_m")).alias("n"))
        if inverse:
            rows = rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "project", "ts", "seq")
        return log.asked(rows.where("a <> b").withColumn("n", F.lit(1).cast("long")))

    return of


@dataclass(frozen=True)
class Feature:
    """entries: what counts; scope: intra, anywhere, ecosystem, dependency, inverse or non_dependency; value: count or rate."""

    name: str
    entries: Entries
    sql_entries: str
    scope: str = "intra"
    value: str = "count"
    pair: bool = False
    window: int | None = A.WINDOW
    inclusive: bool = False


#: Scopes that need the sums over all projects, and those over the projects that depend on each other.
_EVERYWHERE = ("anywhere", "ecosystem", "non_dependency")
_NEAR = ("dependency", "inverse", "non_dependency")


def compute(f: Feature, spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, value) for every pull request."""
    return compute_all([f], spark, sf_dir)


def compute_all(specs: list[Feature], spark: SparkSession, sf_dir: str, state: str | None = None, next_state: str | None = None) -> DataFrame:
    """(id, a column for each feature) for every pull request.

    Features with the same keys and window share their work: their entries become
    the columns of one table, which is summed once for what lies within the project
    and everywhere, and once for the projects nearby.

    A log that arrives in chunks, each later in the stream than the one before, needs
    no history: `next_state` names a folder to which a run writes what later chunks may ask
    of it, and `state` the folder that the run over the chunk before has written.  A state
    holds the entries of the last window and, for features without a window, sums by key.
    A run that breaks is repeated from the state before it; its own folder is written anew.
    A chunk that begins before the end of the state's log is refused.
    """
    groups: dict[tuple, list[Feature]] = {}
    for f in specs:
        groups.setdefault((f.pair, f.window, f.inclusive), []).append(f)
    acts, several = A.activities(spark, sf_dir), len(specs) > 1 or bool(next_state)
    if several:  # many passes read them
        acts = shared_table(acts, "activities")
    said = A.comments(spark, sf_dir, acts).select("id", "seq", "ts", "project", "submitter", "commenter", "is_issue")
    log = Log(acts, shared_table(said, "comments") if several and any("com" in f.sql_entries for f in specs) else said)
    if state or next_state:
        carry_on(spark, acts, state, next_state)
    parts = [_group(some, spark, sf_dir, log, state, next_state) for some in groups.values()]
    return reduce(lambda x, y: x.join(y, "id"), parts).select("id", *[f.name for f in specs])


def _group(specs: list[Feature], spark: SparkSession, sf_dir: str, log: Log, state: str | None, next_state: str | None) -> DataFrame:
    pair, window, inclusive = specs[0].pair, specs[0].window, specs[0].inclusive
    who = [F.col("submitter").alias("a"), *([F.col("integrator").alias("b")] if pair else [])]
    queries = log.activities.where("not is_issue").select("id", "ts", "seq", "project", *who)
    keys = ["a", "b"] if pair else ["a"]
    several = len(specs) > 1 or bool(next_state)
    if several:
        queries = shared_table(queries, "queries")
    sources: dict[str, int] = {}
    for f in specs:
        sources.setdefault(f.sql_entries, len(sources))
    rated = {f.sql_entries for f in specs if f.value == "rate"}
    values = [v for source, i in sources.items() for v in (f"n{i}", *([f"k{i}"] if source in rated else []))]

    def entries_of(some: Log) -> DataFrame:
        tables = []
        for source, i in sources.items():
            own = [F.col("n").alias(f"n{i}"), *([F.col("k").alias(f"k{i}")] if source in rated else [])]
            tables.append(next(f for f in specs if f.sql_entries == source).entries(some).select(*keys, "project", "ts", "seq", *own))
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables)

    scopes = {f.scope for f in specs}
    everywhere, near = scopes & set(_EVERYWHERE), scopes & set(_NEAR)
    name = f"{'pairs' if pair else 'people'}-{window}-{'from' if inclusive else 'after'}"
    old = spark.read.parquet(f"{state}/{name}") if state else None
    # entries of people that no pull request asks about add to nothing, and are dropped before anything is shuffled by key
    asked = Log(log.activities, log.comments, *[small(queries.select(k).where(F.col(k).isNotNull()).distinct()) for k in keys])
    entries = entries_of(asked)
    if old is not None and window:
        entries = entries.unionByName(asked.asked(old), allowMissingColumns=True)
    if pair:  # nor do those of pairs that nobody asks about within a window after them
        stretch = F.floor(F.col("ts") / (window or UNBOUNDED_STRETCH))
        times = queries.select(F.col("a").alias("_a"), F.col("b").alias("_b"), *([stretch.alias("_s")] if window else [])).distinct()
        near_in_time = F.col("_s").between(stretch, stretch + 1) if window else F.lit(True)
        entries = entries.join(small(times), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & near_in_time, "left_semi")
    if several:  # several passes read them
        entries = shared_table(entries, "entries")
    past = old if not window else None
    if next_state:  # later chunks may ask about anyone
        if window:
            end = spark.read.parquet(f"{next_state}/end")
            late = lambda rows: rows.where(F.col("ts") >= end.first()["last"]["ts"] - window)
            every = entries_of(Log(late(log.activities), late(log.comments)))
            kept = last_window(every if old is None else every.unionByName(old, allowMissingColumns=True), window, inclusive, end)
        else:
            kept = merged_sums(entries_of(log), past, [*keys, "project"], values)
        kept.write.mode("overwrite").parquet(f"{next_state}/{name}")
    got = None
    if everywhere:
        got = earlier_sums(queries, entries, keys, values, window, inclusive, within=["project"])
    elif "intra" in scopes:
        inside = earlier_sums(queries, entries, [*keys, "project"], values, window, inclusive)
        if past is not None:
            inside = with_past(inside, past, [*keys, "project"], values)
        got = inside.withColumnsRenamed({v: f"{v}_within" for v in values})
    if near:
        beside = _nearby(queries, entries, keys, values, window, inclusive, spark, sf_dir)
        got = queries.select("id").join(beside, "id", "left") if got is None else got.join(beside, "id", "left")
    return got.select("id", *[_value(f, sources[f.sql_entries]).alias(f.name) for f in specs])


def _nearby(queries: DataFrame, entries: DataFrame, keys: list[str], values: list[str], window: int | None, inclusive: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, <value>_out, _in, _near): sums over projects that the own one depends on, that depend on it, and over both."""
    edges = A.dependencies(spark, sf_dir)
    turned = edges.select(F.col("other").alias("focal"), F.col("focal").alias("other"))
    both = edges.withColumn("o", F.lit(1)).unionByName(turned.withColumn("i", F.lit(1)), allowMissingColumns=True)
    beside = both.groupBy(F.col("focal").alias("project"), "other").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    # from the person's side: only projects in which it has entries in a query's stretch or the one before can add anything
    stretch = F.floor(F.col("ts") / (window or UNBOUNDED_STRETCH))
    active = entries.select(*keys, F.col("project").alias("other"), F.explode(F.array(stretch, stretch + 1)).alias("_stretch")).distinct()
    there = queries.select(*keys, "project", stretch.alias("_stretch")).distinct()
    pairs = shared_table(active.join(small(beside), "other").join(there, [*keys, "project", "_stretch"], "left_semi"), "nearby")
    near = queries.withColumn("_stretch", stretch).join(pairs, [*keys, "project", "_stretch"]).drop("project", "_stretch")
    asked = near.withColumnRenamed("other", "project")
    each = earlier_sums(asked, entries, [*keys, "project"], values, window, inclusive)
    told = [(v, tail, F.lit(True) if flag is None else F.col(flag) == 1) for v in values for tail, flag in (("_out", "o"), ("_in", "i"), ("_near", None))]
    return each.groupBy("id").agg(*[F.sum(F.when(on, F.col(v))).alias(v + tail) for v, tail, on in told])


def _value(f: Feature, i: int) -> Column:
    """A feature from the sums of its source."""

    def count(v: str) -> Column:
        got = lambda tail: F.coalesce(F.col(v + tail), F.lit(0))
        if f.scope == "intra":
            return got("_within")
        if f.scope == "anywhere":
            return got("")
        if f.scope == "ecosystem":
            return got("") - got("_within")
        if f.scope == "non_dependency":
            return got("") - got("_within") - got("_near")
        return got("_out" if f.scope == "dependency" else "_in")

    return count(f"n{i}").cast("long") if f.value == "count" else F.round(rate(count(f"k{i}"), count(f"n{i}")), 9)


def sql_of(f: Feature) -> str:
    """The same as a self join over the stream."""
    scope = {
        "intra": "e.project = q.project",
        "anywhere": "TRUE",
        "ecosystem": "e.project <> q.project",
        "dependency": "EXISTS (SELECT 1 FROM dep WHERE focal = q.project AND other = e.project)",
        "inverse": "EXISTS (SELECT 1 FROM dep WHERE focal = e.project AND other = q.project)",
        "non_dependency": "e.project <> q.project AND NOT EXISTS (SELECT 1 FROM dep WHERE (focal = q.project AND other = e.project) OR (focal = e.project AND other = q.project))",
    }[f.scope]
    scoped = scope
    if "EXISTS" in scope:  # the pairs of projects first, so that the join has plain conditions
        pairs = {"dependency": "SELECT focal AS p, other AS o FROM dep", "inverse": "SELECT other AS p, focal AS o FROM dep", "non_dependency": f"SELECT a.p, b.p AS o FROM (SELECT DISTINCT project AS p FROM act) a, (SELECT DISTINCT project AS p FROM act) b WHERE a.p <> b.p EXCEPT (SELECT focal, other FROM dep UNION SELECT other, focal FROM dep)"}[f.scope]
    bound = "" if f.window is None else f" AND e.ts {'>=' if f.inclusive else '>'} q.ts - {f.window}"
    person = "e.a = q.submitter" + (" AND e.b = q.integrator" if f.pair else "")
    value = f"CAST(coalesce(sum(e.n), 0) AS BIGINT) AS {f.name}" if f.value == "count" else f"round(coalesce(sum(e.k) * 1.0 / sum(e.n), 0.0), 9) AS {f.name}"
    before = "(e.ts < q.ts OR (e.ts = q.ts AND e.seq < q.seq))"
    if "EXISTS" in scope:
        source = "(SELECT x.*, pp.p FROM ent x JOIN pp ON pp.o = x.project) e"
        return A.sql(f"SELECT q.id, {value} FROM pr q LEFT JOIN {source} ON {person} AND e.p = q.project{bound} AND {before} GROUP BY q.id", f"ent AS ({f.sql_entries}), pp AS ({pairs})")
    return A.sql(f"SELECT q.id, {value} FROM pr q LEFT JOIN ent e ON {person} AND {scoped}{bound} AND {before} GROUP BY q.id", f"ent AS ({f.sql_entries})")


_PR = "SELECT submitter AS a, project, ts, seq, 1 AS n, CAST(merged AS INT) AS k FROM act WHERE {w}"
_COM = "SELECT {d} commenter AS a, project, ts, seq, 1 AS n, 0 AS k FROM com WHERE {w}"
_W = {False: "NOT is_issue", True: "is_issue"}


def _pair_sql(kind: str, issue: bool, inverse: bool) -> str:
    if kind == "discussion":
        return f"SELECT x.commenter AS a, y.commenter AS b, x.project, x.ts, x.seq, 1 AS n FROM com x JOIN com y ON x.id = y.id WHERE x.commenter <> y.commenter AND {'' if issue else 'NOT '}x.is_issue"
    a, b = ("submitter", "integrator" if kind == "integrated" else "commenter")
    if inverse:
        a, b = b, a
    return f"SELECT {a} AS a, {b} AS b, project, ts, seq, 1 AS n FROM {'act' if kind == 'integrated' else 'com'} WHERE {a} <> {b} AND {_W[issue]}"


def registry() -> list[Feature]:
    """All features, in the order in which a feature table lists them."""
    pr, issue = _prs(False), _prs(True)
    pr_sql, issue_sql = _PR.format(w=_W[False]), _PR.format(w=_W[True])
    com = {(i, d): (_comments(i, d), _COM.format(w=_W[i], d="DISTINCT" if d else "")) for i in (False, True) for d in (False, True)}
    out = [
        Feature("intra_pr_count", pr, pr_sql),
        Feature("intra_success_rate", pr, pr_sql, value="rate"),
        Feature("intra_comment_count", *com[False, False]),
        Feature("intra_issue_count", issue, issue_sql),
        Feature("intra_issue_comment_count", *com[True, False]),
        Feature("intra_unbounded_count", pr, pr_sql, window=None),
        Feature("intra_inclusive_count", pr, pr_sql, inclusive=True),
    ]
    short = {"ecosystem": "eco", "dependency": "dep", "inverse": "invdep", "non_dependency": "nondep"}
    for scope, s in short.items():
        out += [
            Feature(f"{s}_pr_count", pr, pr_sql, scope),
            Feature(f"{s}_success_rate", pr, pr_sql, scope, "rate"),
            Feature(f"{s}_comment_count", *com[False, False], scope),
            Feature(f"{s}_participation_count", *com[False, True], scope),
            Feature(f"{s}_issue_count", issue, issue_sql, scope),
            Feature(f"{s}_issue_comment_count", *com[True, False], scope),
            Feature(f"{s}_issue_participation_count", *com[True, True], scope),
        ]
    for scope, s in (("intra", "intra"), ("ecosystem", "eco"), ("anywhere", "any")):
        for kind, is_issue, inverse in (("integrated", False, False), ("integrated", False, True), ("commented", False, False), ("commented", False, True), ("discussion", False, False), ("commented", True, False), ("commented", True, True), ("discussion", True, False)):
            name = f"{s}_pair_{'issue_' if is_issue else ''}{kind}{'_inverse' if inverse else ''}"
            out.append(Feature(name, _pairs(kind, is_issue, inverse), _pair_sql(kind, is_issue, inverse), scope, pair=True))
    names = [f.name for f in out]
    if len(set(names)) < len(names):
        raise ValueError("two features share a name")
    return out
