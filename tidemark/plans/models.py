"""Queries of the declared models, over the features of pull requests."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import explore as E
from ..operators import forests as R
from ..operators import stats as S
from ..operators.common import shared_table
from ..operators.point_in_time import earlier_sums, first_seen
from . import activity as A
from . import features

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


#: Variants of other features, and those that were never enabled: in no model.
ASIDE = ["any_pair_", "intra_unbounded", "intra_inclusive", ".*participation"]
#: What each model leaves out: features of other kinds, and what else varies with those that stay.
MODELS = {
    "ecosystem": ["dep_", "invdep_", "nondep_", ".*_pair_", "eco_success_rate", "eco_comment_count", "eco_issue_count", "eco_issue_comment_count", "intra_(?!issue_count)"],
    "dependency": ["eco_", ".*_pair_", ".*_success_rate", ".*_comment_count", "intra_(?!issue_count)"],
    "collaboration": ["(?!.*_pair_)(eco_|dep_|invdep_|nondep_)", ".*_inverse$", "intra_(?!issue_count|pair_)"],
}
#: A person that is active in so many projects counts as a top contributor.
TOP_PROJECTS = 20

#: Features by what they tell; a model is fitted without each of them.
GROUPS = {
    "own project": "intra_(?!pair_)",
    "ecosystem": "eco_(?!pair_)",
    "dependencies": "dep_",
    "dependants": "invdep_",
    "other projects": "nondep_",
    "pairs in the project": "intra_pair_",
    "pairs in the ecosystem": "eco_pair_",
}


def model_rows(spark: SparkSession, d: str) -> DataFrame:
    """The feature table with counts as ln(1 + x), project, submitter, the integrator's experience, first_time and the label (merged)."""
    specs = [f for f in features.registry() if not S.matching([f.name], ASIDE)]
    wide = features.compute_all(specs, spark, d).withColumns({f.name: F.log1p(f.name) for f in specs if f.value == "count"})
    prs = A.activities(spark, d).where("not is_issue")
    known = prs.where("integrator is not null").select("id", "ts", "seq", "project", F.col("integrator").alias("k"))
    led = earlier_sums(known, known.withColumn("n", F.lit(1).cast("long")), ["project", "k"], ["n"], A.WINDOW).select("id", F.log1p("n").alias("integrator_experience"))
    who = first_seen(prs, ["project", "submitter"], "first_time").select("id", "project", "submitter", "first_time", F.col("merged").cast("double").alias("label"))
    return shared_table(who.join(wide, "id").join(led, "id", "left").fillna(0.0, ["integrator_experience"]), "models")


def _columns(model: str) -> list[str]:
    names = [f.name for f in features.registry()]
    return S.matching(names, [*ASIDE, *MODELS[model]], keep=False)


def pipeline(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(term, estimate, std_error, z, rows, outliers): a model of the label with an intercept for each project.

    Columns that never vary go; rows that a logit tells as influential outliers go; what stays is scaled to
    0..1 and fitted.  Where no column varies only the intercepts are left, and where there are no rows nothing
    can be estimated: the variances are null then, and rows and outliers 0.
    """
    rows = rows.select(*columns, "label", "project")  # nothing else is read, passed to Python tasks or stored
    if rows.isEmpty():
        none = [("_scale", None, None, None, 0, 0), ("_group_variance", None, None, None, 0, 0)]
        return rows.sparkSession.createDataFrame(none, "term string, estimate double, std_error double, z double, rows long, outliers long")
    varied = [r["column"] for r in S.summaries(rows, columns, {"median": 0.5}).where("least < most").collect()]
    kept = [c for c in columns if c in varied]
    marked = shared_table(S.influence(E.min_max(rows, kept), kept, "label"), "influence")
    fit = S.random_intercepts(E.min_max(marked.where("not outlier"), kept), kept, "label", "project")
    gone = marked.where("outlier").count()
    return fit.table(rows.sparkSession).withColumns({"rows": F.lit(fit.rows).cast("long"), "outliers": F.lit(gone).cast("long")})


@query
def model_variants(spark: SparkSession, d: str) -> DataFrame:
    """The ten declared models: three kinds of features for all rows, first-time contributors and others, and one with the integrator's experience."""
    rows = model_rows(spark, d)
    parts = [(m, s, rows.where(w), _columns(m)) for m in MODELS for s, w in (("all", "true"), ("first-time", "first_time"), ("others", "not first_time"))]
    parts.append(("ecosystem with integrator", "all", rows, [*_columns("ecosystem"), "integrator_experience"]))
    with ThreadPoolExecutor(R.AT_ONCE) as pool:  # each is many short jobs
        made = list(pool.map(lambda p: pipeline(p[2], p[3]).select(F.lit(p[0]).alias("model"), F.lit(p[1]).alias("subset"), "*"), parts))
    return reduce(lambda a, b: a.unionByName(b), made)


@query
def contributor_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """The ecosystem model of all rows, and fitted anew from the beginning without those of people of many projects."""
    rows = model_rows(spark, d)
    busy = rows.groupBy("submitter").agg(F.countDistinct("project").alias("k")).where(F.col("k") >= TOP_PROJECTS).select("submitter")
    parts = (("all", rows), ("without top contributors", rows.join(busy, "submitter", "left_anti")))
    return reduce(lambda a, b: a.unionByName(b), [pipeline(some, _columns("ecosystem")).select(F.lit(name).alias("of"), "*") for name, some in parts])


@query
def rf_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Mean and spread of F1 over five folds, of forests of all features and of all but each group."""
    rows = model_rows(spark, d)
    every = S.matching([f.name for f in features.registry()], ASIDE, keep=False)
    lists = {"none": every, **{name: S.matching(every, [pattern], keep=False) for name, pattern in GROUPS.items()}}
    folds = R.cross_validated(rows, lists, "label", "id")
    return folds.groupBy(F.col("columns").alias("without")).agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("spread_f1"), F.avg("accuracy").alias("mean_accuracy"))


@query
def cross_validation_spread(spark: SparkSession, d: str) -> DataFrame:
    """Mean and spread of F1 over five folds, for all rows, first-time contributors and others."""
    rows = model_rows(spark, d)
    every = S.matching([f.name for f in features.registry()], ASIDE, keep=False)
    parts = (("all", "true"), ("first-time", "first_time"), ("others", "not first_time"))
    told = [R.cross_validated(rows.where(w), every, "label", "id").agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("spread_f1")).select(F.lit(s).alias("subset"), "*") for s, w in parts]
    return reduce(lambda a, b: a.unionByName(b), told)
