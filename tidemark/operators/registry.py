"""Package registry: dependency maps with names resolved to ids, and which projects to include."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small


def ids_by_name(projects: DataFrame, lower: bool = True) -> DataFrame:
    """(name, id) of projects (id, repo, place): of several projects of a repository the last by place counts."""
    name = F.lower("repo") if lower else F.col("repo")
    return projects.groupBy(name.alias("name")).agg(F.max_by("id", "place").alias("id"))


def dependency_map(packages: DataFrame, repositories: DataFrame, projects: DataFrame) -> DataFrame:
    """Distinct (focal, other) of package dependencies (focal, other) and repository dependencies (repo, other), ids as text.

    Package dependencies of a project on itself are dropped, an empty target is kept.
    Of repository dependencies empty targets and repositories that no project has are
    dropped; names are compared without case.
    """
    own = packages.select(F.lower("focal").alias("focal"), F.lower("other").alias("other")).where("focal <> other")
    named = repositories.where("other <> ''").select(F.lower("repo").alias("name"), "other")
    found = named.join(small(ids_by_name(projects)), "name").select(F.col("id").alias("focal"), "other")
    return own.unionByName(found).distinct()


def unresolved(repositories: DataFrame, projects: DataFrame) -> DataFrame:
    """The repository dependencies whose repository no project has."""
    return repositories.join(small(ids_by_name(projects).select("name")), F.lower("repo") == F.col("name"), "left_anti")


def kept_table(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table stored at a path; where there is none yet, it is made and stored first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.parquet(path)
    return spark.read.parquet(path)


def may_include() -> Column:
    """Whether a registry row (repo, fork) names a repository of its own."""
    return (F.col("repo") != "") & (F.coalesce("fork", F.lit("")) != "true")


def closed_counts(prs: DataFrame, last: str) -> DataFrame:
    """(repo, closed) of pull requests (repo, host, state, created_at, updated_at).

    One host says 'closed'; the other everything but 'opened', and only there dates
    are checked; pull requests of any other host don't count.
    """
    host = F.lower("host")
    here = (F.col("created_at") <= F.to_timestamp(F.lit(last))) & (F.col("updated_at") <= F.to_timestamp(F.lit(last)))
    done = F.when(host == "github", F.col("state") == "closed").when(host == "gitlab", (F.col("state") != "opened") & here).otherwise(False)
    return prs.groupBy("repo").agg(F.count_if(done).alias("closed"))


def included(registry: DataFrame, closed: DataFrame, downloads: DataFrame, least_closed: int, least_downloads: float) -> DataFrame:
    """registry rows with a repository, and enough_prs, enough_downloads and included (neither exclusion applies).

    downloads is (id, month, downloads): one month with enough is enough.  A
    repository without pull requests has no file and is excluded.  Every registry row
    is decided, so a repository of several packages stands in several rows.
    """
    loud = downloads.groupBy("id", "month").agg(F.sum("downloads").alias("_d")).groupBy("id").agg(F.max(F.col("_d") >= least_downloads).alias("enough_downloads"))
    told = registry.where("repo <> ''").join(closed, "repo", "left").join(loud, "id", "left")
    prs, some = F.coalesce(F.col("closed") >= least_closed, F.lit(False)), F.coalesce("enough_downloads", F.lit(False))
    return told.select(*registry.columns, prs.alias("enough_prs"), some.alias("enough_downloads"), (prs & some).alias("included"))


def periphery(packages: DataFrame, projects: DataFrame, names: DataFrame, platform: str, host: str) -> DataFrame:
    """(id): projects beside the named ones along package dependencies (focal_name, focal, other_name, other), either way.

    Only projects of a platform whose repository is no fork and lies on a host count,
    and the named ones themselves don't.
    """
    core = small(names.select(F.col("name").alias("_n")).distinct())
    out = packages.join(core, F.col("focal_name") == F.col("_n"), "left_semi").select(F.col("other").alias("id"))
    into = packages.join(core, F.col("other_name") == F.col("_n"), "left_semi").select(F.col("focal").alias("id"))
    fit = projects.where((F.col("platform") == platform) & (F.lower("host") == host) & (F.coalesce("fork", F.lit("")) != "true"))
    return out.union(into).distinct().join(fit.join(core, F.col("name") == F.col("_n"), "left_anti").select("id"), "id", "left_semi")
