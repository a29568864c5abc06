"""Cleaning: row filters with a rejection report, deduplication, group filters, merges and list algebra."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small

#: Logins of bots that don't say so.
BLOCKED_LOGINS = ["fabric8cd", "mrsflux", "greenkeeperio-bot", "ovh-ux-cds"]
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def row_filters(last_close: str, bots: DataFrame | None = None) -> dict[str, Callable[[], Column]]:
    """Conditions that a kept row meets, by letter; columns login, user_type, created_at, closed_at (text).

    d and g need the flags listed_by_email_or_name and listed_by_login, which
    mark_listed() adds.
    """
    parsed = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return {
        "p": lambda: F.col("created_at").rlike(STAMP) & parsed(F.col("created_at")).isNotNull(),
        "c": lambda: parsed(F.col("closed_at")) <= F.to_timestamp(F.lit(last_close)),
        "u": lambda: F.lower("user_type") != "bot",
        "a": lambda: F.lower("login") != "ghost",
        "d": lambda: ~F.col("listed_by_email_or_name"),
        "g": lambda: ~F.col("listed_by_login"),
        "b": lambda: ~F.lower("login").isin(BLOCKED_LOGINS),
        "n": lambda: ~F.contains("login", F.lit("[bot]")),
    }


def mark_listed(rows: DataFrame, people: DataFrame, logins: DataFrame) -> DataFrame:
    """rows with listed_by_email_or_name and listed_by_login; people has (name, email), logins has (login)."""
    flag = lambda df, c: small(df.select(F.col(c).alias("_k")).where("_k is not null").distinct().withColumn("_hit", F.lit(True)))
    names = people.select(F.lower("name").alias("name"))
    out = rows
    for out_name, key, listed in (("_e", F.col("email"), flag(people, "email")), ("_l", F.lower("login"), flag(names, "name")), ("_m", F.lower("name"), flag(names, "name")), ("_g", F.lower("login"), flag(logins.select(F.lower("login").alias("login")), "login"))):
        out = out.join(listed.withColumnRenamed("_hit", out_name), key == F.col("_k"), "left").drop("_k")
    hit = lambda c: F.coalesce(c, F.lit(False))
    return out.withColumn("listed_by_email_or_name", hit(F.col("_e")) | hit(F.col("_l")) | hit(F.col("_m"))).withColumn("listed_by_login", hit(F.col("_g"))).drop("_e", "_l", "_m", "_g")


def filter_chain(rows: DataFrame, letters: str, conditions: dict[str, Callable[[], Column]]) -> DataFrame:
    """rows with rejected_by: the letter of the first filter in order that a row fails, null if it passes all."""
    verdict = F.lit(None).cast("string")
    for k in reversed(letters):
        verdict = F.when(~_yes(conditions[k]()), F.lit(k)).otherwise(verdict)
    return rows.withColumn("rejected_by", verdict)


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order; partial aggregation, so a key with very many rows isn't gathered."""
    rest = [c for c in rows.columns if c not in order]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order, *[c for c in rest if c not in keys])).alias("_r"))
    return first.select("_r.*")


def group_at_least(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups with at least `least` rows."""
    kept = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*keys)
    return rows.join(small(kept), keys, "left_semi")


def ordered_union(streams: list[DataFrame], tags: list[str], tag: str = "data_type") -> DataFrame:
    """One stream of several, each row tagged, with the order key (ts, dataset_idx, seq)."""
    if len(streams) != len(tags):
        raise ValueError("as many tags as streams are needed")
    tagged = [s.withColumn(tag, F.lit(t)).withColumn("dataset_idx", F.lit(i)) for i, (s, t) in enumerate(zip(streams, tags, strict=True))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def merge_pr_issue(prs: DataFrame, issues: DataFrame, keys: list[str]) -> DataFrame:
    """Pull requests with their issue's fields; shared fields are the pull request's unless it lacks them.

    Of issues with one key the last by seq is taken.
    """
    last = issues.groupBy(*keys).agg(F.max_by(F.struct(*issues.columns), "seq").alias("_i")).select("_i.*")
    shared = [c for c in prs.columns if c in issues.columns and c not in keys]
    only = [c for c in issues.columns if c not in prs.columns]
    right = last.select(*keys, *[F.col(c).alias(f"_i_{c}") for c in shared], *only)
    return prs.join(right, keys).select(*keys, *[F.coalesce(c, F.col(f"_i_{c}")).alias(c) for c in shared], *[c for c in prs.columns if c not in shared and c not in keys], *only)


def backfill(rows: DataFrame, lookup: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Merged rows as they are, and unmerged ones that the lookup knows, with its value in `out`."""
    merged = rows.where("merged").withColumn(out, F.lit(None).cast(lookup.schema[out].dataType))
    found = rows.where("not merged").join(lookup.select(*keys, out).dropDuplicates(keys), keys)
    return merged.unionByName(found)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none does."""
    verdict = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        verdict = F.when(_yes(broken), F.lit(name)).otherwise(verdict)
    return verdict


def whitelist(kind: T.DataType, kept: dict, value: Column, ignore_empty: bool = False) -> Column:
    """value with only the whitelisted fields of a nested type, at any depth.

    kept maps field names to True (the whole field) or to such a map for structs and
    arrays of structs.  With ignore_empty empty arrays are null.
    """
    if isinstance(kind, T.ArrayType):
        inner = F.transform(value, lambda x: whitelist(kind.elementType, kept, x, ignore_empty))
        return F.when(F.size(inner) > 0, inner) if ignore_empty else inner
    fields = []
    for f in kind:
        if f.name in kept:
            own = value[f.name]
            if isinstance(kept[f.name], dict):
                own = whitelist(f.dataType, kept[f.name], own, ignore_empty)
            elif ignore_empty and isinstance(f.dataType, T.ArrayType):
                own = F.when(F.size(own) > 0, own)
            fields.append(own.alias(f.name))
    return F.when(value.isNotNull(), F.struct(*fields))


def people_in(kind: T.DataType, value: Column, name: str = "user_data", of: str = "id") -> Column:
    """The distinct ids of all people that a nested value names, at any depth, in order."""

    def found(kind: T.DataType, value: Column) -> list[Column]:
        if isinstance(kind, T.ArrayType):
            if not isinstance(kind.elementType, (T.StructType, T.ArrayType)):
                return []
            return [F.flatten(F.transform(F.coalesce(value, F.array().cast(kind)), lambda x: F.concat(F.array().cast("array<bigint>"), *found(kind.elementType, x))))]
        out = []
        for f in kind if isinstance(kind, T.StructType) else []:
            if f.name == name and isinstance(f.dataType, T.StructType):
                out.append(F.array(value[f.name][of].cast("bigint")))
            elif isinstance(f.dataType, (T.StructType, T.ArrayType)):
                out += found(f.dataType, value[f.name])
        return out

    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array().cast("array<bigint>"), *found(kind, value)))))
