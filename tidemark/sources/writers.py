"""Writers: JSON lines, CSV and Parquet, whole or split by a column, in time order where asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    """One record a line; compressed with gzip, files take less room."""
    df.write.mode("overwrite").option("compression", compression).json(path)


def csv(df: DataFrame, path: str, lengths: dict[str, int] | None = None) -> None:
    """With a header; structs and arrays become one column for each part, those of arrays numbered from 0.

    `lengths` tells how many columns an array gets; of others the longest one is looked for.  A shorter array leaves
    the last of its columns empty; parts beyond a given length are refused.
    """
    arrays = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    longest = df.agg(*[F.max(F.size(c)).alias(c) for c in arrays]).first().asDict() if arrays else {}
    sizes = {c: (lengths or {}).get(c, longest[c] or 0) for c in arrays}
    over = [c for c in arrays if (longest[c] or 0) > sizes[c]]
    if over:
        raise ValueError(f"arrays longer than their columns: {over}")
    flat = []
    for f in df.schema:
        if f.dataType.typeName() == "struct":
            flat += [F.col(f"{f.name}.{g.name}").alias(f"{f.name}_{g.name}") for g in f.dataType]
        elif f.name in sizes:
            flat += [F.get(f.name, F.lit(i)).alias(f"{f.name}_{i}") for i in range(sizes[f.name])]
        else:
            flat.append(F.col(f.name))
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def user_files(people: DataFrame, path: str, group: str) -> DataFrame:
    """The people of each project, one a line as JSON, in a folder for each project; returns (project, n), the list of projects written."""
    people.withColumn("_group", F.col(group)).repartition(group).write.mode("overwrite").partitionBy("_group").json(path)
    return people.groupBy(group).agg(F.count("*").alias("n"))


def chronological(df: DataFrame, path: str, time: str, *ties: str) -> None:
    """Parquet in order of time: ranges of time by file, sorted inside; rows without a time are left out."""
    df.where(F.col(time).isNotNull()).repartitionByRange(time).sortWithinPartitions(time, *ties).write.mode("overwrite").parquet(path)


def chunks(df: DataFrame, path: str, column: str) -> None:
    """Parquet in one folder for each chunk; only the chunks that df holds are replaced, so a broken run goes on where it ended."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def split_by(df: DataFrame, path: str, column: str, kept: list[str] | None = None, unknown: str = "unknown") -> None:
    """Parquet in one folder for each value of a column; null is `unknown`, values outside `kept` are dropped."""
    named = df.withColumn(column, F.coalesce(F.col(column), F.lit(unknown)))
    named = named.where(F.col(column).isin([*kept, unknown])) if kept else named
    named.write.mode("overwrite").partitionBy(column).parquet(path)
