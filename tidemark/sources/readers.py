"""Readers: JSON lines and arrays, registry CSVs, lists; each keeps where a row came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import shared_table
from .schema import ACTIVITY


def _sourced(df: DataFrame) -> DataFrame:
    return df.withColumn("__source_path", F.coalesce(F.col("__source_path"), F.col("_metadata.file_path"))) if "__source_path" in df.columns else df


def json_lines(spark: SparkSession, path: str | list[str], schema: str = ACTIVITY, strict: bool = True) -> DataFrame:
    """One record a line; a bad line ends the read, or without strict is left out."""
    return _sourced(spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path))


def json_arrays(spark: SparkSession, path: str | list[str], schema: str = ACTIVITY, strict: bool = True, nested: bool = False, glob: str = "*.json") -> DataFrame:
    """Files that hold one array of records each, in a folder or with nested also below it; a bad file ends the read, or without strict is left out."""
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return _sourced(reader.option("recursiveFileLookup", nested).option("pathGlobFilter", glob).json(path))


#: The column that holds what could not be read as a record.
DAMAGED = "_damaged"


def _told(texts: DataFrame, schema: str) -> DataFrame:
    """(file, place, text) with `what` (good, record or file) and, where it is good, the `record` by the schema."""
    kind = f"{schema}, {DAMAGED} string"
    read = texts.withColumn("r", F.from_json("text", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": DAMAGED}))
    bad = F.col(f"r.{DAMAGED}").isNotNull() | F.col("r").isNull()
    named = T._parse_datatype_string(schema).fieldNames()
    record = F.struct(*[F.coalesce("r.__source_path", "file").alias(n) if n == "__source_path" else F.col(f"r.`{n}`").alias(n) for n in named])
    return read.select("file", "place", "text", F.when(~bad, "good").when(F.col("text").isNotNull(), "record").otherwise("file").alias("what"), record.alias("record"))


def _parsed(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of _told(): records by the schema, and the texts that are none."""
    return told.where("what = 'good'").select("record.*"), told.where("what <> 'good'").select("file", "place", "what", "text")


def quarantined_lines(spark: SparkSession, path: str | list[str], schema: str = ACTIVITY) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of files with one record a line: damaged lines go to a table (file, place, what, text).

    A file's lines carry no numbers, so `place` is null and the text tells which line it was; blank lines are none.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.lit(None).cast("int").alias("place"), F.col("value").alias("text")).where(F.trim("text") != "")
    return _parsed(_told(lines, schema))


def told_arrays(spark: SparkSession, path: str | list[str], schema: str = ACTIVITY, nested: bool = False, glob: str = "*.json") -> DataFrame:
    """(file, place, text, what, record) of files that hold one array of records each: both tables of quarantined_arrays() in one read.

    `what` is good, record (one that doesn't fit the schema) or file (one that isn't an array, without place and text).
    Each file is read as one row, as it is where the array is parsed at once.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", nested).option("pathGlobFilter", glob).text(path)
    split = files.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "array<string>").alias("texts"))
    told = split.select("file", F.col("texts").isNull().alias("broken"), F.posexplode_outer("texts").alias("place", "text"))
    return _told(told.where("broken or place is not null").select("file", "place", F.when(~F.col("broken"), F.coalesce("text", F.lit("null"))).alias("text")), schema)


def quarantined_arrays(spark: SparkSession, path: str | list[str], schema: str = ACTIVITY, nested: bool = False, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of files that hold one array of records each.

    A record that doesn't fit the schema goes to the rejects with its file and its place in the array; its
    neighbours stay.  A file that isn't an array goes there as a whole, without place and
    text.  Each of the two reads the files; told_arrays() reads them once.
    """
    return _parsed(told_arrays(spark, path, schema, nested, glob))


def placed(spark: SparkSession, path: str, time: str, schema: str | None = None) -> DataFrame:
    """The rows of Parquet files in order of time, with the file's `__file` and each row's `__place` in the whole.

    Places come from the files alone: a row's number in its file and the numbers of rows in the files before
    it, by name.  Files whose times overlap weren't written in order and are refused.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    spans = rows.groupBy("__file").agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    by_name = Window.orderBy("__file")  # as few rows as there are files
    before = by_name.rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select("__file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__ahead"), (F.col("first") < F.max("last").over(before)).alias("overlaps"))
    offsets = shared_table(offsets, "offsets")
    if not offsets.where("overlaps").isEmpty():
        raise ValueError(f"the files of {path} aren't in order of {time}")
    joined = rows.join(F.broadcast(offsets.select(F.col("__file").alias("_f"), "__ahead")), F.col("__file") == F.col("_f"))
    return joined.withColumn("__place", F.col("__ahead") + F.col("__row")).drop("_f", "__ahead", "__row")


def registry_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def name_list(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """(name): the distinct non-blank lines of a text file."""
    name = F.trim("value")
    return spark.read.text(path).select((F.lower(name) if lower else name).alias("name")).where("name <> ''").distinct()


def bot_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, email) of lines such as `name <email>;...`, the first field cut at its last '<'."""
    first = F.split_part("value", F.lit(";"), F.lit(1))
    return spark.read.text(path).select(F.trim(F.regexp_extract(first, "^(.*)<", 1)).alias("name"), F.regexp_extract(first, "<([^<>]*)>[^<]*$", 1).alias("email")).where("email <> ''").distinct()


def repository(path: Column) -> Column:
    """owner/repo of a path such as .../owner--repo--suffix.json."""
    parts = F.split(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1), "--")
    return F.when(F.size(parts) > 1, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))


def integrator() -> Column:
    """Who merged a merged pull request, or closed another."""
    return F.when(F.col("merged"), F.col("merged_by_data")).otherwise(F.col("closed_by"))


def drop_empty(df: DataFrame) -> DataFrame:
    """df with empty arrays as nulls, as a missing key reads."""
    arrays = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    return df.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in arrays})
