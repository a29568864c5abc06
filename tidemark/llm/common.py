"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space and the words of the operators that count or shingle words.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one slice of a batch holds at most (one row may exceed it).
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none and runs on one machine a folder beside the
    warehouse is used instead; on a cluster that folder might not be shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return named.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than the reread.
    """
    path = f"{shared_folder(df.sparkSession)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(names: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each lengthened until no column of names has it, whatever the case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def running(values: Column, step: Callable[[Column, Column], Column], first: Column, block: int = 128) -> Column:
    """For each entry of an array what step() makes of it and of all before it, beginning with `first`.

    Entries are run through in blocks, so the cost grows with the length and not
    with its square, as it would if each entry were appended to all before.
    step() must not care how its arguments are grouped (a sum, a maximum).
    """
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / block).cast("int") - 1, F.lit(0))), lambda b: F.slice(values, b * block + 1, block))

    def appended(entries: Column, start: Column, whole: Column) -> Column:
        # (at, out): the last state, and the states after each entry (whole) or before it
        begin = F.struct(start.alias("at"), F.slice(F.array(start), 1, 0).alias("out"))
        after = lambda a, x: step(a["at"], x)
        return F.aggregate(entries, begin, lambda a, x: F.struct(after(a, x).alias("at"), F.concat(a["out"], F.array(after(a, x) if whole else a["at"])).alias("out")))["out"]

    def joined(p: Column) -> Column:
        totals = F.transform(p, lambda piece: F.aggregate(piece, first, step))
        return F.flatten(F.transform(F.arrays_zip(p.alias("p"), appended(totals, first, False).alias("at")), lambda z: appended(z["p"], z["at"], True)))

    return F.when(F.size(values) <= block, appended(values, first, True)).otherwise(let(pieces, joined))


#: Code points of the pieces into which cut() divides a text.
PIECE = 256


def cut(text: Column) -> Column:
    """The text in an array of pieces of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive) of a text that cut() divided, without a walk from its beginning."""
    i, j = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    inner = F.substring(piece(i), start - i * PIECE + 1, end - start)
    far = F.concat(F.substring(piece(i), start - i * PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(piece(j), F.lit(1), end - j * PIECE))
    return F.when(end <= start, "").when(i == j, inner).otherwise(far)


def sha256_text(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def slices(batch: pa.RecordBatch, column: str | int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of one string column."""
    text = batch.column(column)
    if batch.num_rows <= 1 or text.nbytes <= most:
        yield batch
        return
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    yield batch.slice(begin)


def append_columns(df: DataFrame, column: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list]], most: int = SLICE_BYTES) -> DataFrame:
    """df with new columns that a function of Arrow batches computes.

    make() runs once in each task and returns that function; it gets slices
    bounded by `most` bytes of `column` and returns one Arrow array for each field.
    An input column with the name of a new one is replaced.
    """
    names = [f.name for f in fields]
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for part in slices(whole, column, most):
                if part.num_rows:
                    made = work(part)
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + made, names=kept + names)

    return df.mapInArrow(run, schema)


def numbered(rows: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """rows with the place of each, from 0, among those of its group in an order.

    Rows are dealt into ranges of (by, order) and numbered within a range; the
    numbers of rows in the ranges before are added, so no task needs a whole group.
    Rows alike in all of these are dealt by chance.  Groups are not null.
    """
    part, salt, before = fresh([*rows.columns, out], "part", "salt", "before")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.withColumn(salt, F.rand(7)).repartitionByRange(parts, *by, *order, salt).withColumn(part, F.spark_partition_id())
    dealt = stored(ranges, "ranges")
    ahead = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(part, *by).agg(F.count("*").alias(before)).withColumn(before, F.coalesce(F.sum(before).over(ahead), F.lit(0)))
    inside = dealt.withColumn(out, F.row_number().over(Window.partitionBy(part, *by).orderBy(*order, salt)) - 1)
    return inside.join(counts, [part, *by]).select(*rows.columns, (F.col(out) + F.col(before)).alias(out))


def checked_broadcast(small: DataFrame, most_rows: int) -> DataFrame:
    """small with a broadcast hint if it has at most most_rows rows, else as it is (a shuffled join)."""
    return F.broadcast(small) if small.limit(most_rows + 1).count() <= most_rows else small

