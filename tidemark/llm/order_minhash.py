"""Order MinHash fingerprints, sensitive to edit distance (operator 6).

A text's tokens are runs of Latin letters, digits and marks (cut at 16) or single
other characters.  Its k-mers of two tokens are numbered by occurrence, so a
repeated k-mer counts each time.  The hash of (k-mer, occurrence) deals these into
BUCKETS; of each bucket the LENGTH smallest are selected, kept in text order and
hashed as a tuple, and the tuples' hashes are the signature.  Moving text about
changes the order within tuples, so unlike a set sketch it notices that.

Everything is column code, linear in the length of the text but for two sorts
of long integers: a k-mer's hash and its place share one long, and sorting
those brings equal k-mers together in text order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, let, sha256_text, table

#: Tokens of a text: runs of Latin letters, digits and marks, cut at 16, else one character.
TOKEN = r"[!-~À-ɏ]{1,16}|[^\s!-~À-ɏ]"
BUCKET_BITS = 5
BUCKETS = 1 << BUCKET_BITS
LENGTH = 2
_PLACE_BITS = 26  # past 2 ** 26 tokens places begin anew, so only there the text order within a tuple may be another
_PLACE = (1 << _PLACE_BITS) - 1


def _kmers(tokens: Column) -> Column:
    """Each hash of two adjacent tokens, its low bits replaced by its place (the last token is its own k-mer)."""
    return F.transform(tokens, lambda t, i: F.xxhash64(t, F.get(tokens, i + 1)).bitwiseAND(~_PLACE).bitwiseOR(i.bitwiseAND(F.lit(_PLACE)).cast("long")))


def _top(x: Column) -> Column:
    return F.shiftright(x, _PLACE_BITS)


def _bucket(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BUCKET_BITS)


def _repeats(s: Column, i: Column, x: Column) -> Column:
    """Whether x, at place i of sorted k-mers, has the k-mer of the one before."""
    return (i > 0) & (_top(x.bitwiseXOR(F.get(s, i - 1))) == 0)


def _numbered(again: Column) -> Column:
    """From the sorted k-mers that aren't a first occurrence: the hash of (k-mer, occurrence), the place in its low bits."""
    heads = F.filter(F.sequence(F.lit(0), F.size(again) - 1), lambda i: ~_repeats(again, i, F.get(again, i)))

    def runs(h: Column) -> Column:
        ends = F.concat(F.slice(h, 2, F.size(h)), F.array(F.size(again)))
        hashed = lambda x, o: F.xxhash64(_top(x), o).bitwiseAND(~_PLACE).bitwiseOR(x.bitwiseAND(F.lit(_PLACE).cast("long")))
        return F.flatten(F.transform(F.arrays_zip(h.alias("a"), ends.alias("b")), lambda r: F.transform(F.slice(again, r["a"] + 1, r["b"] - r["a"]), hashed)))

    return F.when(F.size(again) > 0, let(heads, runs)).otherwise(again)


def _least(s: Column) -> Column:
    """The LENGTH smallest of each bucket, from sorted hashes."""
    return F.filter(s, lambda x, i: (i < LENGTH) | (_bucket(F.get(s, i - LENGTH)) != _bucket(x)))


def _signature(s: Column) -> Column:
    """From sorted k-mers with places: for each bucket that isn't empty its number and the hash of its tuple, in one long.

    The hash of a first occurrence is its k-mer's own, so these are in order already.
    """
    first = F.filter(s, lambda x, i: ~_repeats(s, i, x))
    again = F.filter(s, lambda x, i: _repeats(s, i, x))
    some = let(first, _least)
    others = let(again, lambda a: let(F.sort_array(_numbered(a)), _least))

    def tuples(c: Column) -> Column:
        place = lambda x: x.bitwiseAND(F.lit(_PLACE).cast("long"))
        begins = lambda x, i: (i == 0) | (_bucket(F.get(c, i - 1)) != _bucket(x))
        pair = lambda x, y: F.when(y.isNull() | (_bucket(y) != _bucket(x)), F.xxhash64(_top(x))).when(place(x) <= place(y), F.xxhash64(_top(x), _top(y))).otherwise(F.xxhash64(_top(y), _top(x)))
        made = lambda x, i: F.when(begins(x, i), F.shiftleft(_bucket(x), 64 - BUCKET_BITS).bitwiseOR(F.shiftrightunsigned(pair(x, F.get(c, i + 1)), BUCKET_BITS)))
        return F.array_compact(F.transform(c, made))

    return let(F.sort_array(F.concat(some, others)), lambda both: let(_least(both), tuples))


def signature(text: Column) -> Column:
    """array<bigint> with an entry for each bucket that isn't empty; empty for a null text or one without tokens."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return let(tokens, lambda t: let(F.sort_array(_kmers(t)), _signature))


def printed(sig: Column) -> Column:
    """A signature as text: sixteen hexadecimal digits an entry."""
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries among the buckets that either fills; 1 for two empty signatures."""
    filled = F.size(F.array_union(F.transform(a, _bucket), F.transform(b, _bucket)))
    return F.when(filled == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / filled)


def fingerprint(docs: DataFrame, text: str = "text", out: str = "signature") -> DataFrame:
    """docs with the Order MinHash signature of each whole text.

    A null text is empty.  A column of docs named like out is replaced, all others
    are kept.
    """
    return docs.withColumn(out, signature(F.col(text)))


#: Ranges of keys for each shuffle partition, so that the ranges that meet in a partition even out.
FINE = 16


def _above(cuts: list, key: Column) -> Column:
    """How many of the ascending cuts are greater than key, looked up in two steps."""
    wide = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    lists = F.array(*[F.array(*[F.lit(c) for c in b]) for b in blocks])
    block = F.size(F.filter(F.array(*[F.lit(b[0]) for b in blocks]), lambda c: c <= key)) - 1
    upto = let(block, lambda j: F.when(j < 0, 0).otherwise(j * wide + F.size(F.filter(F.get(lists, j), lambda c: c <= key))))
    return F.lit(len(cuts)) - upto


def with_next(docs: DataFrame, key: str, columns: list[str], also: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """docs with next_<column>: the columns of the next row by descending key, after the last those of the first.

    also names further columns, as expressions of docs, that are added to each row
    once and can be among the carried ones.  Rows are dealt into ranges of the key
    by its approximate percentiles, or, where it is no number, as Spark cuts ranges.  Each range gets a copy of the first row of the
    next one and looks up its own neighbours, so only keys of ranges are broadcast.
    Null keys come last; rows of one key follow each other by a hash of what they
    carry.  Columns of docs named like the new ones are replaced.
    """
    parts = parts or max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) * FINE
    also, made = also or {}, [f"next_{c}" for c in columns]
    docs = docs.drop(*[c for c in [*also, *made] if c != key])
    kept = [*docs.columns, *also]
    range_, copy, tie, next_, first, goes = fresh([*kept, *made], "range", "copy", "tie", "next", "first", "goes")
    if isinstance(docs.schema[key].dataType, T.NumericType):
        cuts = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    else:  # the least keys of Spark's own ranges
        ranges = docs.select(key).where(F.col(key).isNotNull()).repartitionByRange(parts, key)
        cuts = [r[0] for r in ranges.groupBy(F.spark_partition_id()).agg(F.min(key).alias("least")).select("least").collect()]
    cuts = sorted(set(cuts))
    # ranges count upwards while the key goes down
    rank = F.when(F.col(key).isNull(), len(cuts) + 1).otherwise(_above(cuts, F.col(key)) if cuts else F.lit(0))
    dealt = docs.withColumn(range_, rank)
    ring = Window.orderBy(range_)
    firsts = dealt.groupBy(range_).agg(F.max(key).alias(first))
    whole = Window.partitionBy(F.lit(1)).orderBy(range_).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    links = firsts.select(F.col(first), F.coalesce(F.lag(range_).over(ring), F.last(range_).over(whole)).alias(goes))
    copies = docs.join(F.broadcast(links), F.col(key).eqNullSafe(F.col(first))).drop(first).withColumnRenamed(goes, range_)
    every = dealt.withColumn(copy, F.lit(False)).unionByName(copies.withColumn(copy, F.lit(True))).withColumns(also)
    order = Window.partitionBy(range_).orderBy(copy, F.col(key).desc_nulls_last(), tie)
    got = every.withColumn(tie, F.xxhash64(*columns)).withColumn(next_, F.lead(F.struct(*columns)).over(order))
    return got.where(~F.col(copy)).select(*kept, *[F.col(next_)[c].alias(m) for c, m in zip(columns, made, strict=True)])


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(docs, "doc_id", ["text", "signature"], also={"signature": signature(F.col("text"))})
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    marked = fingerprint(near.withColumn("edited", edited), "edited", "edited_signature")
    return marked.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        sha256_text(F.col("edited")).alias("edited_sha256"),
        printed(F.col("signature")).alias("fingerprint"),
        printed(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
