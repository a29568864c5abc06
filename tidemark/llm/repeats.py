"""Repeated passages, removed by a run-length index (operator 10).

A text is a row of symbols: its UTF-8 bytes, or the hashes of its words.  Every
window of `length` symbols has one anchor, the least of the hashed strings of
`gram` symbols in it (the leftmost of equals).  Equal windows have equal anchors at
equal places, so windows can only repeat among those of one anchor hash.  The
windows of one anchor form a segment, a stretch of less than 2 * length symbols.

  1. Each task lists its texts' segments: anchor hash and 128-bit digest.
  2. Anchors that occur once can't repeat and are dropped.  Where all segments of
     an anchor are equal, all their windows repeat.
  3. Of the rest, each distinct segment is fetched once.  The segments of an anchor
     meet in one task.  Those that share less about the anchor than any window would
     are left out; of a block of the others the run-compressed transform is built
     and the matching statistics are streamed: windows that match elsewhere are repeated.
  4. Anchors with more than CROWD distinct segments aren't gathered: their
     windows are hashed and counted by a grouped aggregation instead.

What is joined to all segments is stored first, so that both sides of a join are
plain shuffles and Spark can split an anchor that a third of all segments have.

Every symbol that a repeated window covers is marked; windows are judged on the
input.  Null texts are empty; texts under `length` symbols lose nothing.  Rows of
one key are told apart by 128 bits of their texts; equal rows are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored, table
from .shingles import _BACK, _BASE, _OF_BYTE, _powers, mix64, text_bytes, word_hashes
from .suffix_index import LAST, RunIndex

LENGTH, GRAM = 400, 100
#: Passages of more than 50 words, and the words of a string that may be an anchor.
WORDS, WORD_GRAM = 51, 9
#: The rolling hash tells strings up to this length apart but for chance.
MOST_LENGTH = 512
#: Distinct segments of one anchor that one task indexes at most.
CROWD = 16_384
#: Bytes of segments in one index; a single anchor's may exceed it.
BLOCK = 3 << 19
_NAMES = ["anchor", "d1", "d2"]
_HITS = "array<struct<a:int,b:int>>"


class _Rolling:
    """Prefix sums that give a hash of any stretch of symbols."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_BASE, n), dtype=np.uint64)])
        self.back = _powers(_BACK, n)

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of `width`."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(key.dtype).max, key.dtype)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def symbols_of(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a string column end to end (uint8 bytes or uint64 words), and where each row begins."""
    raw, at = text_bytes(column)
    if not words:
        return raw, at
    hashes, row = word_hashes(raw, at)
    return np.minimum(hashes, np.uint64(LAST - 1)), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(at) - 1))])


def segments_of(symbols: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, anchor hash, two digests, start in the row, number of windows and anchor's place in it of all segments of texts end to end."""
    n = len(symbols)
    if n < length:
        return tuple(np.zeros(0, k) for k in (np.int64, np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    rolling = _Rolling(_OF_BYTE[symbols] if symbols.dtype == np.uint8 else symbols)
    grams = n - gram + 1
    hashed = mix64((rolling.sums[gram:] - rolling.sums[:-gram]) * rolling.back[:grams])
    low = np.uint64(max(24, int(grams).bit_length()))
    key = (hashed >> low << low) | np.arange(grams, dtype=np.uint64)
    anchor = (_least(key, length - gram + 1) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    windows = n - length + 1
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:windows]
    good = at[1:][row] - np.arange(windows) >= length
    cut = np.ones(windows + 1, bool)
    cut[1:-1] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~good[:-1] | ~good[1:]
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    kept = good[starts]
    starts, ends = starts[kept], ends[kept]
    last = ends - 1 + length
    count = (ends - starts).astype(np.uint64)
    d1 = mix64(rolling.of(starts, last) + count)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed, dtype=np.uint64)])
    d2 = mix64((total[last - gram + 1] - total[starts]) ^ (hashed[starts] * np.uint64(3)) ^ count)
    return row[starts], hashed[anchor[starts]], d1, d2, starts - at[row[starts]], ends - starts, anchor[starts] - starts


def _longs(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType([*schema, *[T.StructField(n, T.LongType()) for n in names]])


def _ints(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType([*schema, *[T.StructField(n, T.IntegerType()) for n in names]])


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def segments(marked: DataFrame, length: int, gram: int, words: bool) -> DataFrame:
    """The segments of all texts of marked (k, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                row, *longs, start, n, spot = segments_of(*symbols_of(part.column("text"), words), length, gram)
                yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(row)), *map(_as_long, longs), *[pa.array(x.astype(np.int32)) for x in (start, n, spot)]], names=["k", *_NAMES, "start", "n", "spot"])

    schema = _ints(_longs(T.StructType([marked.schema["k"]]), *_NAMES), "start", "n", "spot")
    return marked.select("k", "text").mapInArrow(run, schema)


def _fetched(kinds: DataFrame, marked: DataFrame, length: int, words: bool) -> DataFrame:
    """kinds (k, anchor, d1, d2, owner, start, n, spot) with the symbols of each segment, as bytes."""
    asked = kinds.groupBy("k").agg(F.collect_list(F.struct(*_NAMES, "owner", "start", "n", "spot")).alias("asked"))
    width = 8 if words else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                symbols, at = symbols_of(part.column("text"), words)
                held = symbols.tobytes()
                lists = part.column("asked")
                each = lists.flatten()
                sizes = lists.value_lengths().to_numpy()
                begin = np.repeat(at[:-1], sizes) + each.field("start").to_numpy()
                end = begin + each.field("n").to_numpy() + length - 1
                got = pa.array([held[a:b] for a, b in zip((begin * width).tolist(), (end * width).tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[each.field(c) for c in (*_NAMES, "owner", "spot")], got], names=[*_NAMES, "owner", "spot", "symbols"])

    return marked.join(asked, "k").select("text", "asked").mapInArrow(run, _ints(_longs(T.StructType(), *_NAMES, "owner"), "spot").add("symbols", T.BinaryType()))


def _intervals(at: np.ndarray) -> list[dict]:
    """Windows in ascending order as intervals of first and last."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return [{"a": a, "b": b} for a, b in zip(at[np.concatenate([[0], cut + 1])].tolist(), at[np.concatenate([cut, [len(at) - 1]])].tolist(), strict=True)]


def _alike(anchors: list[int], spots: list[int], held: list[bytes], length: int, gram: int, wide: bool) -> np.ndarray:
    """Whether a segment shares enough about its anchor with another of that anchor to share a window.

    What a window holds beside the anchor string lies on its left or its right.  Cut
    at quarters, one of four pairs of a left and a right stretch is in any window,
    and equal windows have it in common.
    """
    sizes = np.fromiter(map(len, held), np.int64, len(held)) // (8 if wide else 1)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    symbols = np.frombuffer(b"".join(held), "<u8" if wide else np.uint8)
    rolling = _Rolling(symbols if wide else _OF_BYTE[symbols])
    place = begin[:-1] + np.array(spots, np.int64)
    kept, anchor, more = np.zeros(len(held), bool), np.array(anchors, np.int64).view(np.uint64), length - gram
    for j in range(4):
        left, right = more * j // 4, more - more * (j + 1) // 4
        has = np.flatnonzero((place - left >= begin[:-1]) & (place + gram + right <= begin[1:]))
        p = place[has]
        key = mix64(mix64(rolling.of(p - left, p) ^ anchor[has]) + rolling.of(np.minimum(p + gram, len(symbols) - 1), p + gram + right) * np.uint64(right > 0))
        _, group, times = np.unique(key, return_inverse=True, return_counts=True)
        kept[has[times[group] > 1]] = True
    return kept


def _across(held: list[bytes], found: list[np.ndarray], owners: list[int | None], length: int, wide: bool) -> list[np.ndarray]:
    """Of the repeated windows those that stand in texts of several owners (None: a text that several have)."""
    hashes = []
    for b, at in zip(held, found, strict=True):
        symbols = np.frombuffer(b, "<u8" if wide else np.uint8)
        rolling = _Rolling(symbols if wide else _OF_BYTE[symbols])
        hashes.append(mix64(rolling.of(at, at + length)))
    sizes = [len(x) for x in found]
    group = np.unique(np.concatenate(hashes), return_inverse=True)[1]
    owner = np.repeat([0 if o is None else o for o in owners], sizes)
    shared = np.repeat([o is None for o in owners], sizes)
    groups = int(group.max(initial=-1)) + 1
    lo, hi, many = np.full(groups, np.iinfo(np.int64).max), np.full(groups, np.iinfo(np.int64).min), np.zeros(groups, bool)
    np.minimum.at(lo, group[~shared], owner[~shared])
    np.maximum.at(hi, group[~shared], owner[~shared])
    many[group[shared]] = True
    kept = (many | (lo < hi))[group]
    return [at[k] for at, k in zip(found, np.split(kept, np.cumsum(sizes)[:-1]), strict=True)]


def _indexed(fetched: DataFrame, length: int, gram: int, words: bool, across: bool, parts: int) -> DataFrame:
    """(anchor, d1, d2, hits): intervals of the windows of each segment that an index finds elsewhere."""
    hits = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[tuple] = []
        held: list[bytes] = []
        size = 0

        def out():
            some = np.flatnonzero(_alike([k[0] for k in names], [k[4] for k in names], held, length, gram, words)).tolist()
            near, own = [held[i] for i in some], [names[i] for i in some]
            found = RunIndex(near, length, words).repeated() if some else []
            if across and some:
                found = _across(near, found, [k[3] for k in own], length, words)
            kept = [(k, _intervals(x)) for k, x in zip(own, found, strict=True) if len(x)]
            columns = [pa.array([k[i] for k, _ in kept], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([x for _, x in kept], hits)], names=[*_NAMES, "hits"])

        for batch in batches:
            for a, x, y, owner, spot, b in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if size > BLOCK and a != names[-1][0]:
                    yield out()
                    names, held, size = [], [], 0
                names.append((a, x, y, owner, spot))
                held.append(b)
                size += len(b)
        if held:
            yield out()

    dealt = fetched.select(*_NAMES, "owner", "spot", "symbols").repartition(parts, "anchor").sortWithinPartitions(*_NAMES)
    return dealt.mapInArrow(run, f"anchor bigint, d1 bigint, d2 bigint, hits {_HITS}")


def _counted(fetched: DataFrame, length: int, words: bool, across: bool) -> DataFrame:
    """The same for crowded anchors, by counting hashed windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                symbols = np.frombuffer(row.column("symbols")[0].as_py(), "<u8" if words else np.uint8)
                values = symbols if words else _OF_BYTE[symbols]
                n = len(values) - length + 1
                h1 = mix64(_Rolling(values).of(slice(0, n), slice(length, length + n)))
                h2 = mix64(_Rolling(values[::-1]).of(np.arange(n)[::-1], np.arange(n)[::-1] + length) ^ np.uint64(0x5851F42D4C957F2D))
                same = lambda c: pa.array([row.column(c)[0].as_py()] * n, pa.int64())
                yield pa.RecordBatch.from_arrays([*[same(c) for c in (*_NAMES, "owner")], pa.array(np.arange(n, dtype=np.int32)), _as_long(h1), _as_long(h2)], names=[*_NAMES, "owner", "a", "h1", "h2"])

    made = T.StructType([*_longs(T.StructType(), *_NAMES, "owner"), T.StructField("a", T.IntegerType()), *_longs(T.StructType(), "h1", "h2")])
    windows = fetched.select(*_NAMES, "owner", "symbols").mapInArrow(run, made)
    more = (F.min("owner") < F.max("owner")) | F.max(F.col("owner").isNull()) if across else F.count("*") > 1
    twice = stored(windows.groupBy("h1", "h2").agg(more.alias("more")).where("more").select("h1", "h2"), "windows")
    hit = windows.join(twice, ["h1", "h2"], "left_semi")
    return hit.groupBy(*_NAMES).agg(F.collect_list(F.struct("a", F.col("a").alias("b"))).alias("hits"))


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, text): k tells rows of one key apart by 128 bits of their texts and their lengths, and a null key is one like others."""
    mark = F.struct(F.octet_length(text).alias("n"), F.xxhash64(text).alias("x"), F.xxhash64(F.lit("mark"), text).alias("y"))
    return docs.select(F.struct(F.col(key).alias("key"), mark.alias("mark")).alias("k"), F.col(text).alias("text"))


def _found(marked: DataFrame, length: int, gram: int, words: bool, across: bool) -> DataFrame:
    """(k, hits): stretches of symbols (a, b), end exclusive, that repeated windows cover, for rows that have any."""
    if not gram <= length <= MOST_LENGTH:
        raise ValueError(f"gram is at most length, and length at most {MOST_LENGTH}")
    own = stored(segments(marked, length, gram, words), "segments")
    # of numbers only, so that Spark aggregates by hashing
    several = (F.min(F.xxhash64("k")) < F.max(F.xxhash64("k"))) if across else F.count("*") > 1
    mixed = (F.min("d1") < F.max("d1")) | (F.min("d2") < F.max("d2"))
    anchors = stored(own.groupBy("anchor").agg(several.alias("several"), mixed.alias("mixed")).where("several").select("anchor", "mixed"), "anchors")
    rows = stored(own.join(anchors, "anchor"), "repeated")
    full = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).alias("b")))
    distinct = rows.where("mixed").groupBy(*_NAMES).agg(several.alias("several"), F.min(F.struct("k", "start", "n", "spot")).alias("one"))
    owner = F.when(~F.col("several"), F.xxhash64("one.k")) if across else F.lit(0).cast("long")
    kinds = stored(distinct.select(*_NAMES, "several", owner.alias("owner"), "one.*"), "kinds")
    crowded = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > CROWD).select("anchor")
    symbols = stored(_fetched(kinds.drop("several"), marked, length, words), "symbols")
    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = _indexed(symbols.join(crowded, "anchor", "left_anti"), length, gram, words, across, parts)
    if crowded.limit(1).count():
        found = found.unionByName(_counted(symbols.join(crowded, "anchor", "left_semi"), length, words, across))
    found = stored(found, "found")
    many = kinds.where("several").select(*_NAMES, full.alias("hits"))
    some = stored(many.unionByName(found.join(many.select(*_NAMES), _NAMES, "left_anti")), "hits")
    alike = rows.where("not mixed").select("k", "start", full.alias("hits")).unionByName(rows.where("mixed").join(some, _NAMES).select("k", "start", "hits"))
    placed = F.transform("hits", lambda h: F.struct((F.col("start") + h["a"]).alias("a"), (F.col("start") + h["b"] + length).alias("b")))
    return alike.select("k", placed.alias("hits")).groupBy("k").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, words: bool = False, across: bool = False) -> DataFrame:
    """(key, hits) for rows that have any: stretches of symbols (a, b), end exclusive, that repeated windows cover.

    Symbols are bytes, or with words=True words between white space with A-Z
    lowered.  With across=True only windows that another row holds too count.
    """
    return _found(_marked(docs, key, text), length, gram, words, across).select(F.col("k.key").alias(key), "hits")


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, n_bytes, removed, kept): the removed stretches of bytes (a, b) in order, and the remaining bytes."""
    marked = _marked(docs, key, text)
    return _cut(marked, _found(marked, length, gram, False, False)).select(F.col("k.key").alias(key), "n_bytes", "removed", "kept")


def _cut(marked: DataFrame, hits: DataFrame) -> DataFrame:
    """(k, n_bytes, removed, kept) from the rows and what was found in them."""
    cut = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                raw, at = text_bytes(part.column("text"))
                held = raw.tobytes()
                removed, kept = [], []
                for i, spans in enumerate(part.column("hits").to_pylist()):
                    body, gone, end, pieces = held[at[i] : at[i + 1]], [], 0, []
                    for s in sorted(spans or [], key=lambda s: s["a"]):
                        if gone and s["a"] <= gone[-1]["b"]:
                            gone[-1]["b"] = max(gone[-1]["b"], s["b"])
                        else:
                            gone.append(dict(s))
                    for s in gone:
                        pieces.append(body[end : s["a"]])
                        end = s["b"]
                    removed.append(gone)
                    kept.append(b"".join([*pieces, body[end:]]))
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(np.diff(at)), pa.array(removed, cut), pa.array(kept, pa.binary())], names=["k", "n_bytes", "removed", "kept"])

    schema = T.StructType([marked.schema["k"], T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))), T.StructField("kept", T.BinaryType())])
    return marked.join(hits, "k", "left").select("k", "text", "hits").mapInArrow(run, schema)


def _covered(hits: Column) -> Column:
    """(runs, total): the maximal runs that intervals cover, and the symbols in them."""
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("runs"), F.lit(0).cast("long").alias("total"))

    def step(a: Column, s: Column) -> Column:
        new = F.greatest(s["b"] - F.greatest(s["a"], a["end"]), F.lit(0))
        return F.struct(F.greatest(a["end"], s["b"]).alias("end"), (a["runs"] + (s["a"] > a["end"]).cast("long")).alias("runs"), (a["total"] + new).alias("total"))

    return F.aggregate(F.array_sort(F.coalesce(hits, F.array().cast(_HITS))), start, step, lambda a: F.struct(a["runs"].alias("runs"), a["total"].alias("total")))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of every document, and the digest of what remains.

    n_passages and n_passage_words beside it: the runs of words, and the words in
    them, that a stretch of more than 50 words covers which another document holds
    too.  400 bytes are more than 50 words in most languages, so shorter passages
    of that many words don't show in what is removed.
    """
    marked = _marked(table(spark, sf_dir, "documents"), "doc_id", "text")
    made = _cut(marked, _found(marked, LENGTH, GRAM, False, False))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + (s["b"] - s["a"]))
    bytes_ = made.select("k", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    passages = _found(marked, WORDS, WORD_GRAM, True, True).select("k", _covered(F.col("hits")).alias("p"))
    none = F.lit(0).cast("long")
    return bytes_.join(passages, "k", "left").select("k.key", *bytes_.columns[1:], F.coalesce("p.runs", none).alias("n_passages"), F.coalesce("p.total", none).alias("n_passage_words")).withColumnRenamed("key", "doc_id")
