"""Language identification by rank-order profiles (operator 1).

A profile lists the PROFILE most frequent n-grams (one to three characters of
lowered letters, words padded by a blank) of a language, most frequent first.
A text's own list is compared to each profile: every n-gram adds how far it is
out of its place there, or PROFILE if the profile lacks it.  The language with
the least sum is predicted.  Ties of frequency are in code point order, ties of
distance go to the first language by code point.

Texts are read whole.  Counting n-grams of the training rows is a grouped
aggregation with partial counts in each task; no text is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, slices, stored, table

#: n-grams of a profile, and of a text's own list.
PROFILE = 300
#: Profiles that one pass compares to; more languages take more passes over the predictions.
LANGUAGES = 512
#: Distinct n-grams that a training task holds before it hands its counts on.
HELD = 400_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lowered form if it is a letter, else a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _codes(text: str) -> np.ndarray:
    """Lowered letters of a text with one blank before, between and after words; empty without letters."""
    got = _letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    blank = got == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    got = got[keep]
    if len(got) and got[0] != 32:
        got = np.concatenate([np.array([32], np.uint32), got])
    if len(got) and got[-1] != 32:
        got = np.concatenate([got, np.array([32], np.uint32)])
    return got if len(got) > 1 else got[:0]


def _keys(codes: np.ndarray) -> np.ndarray:
    """The 1- to 3-grams as integers of 21 bits a character; blanks alone and n-grams across a blank are left out."""
    c = codes.astype(np.int64)
    a, b = c[:-1] << 21 | c[1:], c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    return np.concatenate([c[c != 32], a, b[c[1:-1] != 32]])


def _gram(key: int) -> str:
    return "".join(chr(x) for x in (key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF) if x)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", profile: int = PROFILE) -> DataFrame:
    """(lang, rank, gram): the profile of each language, rank 0 for its most frequent n-gram.

    Rows without a language or without letters teach nothing.
    """
    schema = "lang string, key bigint, n bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out():
            for k, parts in held.items():
                keys = np.concatenate([p[0] for p in parts])
                order = np.argsort(keys, kind="stable")
                keys, n = keys[order], np.concatenate([p[1] for p in parts])[order]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(first), pa.string()), pa.array(keys[first]), pa.array(np.add.reduceat(n, first))], names=["lang", "key", "n"])

        for whole in batches:
            for part in slices(whole, 1):
                by: dict[str, list[str]] = {}
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by.setdefault(k, []).append(t)
                for k, texts in by.items():
                    codes = _codes(" ".join(texts))
                    if len(codes):
                        got = _counted(_keys(codes))
                        held.setdefault(k, []).append(got)
                        size += len(got[0])
                if size > HELD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    counts = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, schema)
    total = counts.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    # the top of each of many shares of a language's n-grams, then the top of those
    by_share = Window.partitionBy("lang", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy(F.desc("n"), "key")
    by_lang = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    top = total.withColumn("rank", F.row_number().over(by_share)).where(F.col("rank") <= profile)
    top = top.withColumn("rank", F.row_number().over(by_lang) - 1).where(F.col("rank") < profile)
    return top.select("lang", "rank", "key")


class _Judge:
    """Compares texts to a block of profiles."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.names = sorted(profiles)
        self.size = size
        self.keys = np.unique(np.array([k for v in profiles.values() for k in v], np.int64))
        self.place = np.full((len(self.names), len(self.keys) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            self.place[i, np.searchsorted(self.keys, profiles[name])] = np.arange(len(profiles[name]))

    def distances(self, text: str | None) -> tuple[np.ndarray, int] | None:
        """Out-of-place distance to each profile and the largest possible; None without a letter."""
        codes = _codes(text) if text else np.zeros(0, np.uint32)
        if not len(codes):
            return None
        keys, n = _counted(_keys(codes))
        if len(keys) > self.size:
            least = np.partition(n, len(n) - self.size)[len(n) - self.size]
            some = n >= least
            keys, n = keys[some], n[some]
        keys = keys[np.argsort(-n, kind="stable")][: self.size]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        at[self.keys[at] != keys] = len(self.keys)
        place = self.place[:, at]
        out = np.where(place < 0, self.size, np.abs(place - np.arange(len(keys))))
        return out.sum(axis=1), len(keys) * self.size


def _pass(docs: DataFrame, text: str, profiles: dict[str, list[int]], size: int, carried: bool) -> DataFrame:
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def make():
        judge = _Judge(profiles, size)

        def work(batch: pa.RecordBatch) -> list:
            names, scores = [], []
            before = zip(batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist(), strict=True) if carried else iter(lambda: (None, -1.0), 0)
            for t, (name, score) in zip(batch.column(text).to_pylist(), before, strict=False):
                got = judge.distances(t)
                if got is None:
                    names.append("und")
                    scores.append(0.0)
                    continue
                i = int(np.argmin(got[0]))
                now = 1.0 - float(got[0][i]) / got[1]
                keep = name is not None and (score, [-ord(c) for c in name]) >= (now, [-ord(c) for c in judge.names[i]])
                names.append(name if keep else judge.names[i])
                scores.append(score if keep else now)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return work

    return append_columns(docs, text, fields, make)


def predict(docs: DataFrame, profiles: DataFrame, text: str = "text", profile: int = PROFILE) -> DataFrame:
    """docs with lang_pred and score (1 less the least distance as a share of the largest possible).

    lang_pred is 'und', with score 0, for a null text, one without a letter, and
    if there are no profiles.  Profiles have `profile` rows a language; they are
    fetched in blocks of LANGUAGES languages, and each block is one pass.
    """
    names = sorted(r[0] for r in profiles.select("lang").distinct().collect())
    if not names:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    out = docs
    for i in range(0, len(names), LANGUAGES):
        held: dict[str, list[int]] = {}
        for r in profiles.where(F.col("lang").isin(names[i : i + LANGUAGES])).orderBy("lang", "rank").collect():
            held.setdefault(r["lang"], []).append(r["key"])
        out = _pass(out, text, held, profile, i > 0)
    return out


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
    marked = docs.withColumn("held_out", held_out)
    profiles = stored(train(marked.where("not held_out")), "profiles")
    return predict(marked.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
