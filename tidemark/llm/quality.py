"""Quality classification by hierarchical empirical Bayes (operator 3).

Evidence of a document: shares of kinds of characters, word lengths and how
often words repeat, over its whole text, each cut into bins; the labelled rows
give each bin a log likelihood ratio (naive Bayes, damped because the measures
overlap).  Priors of sites: a host's rate of good documents is shrunk towards the
global rate, and a path's rate towards its host's; how strongly is estimated from
how much the groups' rates vary (method of moments).  So a path with few
documents takes its host's rate and one with many its own.  A document's score
is the posterior from its path's rate and its own evidence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, checked_broadcast, fresh, stored, table
from .shingles import text_bytes, word_hashes

#: Kinds of bytes whose shares are measured.
KINDS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "stop": b".,;:?'\"()-",
    "loud": b"!",
    "symbol": b"#$%&*+/<=>@[\\]^_`{|}~",
    "line": b"\n\r",
    "wide": range(128, 256),
}
MEASURES = (*KINDS, "word length", "distinct words", "top word", "size")
BIN_BITS = 4
BINS = 1 << BIN_BITS
#: Texts are compared to texts of their length only: less than 15 words, less than 63, more.
LENGTHS = (4, 6)
CELLS = BINS * (len(LENGTHS) + 1)
#: Overlapping measures count for less than independent ones would.
DAMP = 0.5
#: A document stays if its posterior is at least this.
LEAST = 0.5
BROADCAST_SITES = 100_000


def _measure(column: pa.Array) -> np.ndarray:
    """Bins [rows, measures] of the whole texts; a text without words has all bins 0."""
    raw, at = text_bytes(column)
    n, rows = np.diff(at), len(at) - 1
    out = np.zeros((rows, len(MEASURES)), np.int64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    starts = at[full]
    for i, kind in enumerate(KINDS.values()):
        mask = np.zeros(256, np.uint8)
        mask[list(kind)] = 1
        share = np.add.reduceat(mask[raw], starts, dtype=np.int64) / n[full]
        out[full, i] = np.minimum(BINS - 1, np.ceil(np.sqrt(share) * (BINS - 1)))
    hashes, row = word_hashes(raw, at)
    words = np.bincount(row, minlength=rows)
    some = np.flatnonzero(words)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]))
    times = np.diff(np.append(first, len(h)))
    distinct = np.bincount(r[first], minlength=rows)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, r[first], times)
    k = len(KINDS)
    out[some, k] = np.minimum(BINS - 1, n[some] // words[some])
    out[some, k + 1] = np.minimum(BINS - 1, distinct[some] * BINS // words[some])
    out[some, k + 2] = np.minimum(BINS - 1, np.ceil(np.sqrt(top[some] / words[some]) * (BINS - 1)))
    out[some, k + 3] = np.minimum(BINS - 1, np.log2(words[some] + 1))
    out[words == 0] = 0
    return out


def measured(docs: DataFrame, text: str = "text", out: str = "_bins") -> DataFrame:
    """docs with the bins of all measures, packed into one long."""

    def make():
        shift = np.arange(len(MEASURES)) * BIN_BITS

        def work(batch: pa.RecordBatch) -> list:
            return [pa.array((_measure(batch.column(text)) << shift).sum(axis=1))]

        return work

    return append_columns(docs, text, [T.StructField(out, T.LongType())], make)


def _cell(packed: Column, i: int) -> Column:
    """The bin of measure i, within the length class."""
    part = lambda k: F.shiftright(packed, k * BIN_BITS).bitwiseAND(F.lit(BINS - 1).cast("long")).cast("int")
    size = part(MEASURES.index("size"))
    return part(i) + sum((F.when(size >= x, BINS).otherwise(0) for x in LENGTHS), F.lit(0))


def _evidence(labelled: DataFrame) -> tuple[list[list[float]], float]:
    """Log likelihood ratios [measure][cell] and the global rate, from rows (_bins, y) with y from 0 to 1."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), _cell(F.col("_bins"), i).alias("b")) for i in range(len(MEASURES))]))
    counts = labelled.select(each.alias("x"), "y").groupBy("x.m", "x.b").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")).collect()
    good, bad = np.zeros((2, len(MEASURES), CELLS))
    for r in counts:
        good[r["m"], r["b"]] += r["good"]
        bad[r["m"], r["b"]] += r["bad"]
    rate = good[0].sum() / max(1.0, good[0].sum() + bad[0].sum())
    shape = (len(MEASURES), len(LENGTHS) + 1, BINS)
    g, b = good.reshape(shape) + 0.5, bad.reshape(shape) + 0.5
    ratio = np.log(g / g.sum(axis=2, keepdims=True)) - np.log(b / b.sum(axis=2, keepdims=True))
    ratio = ratio.reshape(len(MEASURES), CELLS)
    return (DAMP * ratio).tolist(), float(rate)


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column, floor: float = 2.0, ceiling: float = 1e5) -> float:
    """How many documents a group's prior counts for: from the spread of rates (good / n) about `mean` beyond chance."""
    p = F.col("good") / F.col("n")
    chance = mean * (1 - mean) / F.col("n")
    spread, inner = groups.agg(F.sum(F.col("n") * ((p - mean) * (p - mean) - chance)) / F.sum("n"), F.sum(F.col("n") * mean * (1 - mean)) / F.sum("n")).first()
    if not spread or spread <= 0 or not inner:
        return ceiling
    return float(min(max(inner / spread - 1, floor), ceiling))


class Model:
    """What fit() learned: likelihood ratios, and the rates of sites as a table (host, path, host_rate, path_rate).

    rows holds (key, host, path, bins) of the documents that it learned from.
    """

    def __init__(self, ratios: list[list[float]], rate: float, sites: DataFrame | None, rows: DataFrame):
        self.ratios, self.rate, self.sites, self.rows = ratios, rate, sites, rows

    def llr(self, packed: Column) -> Column:
        parts = [F.get(F.array(*[F.lit(float(x)) for x in row]), _cell(packed, i)) for i, row in enumerate(self.ratios)]
        return sum(parts[1:], parts[0])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: Column | None = None, path: Column | None = None) -> Model:
    """Learn from all labelled rows and from the sites of all documents.

    labels is (key, quality); several labels of one document are averaged, null
    ones are left out.  host and path default to source, and source with lang.
    Documents without a label count in their site with their own evidence.
    Without labels of both kinds every document gets the rate 0.5 or the one kind's.
    """
    host, path = _default(host, path)
    rows = stored(measured(docs.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"), text), text).drop(text), "measures")
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    joined = stored(rows.join(known, "_key", "left"), "labelled")
    ratios, rate = _evidence(joined.where("y is not null"))
    rate = min(max(rate, 1e-3), 1 - 1e-3) if joined.where("y is not null").limit(1).count() else 0.5
    model = Model(ratios, rate, None, rows)
    soft = F.coalesce("y", 1 / (1 + F.exp(-(model.llr(F.col("_bins")) + float(np.log(rate / (1 - rate)))))))
    paths = stored(joined.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum(soft).alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    k = _strength(hosts, F.lit(rate))
    shrunk = hosts.select("host", ((F.col("good") + k * rate) / (F.col("n") + k)).alias("host_rate"))
    sites = stored(paths.join(shrunk, "host"), "sites")
    kp = _strength(sites, F.col("host_rate"))
    model.sites = stored(sites.select("host", "path", "host_rate", ((F.col("good") + kp * F.col("host_rate")) / (F.col("n") + kp)).alias("path_rate")), "rates")
    return model


def _default(host: Column | None, path: Column | None) -> tuple[Column, Column]:
    host = F.coalesce(F.col("source"), F.lit("")) if host is None else host
    return host, F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))) if path is None else path


#: The columns that scoring adds.
RATED = ("evidence", "host_rate", "path_rate", "quality_score")


def _posterior(rows: DataFrame, model: Model, bins: str, host: str, path: str) -> DataFrame:
    """rows with evidence, host_rate, path_rate and quality_score, from their bins and sites."""
    host_, path_ = fresh([*rows.columns, *RATED], "site_host", "site_path")
    sites = checked_broadcast(model.sites.select(F.col("host").alias(host_), F.col("path").alias(path_), "host_rate", "path_rate"), BROADCAST_SITES)
    placed = rows.withColumn("evidence", model.llr(F.col(bins))).join(sites, (F.col(host) == F.col(host_)) & (F.col(path) == F.col(path_)), "left").drop(host_, path_)
    rated = placed.withColumn("host_rate", F.coalesce("host_rate", F.lit(model.rate))).withColumn("path_rate", F.coalesce("path_rate", F.lit(model.rate)))
    return rated.withColumn("quality_score", 1 / (1 + F.exp(-(F.col("evidence") + _odds(F.col("path_rate"))))))


def score(docs: DataFrame, model: Model, text: str = "text", host: Column | None = None, path: Column | None = None) -> DataFrame:
    """docs with evidence (log likelihood ratio), host_rate, path_rate and quality_score, the posterior.

    Sites that the model doesn't know have the global rate; null and empty texts
    have the bins of no words.  Columns of docs with these names are replaced.
    """
    host, path = _default(host, path)
    kept = [c for c in docs.columns if c not in RATED]
    bins_, host_, path_ = fresh([*docs.columns, *RATED], "bins", "host", "path")
    rows = measured(docs.select(*kept, host.alias(host_), path.alias(path_)), text, bins_)
    return _posterior(rows, model, bins_, host_, path_).select(*kept, *RATED)


def fitted(model: Model, key: str = "doc_id") -> DataFrame:
    """(key, evidence, host_rate, path_rate, quality_score) of the documents that the model learned from, without another look at their texts."""
    return _posterior(model.rows, model, "_bins", "host", "path").select(F.col("_key").alias(key), *RATED)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality posterior of every document, and whether it stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    rated = fitted(fit(docs, table(spark, sf_dir, "labels")))
    return rated.select("doc_id", *RATED, (F.col("quality_score") >= LEAST).alias("kept"))
