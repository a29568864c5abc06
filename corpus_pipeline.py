"""The corpus pipeline: quality, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir), where docs is all that the stage before
kept, and returns rows; all but the last return the columns of documents.  Null
texts count as empty, and further columns of documents are kept as they are.  Rows of
one doc_id are taken for one document: they stay, go or are repeated alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, minhash, mixing, pii, quality
from tidemark.llm.common import fresh, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality posterior is under one half go."""
    rated = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return rated.where(F.col("quality_score") >= quality.LEAST).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles at 80 percent, that with the least id stays."""
    classes = minhash.near_duplicates(docs, width=5, percent=80)
    return docs.join(classes.where("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind in brackets."""
    (spans,) = fresh(docs.columns, "spans")
    masked = pii.mask(pii.find(docs, spans=spans), spans=spans)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 3, 1, 2 in turn at 150 percent of all words: a row for each copy that is taken."""
    sized = stored(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sized")
    targets = stored(mixing.fill_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), [3, 1, 2], 1.5, mixing.MOST_COPIES), "targets")
    mixed = mixing.mix(sized.withColumn("sources", F.array("source")), targets)
    key, times, copy = fresh(docs.columns, "key", "times", "copy")
    copies = mixed.where("size > 0").groupBy(F.col("doc_id").alias(key)).agg(F.max(F.round(F.col("taken") / F.col("size")).cast("int")).alias(times)).where(F.col(times) > 0)
    taken = docs.join(copies, F.col("doc_id").eqNullSafe(F.col(key)))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and a digest of the text that they decode to."""
    path = bpe.default_path()
    coded = bpe.encode(docs.select("doc_id", "source", "text"), path).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")
    return bpe.decode(coded, path).select("doc_id", "source", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: Fitted likelihoods, sketches and merges aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        docs = stored(made, f"stage{i + 1}") if i + 1 < len(STAGES) else made
    return docs
