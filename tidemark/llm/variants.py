"""Spelling variants by forward and reversed sorted dictionaries (operator 11).

One inserted, deleted or replaced code point leaves one half of a word intact.  Every
word enters the forward dictionary by its first half and the reversed one by
its last half, read backwards, both for pairs in which it is the shorter word (or both are
of one length, m) and for those in which it is the longer.  Sorted by these
halves, words that can be near stand in one block, a range of a dictionary.

A block knows where the edit is: from place `low` to place `high`.  Blocks with more than
MOST_PAIRS pairs are subdivided: the places are halved, so that words have to share a longer head,
or a tail too.  A block of one place can't be divided, but holds no more words than the letters of an alphabet
allow.  Only crowded blocks are divided again, so a word has a few rows more for each
halving.  What is left is merged range by range and verified by edit distance; a pair counts only
in the block that holds the first place where its words differ, so it comes up once.

Null texts have no words, and a null key counts as an empty one.  Without words there are
no rows.  Equal numbers go by code points.  A word of any length is compared whole.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

RUN = "[A-Za-zÀ-ÿ]+"
#: A run whose hash this divides loses a letter.
SLIP = 97
SHORTEST, FEWEST = 5, 3
#: Pairs that a block holds at most before it is subdivided.
MOST_PAIRS = 2048


def spelled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (word) for each run of letters in each text, A-Z in lower case, some with a letter left out."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = F.regexp_extract_all(F.translate(F.col(text), upper, upper.lower()), F.lit(RUN), F.lit(0))
    each = docs.select(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":")).alias("of"), F.explode(runs).alias("run"))
    hashed = each.select("run", F.crc32(F.concat("of", "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % SLIP == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n): words of enough code points that occur often enough."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def _keyed(rows: DataFrame) -> DataFrame:
    """(m, low, high, head, tail, word, n): what the words of a block share before and, backwards, behind the places low to high."""
    head = F.substring("word", F.lit(1), F.col("low"))
    tail = F.substring(F.reverse("word"), F.lit(1), F.greatest(F.col("m") - 1 - F.col("high"), F.lit(0)))
    return rows.select("m", "low", "high", head.alias("head"), tail.alias("tail"), "word", "n")


def _halved(low: Column, high: Column) -> Column:
    """The two halves of the places low to high, of which there are at least two."""
    middle = F.floor((low + high + 1) / 2).cast("int")
    return F.explode(F.array(F.struct(low.alias("low"), (middle - 1).alias("high")), F.struct(middle.alias("low"), high.alias("high"))))


BLOCK = ["m", "low", "high", "head", "tail"]


def blocks(words: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """All blocks of both dictionaries, by rows of their words; blocks that hold no pair are left out."""
    length = F.length("word")
    roles = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m"))
    now = _keyed(roles.select("word", "n", "m", _halved(F.lit(0), F.col("m")).alias("places")).select("word", "n", "m", "places.low", "places.high"))
    done = None
    while True:
        now = stored(now, "dictionary")
        short = F.count_if(F.length("word") == F.col("m"))
        sizes = now.groupBy(*BLOCK).agg((short * (F.count("*") - 1)).alias("pairs")).where("pairs > 0")
        sized = stored(now.join(stored(sizes, "blocks"), BLOCK), "sized")
        crowded = (F.col("pairs") > most_pairs) & (F.col("low") < F.col("high"))
        kept = sized.where(~crowded).drop("pairs")
        done = kept if done is None else done.unionByName(kept)
        if sized.where(crowded).isEmpty():
            return done
        now = _keyed(sized.where(crowded).select("word", "n", "m", _halved(F.col("low"), F.col("high")).alias("places")).select("word", "n", "m", "places.low", "places.high"))


def near_pairs(words: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(a, a_n, b, b_n): each two words of (word, n) that are one edit apart, once."""
    rows = blocks(words, most_pairs)
    shorter = rows.where(F.length("word") == F.col("m")).withColumnsRenamed({"word": "a", "n": "a_n"})
    other = rows.withColumnsRenamed({"word": "b", "n": "b_n"})
    once = (F.length(other["b"]) > F.length(shorter["a"])) | (shorter["a"] < other["b"])
    until = shorter["high"] + 1
    first = F.substring(shorter["a"], F.lit(1), until) != F.substring(other["b"], F.lit(1), until)
    one_apart = F.levenshtein(shorter["a"], other["b"], 1) == 1
    block = reduce(and_, [shorter[c] == other[c] for c in BLOCK])
    return shorter.hint("merge").join(other, block & once & first & one_apart).select("a", "a_n", "b", "b_n")


def group(words: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of (word, n)."""
    pairs = near_pairs(words, most_pairs)
    ends = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")),
    )
    sides = pairs.select(F.explode(ends).alias("x")).select("x.*")
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    larger = -F.col("best.less") >= 2 * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word",
        F.when(larger, F.col("best.other")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(larger, -F.col("best.less")).alias("form_n"),
    )
    formed = stored(formed, "forms")
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) for words that have a form: the last word along their forms.

    A form is at least twice as common as its word, so chains are short; each round
    doubles the way that is known.
    """
    now = stored(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = further.select("word", "root")
        if further.where("moved").isEmpty():
            return now


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, each with its most common near word and the last of that chain."""
    return group(stored(vocabulary(spelled(table(spark, sf_dir, "documents"))), "words"))
