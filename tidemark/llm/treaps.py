"""Ranked lexical search with inverted treaps (operator 13).

The index holds, for blocks of documents, each term's postings in the order of keys.  A
block is what a task has read when it comes to BLOCK_POSTINGS postings, so texts are never shuffled and a
term of a third of all documents is spread over all blocks.

Searching, each posting list becomes a treap: a search tree by document whose nodes
are heap-ordered by impact, so the root of a subtree bounds what its documents can gain from the
term.  The treaps of a query's terms are walked together: a range of documents with
the highest node of each term in it is dropped if these impacts add up to less than the k-th
best score so far; else the document of the largest impact is scored, and splits the range
and all treaps there.  Ranges of up to LEAF documents are scored from the
nodes' runs, a treap in order being its posting list.  All queries of a block
are walked at once, as arrays.  The best k of all blocks give the answer.

Scores are integers: w * ((10**9 * tf) div (1000 * tf + 8 * m)) added up over a query's terms, once each.
Null texts, and texts without terms, are in no block.  Rows of one query key
are one query, which has the terms of all its texts.  Equal scores go by ascending key (nulls
first); rows of one key are ranked as documents of their own.  Without documents or
terms there are no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checked_broadcast, stored, table

#: What a term is, in UTF-8 bytes with A-Z in lower case.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BEST = 10
BLOCK_POSTINGS = 1 << 22
#: Queries that are walked together; documents of a range that is scored at once; (range, term) pairs in memory.
CHUNK, LEAF, FRONTIER = 2048, 32, 1 << 19
#: Terms of queries that are broadcast at most.
MOST_TERMS = 100_000


class _Numbers(dict):
    """Numbers terms in the order of their first use."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _terms(text: pa.Array) -> Iterator[list[bytes]]:
    for whole in text.cast(pa.binary()):
        yield TERM.findall((whole.as_py() or b"").lower())


class _Block:
    """Postings of documents as they are read."""

    def __init__(self) -> None:
        self.numbers, self.ids = _Numbers(), []
        self.term, self.tf, self.sizes, self.lengths = [], [], [], []
        self.postings = 0

    def add(self, ids: pa.Array, said: list[list[bytes]]) -> None:
        self.ids.append(ids)
        for terms in said:
            counts = Counter(terms)
            self.term.append(np.fromiter(map(self.numbers.__getitem__, counts), np.int32, len(counts)))
            self.tf.append(np.fromiter(counts.values(), np.int32, len(counts)))
            self.sizes.append(len(counts))
            self.lengths.append(len(terms))
            self.postings += len(counts)

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """The block's postings by term; the empty term lists all its documents, their keys and their lengths."""
        if not self.sizes:
            return
        ids = pa.concat_arrays(self.ids)
        order = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at, term, tf = np.repeat(place, self.sizes), np.concatenate(self.term), np.concatenate(self.tf)
        by_term = np.argsort(term.astype(np.int64) * len(order) + at)
        at, tf = at[by_term].astype(np.int32), tf[by_term]
        ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.numbers)))])
        names, step = list(self.numbers), 1 << 15
        nothing = lambda n: pa.nulls(n, pa.list_(ids.type))
        listed = lambda values, cuts: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()))
        whole = [0, len(order)]
        columns = [pa.array([b""], pa.binary()), listed(np.arange(len(order)), whole), listed(np.array(self.lengths)[order], whole), pa.ListArray.from_arrays(pa.array(whole, pa.int32()), ids.take(pa.array(order)))]
        for begin in range(-step, len(names), step):
            if begin >= 0:
                cuts = ends[begin : begin + step + 1]
                columns = [pa.array(names[begin : begin + step], pa.binary()), *(listed(x[cuts[0] : cuts[-1]], cuts - cuts[0]) for x in (at, tf)), nothing(len(cuts) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(columns[0]), pa.int64()), *columns], names=["block", "term", "at", "tf", "ids"])


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(block, term, at, tf, ids): where in its block each term occurs and how often; ids are the block's keys, in order."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                said = list(_terms(part.column(1)))
                held = [i for i, terms in enumerate(said) if terms]
                block.add(part.column(0).take(pa.array(held, pa.int64())), [said[i] for i in held])
                if block.postings >= block_postings:
                    yield from block.rows(number)
                    number, block = number + 1, _Block()
        yield from block.rows(number)

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("term", T.BinaryType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType())), T.StructField("ids", T.ArrayType(kind))])
    return stored(docs.select(key, text).mapInArrow(run, schema), "index")


def query_terms(queries: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [list(dict.fromkeys(terms)) for terms in _terms(batch.column(1))]
            at = np.repeat(np.arange(len(said)), [len(terms) for terms in said])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([t for terms in said for t in terms], pa.binary())], names=["item", "term"])

    schema = T.StructType([T.StructField("item", queries.schema[key].dataType), T.StructField("term", T.BinaryType())])
    return queries.select(key, text).mapInArrow(run, schema).distinct()


def treaps(rank: list[int], first: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(left, right, roots) of the treaps over runs of nodes in document order; first: where each run begins, and the end."""
    left, right, roots = [-1] * len(rank), [-1] * len(rank), []
    for begin, end in zip(first, first[1:]):
        path: list[int] = []  # the right spine
        for i in range(begin, end):
            under, mine = -1, rank[i]
            while path and rank[path[-1]] < mine:
                under = path.pop()
            left[i] = under
            if path:
                right[path[-1]] = i
            path.append(i)
        roots.append(path[0])
    return left, right, roots


class Walk:
    """The simultaneous traversal of one block's treaps for many queries.

    A frontier is a set of ranges (query, low, high) of documents and pairs (range,
    node) with the highest node of each of the query's terms there, sorted by range.
    """

    def __init__(self, doc: np.ndarray, impact: np.ndarray, first: np.ndarray, docs: int, queries: int, best: int) -> None:
        self.doc, self.impact, self.docs, self.best = doc, impact, docs, best
        # equal impacts go by a hash of the document, which keeps trees of equal nodes flat
        mixed = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        left, right, self.roots = treaps(((impact << 20) | mixed.astype(np.int64)).tolist(), first.tolist())
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.term = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.sorted = self.term * docs + doc
        self.least = np.ones(queries, np.int64)
        self.top = (np.empty(0, np.int64),) * 3  # query, document, score
        self.scored = 0

    def _highest(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In each node's subtree the highest node from low to high, or -1."""
        node = node.copy()
        open_ = np.flatnonzero(node >= 0)
        while len(open_):
            at = self.doc[node[open_]]
            below, above = at < low[open_], at > high[open_]
            out = below | above
            open_, below = open_[out], below[out]
            node[open_] = np.where(below, self.right[node[open_]], self.left[node[open_]])
            open_ = open_[node[open_] >= 0]
        return node

    def _found(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Takes scored documents into the best of their queries."""
        self.scored += len(score)
        good = score >= self.least[query]
        query, doc, score = (np.concatenate(x) for x in zip(self.top, (query[good], doc[good], score[good])))
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.best - 1
        self.least[query[last]] = score[last]
        self.top = tuple(x[place < self.best] for x in (query, doc, score))

    def _leaves(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, of: np.ndarray, node: np.ndarray) -> None:
        start = self.term[node] * self.docs
        a, b = np.searchsorted(self.sorted, start + low[of]), np.searchsorted(self.sorted, start + high[of], "right")
        n = b - a
        post = np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)
        slot = np.repeat(of * LEAF - low[of], n) + self.doc[post]
        score = np.bincount(slot, self.impact[post], len(query) * LEAF).astype(np.int64)
        hit = np.flatnonzero(score)
        self._found(query[hit // LEAF], low[hit // LEAF] + hit % LEAF, score[hit])

    def run(self, query: np.ndarray, term: np.ndarray) -> None:
        """query, term: the terms of each query, sorted by query."""
        asked, of = np.unique(query, return_inverse=True)
        everything = (asked, np.zeros(len(asked), np.int64), np.full(len(asked), self.docs - 1), of, np.array(self.roots, np.int64)[term])
        todo = [everything]
        while todo:
            query, low, high, of, node = todo.pop()
            if len(node) > FRONTIER and len(query) > 1:
                half = len(query) // 2
                cut = np.searchsorted(of, half)
                todo += [(query[half:], low[half:], high[half:], of[cut:] - half, node[cut:]), (query[:half], low[:half], high[:half], of[:cut], node[:cut])]
                continue
            bound = np.bincount(of, self.impact[node], len(query)).astype(np.int64)
            alive = bound >= self.least[query]
            small = high - low < LEAF
            for kept in (alive & small, alive & ~small):
                if not kept.any():
                    continue
                pairs = kept[of]
                part = (query[kept], low[kept], high[kept], (np.cumsum(kept) - 1)[of[pairs]], node[pairs])
                if small[kept][0]:
                    self._leaves(*part)
                else:
                    todo.append(self._split(*part))

    def _split(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, of: np.ndarray, node: np.ndarray) -> tuple:
        """Scores the document of the largest impact in each range and gives the ranges on both its sides."""
        gain = self.impact[node]
        largest = np.flatnonzero(gain == np.maximum.reduceat(gain, np.searchsorted(of, np.arange(len(query))))[of])
        pivot = self.doc[node[largest[np.searchsorted(of[largest], np.arange(len(query)))]]]
        at = pivot[of]
        hit = self._highest(node, at, at)
        there = hit >= 0
        self._found(query, pivot, np.bincount(of[there], self.impact[hit[there]], len(query)).astype(np.int64))
        sides = (self._highest(node, low[of], at - 1), self._highest(node, at + 1, high[of]))
        of = np.concatenate([2 * of, 2 * of + 1])
        node = np.concatenate(sides)
        order = np.flatnonzero(node >= 0)
        order = order[np.argsort(of[order], kind="stable")]
        of, node = of[order], node[order]
        ranges, of = np.unique(of, return_inverse=True)
        first = ranges % 2 == 0
        i = ranges // 2
        return query[i], np.where(first, low[i], pivot[i] + 1), np.where(first, pivot[i] - 1, high[i]), of, node


def _norms(lengths: np.ndarray, documents: int, words: int) -> np.ndarray:
    """m of each document: 10 + ((90 * n * N) div L)."""
    if len(lengths) and int(lengths.max()) * documents * 90 < 1 << 63:
        return 10 + (90 * lengths.astype(np.int64) * documents) // words
    return np.array([10 + (90 * n * documents) // words for n in lengths.tolist()], np.int64)


def search(indexed: DataFrame, queries: DataFrame, key: str = "item_id", text: str = "text", best: int = BEST, chunk: int = CHUNK) -> DataFrame:
    """(item, rank, id, score): of an index(), the best documents for each query whose score is above 0."""
    everything = F.col("term") == F.lit(b"")
    documents, words = indexed.where(everything).agg(F.sum(F.size("at")), F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    wanted = stored(query_terms(queries, key, text), "terms")
    chunks = -(-wanted.select("item").distinct().count() // chunk)
    kinds = indexed.schema["ids"].dataType.elementType, wanted.schema["item"].dataType
    schema = T.StructType([T.StructField("item", kinds[1]), T.StructField("id", kinds[0]), T.StructField("score", T.LongType())])
    if not documents or not chunks:
        return indexed.sparkSession.createDataFrame([], T.StructType([schema["item"], T.StructField("rank", T.IntegerType()), schema["id"], schema["score"]]))
    dealt = wanted.withColumn("chunk", F.pmod(F.xxhash64("item"), F.lit(chunks)))
    asked = dealt.groupBy("chunk", "term").agg(F.collect_list(F.struct("item")).alias("items"))
    used = wanted.select("term").distinct().union(indexed.sparkSession.createDataFrame([(bytearray(),)], "term binary"))
    hits = stored(indexed.join(checked_broadcast(used, MOST_TERMS), "term", "left_semi"), "hits")
    counted = hits.where(~everything).groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    weighed = counted.select("term", F.floor(1000 * F.log((2 * documents + 2) / (2 * F.col("df") + 1))).alias("w")).where("w > 0")
    lists = asked.join(weighed, "term").select("chunk", "term", "w", "items")
    headers = dealt.select("chunk").distinct().select("chunk", F.lit(b"").alias("term"), F.lit(0).cast("long").alias("w"), F.array().cast(lists.schema["items"].dataType).alias("items"))
    work = hits.join(checked_broadcast(stored(lists.union(headers), "asked"), MOST_TERMS), "term")

    def run(group: pa.Table) -> pa.Table:
        column = lambda name: group.column(name).combine_chunks()
        weight = column("w").to_numpy()
        head = int(np.flatnonzero(weight == 0)[0])
        ids, norm = column("ids")[head].values, _norms(column("tf")[head].values.to_numpy(), documents, words)
        rest = group.take(pa.array(np.flatnonzero(weight > 0), pa.int64()))
        column = lambda name: rest.column(name).combine_chunks()
        sizes = column("at").value_lengths().to_numpy()
        doc, tf = (column(name).flatten().to_numpy().astype(np.int64) for name in ("at", "tf"))
        impact = np.repeat(column("w").to_numpy(), sizes) * ((10**9 * tf) // (1000 * tf + 8 * norm[doc]))
        items = column("items")
        coded = items.flatten().field("item").dictionary_encode(null_encoding="encode")
        query, term = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), items.value_lengths().to_numpy())
        order = np.argsort(query, kind="stable")
        walk = Walk(doc, impact, np.concatenate([[0], np.cumsum(sizes)]), len(norm), len(coded.dictionary), best)
        if len(order):
            walk.run(query[order], term[order])
        asked_by, found, score = walk.top
        return pa.table({"item": coded.dictionary.take(pa.array(asked_by)), "id": ids.take(pa.array(found)), "score": pa.array(score, pa.int64())})

    each = work.groupBy("block", "chunk").applyInArrow(run, schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("item", "rank", "id", "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item, with their scores."""
    found = search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
