"""Spelling variants, shards and ranked search against plain versions on small inputs."""

import heapq
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import sharding, treaps, variants


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words: dict) -> dict:
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


WORDS = (
    {"a": 1, "b": 2, "ab": 9, "": 3, "aa": 4, "aaa": 8, "aaaa": 16, "bbbb": 7, "bbbc": 7, "bbcc": 7, "é" * 9: 3, "é" * 8 + "è": 6, "\U0001f600x": 5, "\U0001f600y": 11}
    | {"stem" + x: 3 + i for i, x in enumerate("abcdefghijklmnopqrstuvwxyz")}
    | {x + "stem": 90 - i for i, x in enumerate("abcdefghijklmnopqrstuvwxyz")}
    | {"same" + x + y + "tail": 5 + i for i, (x, y) in enumerate((x, y) for x in "abcdef" for y in "abcdef")}
    | {"long" * 3000: 4, "long" * 2999 + "lonk": 40, "long" * 1500 + "x" + "long" * 1500: 9}
)


@pytest.mark.parametrize("most_pairs", [0, 1, 30, 10**9])
def test_every_near_pair_is_found_once_however_blocks_are_divided(spark, most_pairs):
    words = spark.createDataFrame(list(WORDS.items()), "word string, n long")
    got = {r["word"]: tuple(r)[1:] for r in variants.group(words, most_pairs).collect()}
    assert got == grouped(WORDS)


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (3, "1 2 3")], "doc_id long, text string")
    assert variants.group(variants.vocabulary(variants.spelled(docs))).count() == 0
    assert variants.group(variants.vocabulary(variants.spelled(docs.limit(0)))).count() == 0


def test_runs_lose_letters_by_hash(spark):
    import zlib

    texts = [(i, " ".join(f"Wörd{chr(97 + i % 26)}{chr(97 + j)}É" for j in range(20))) for i in range(60)] + [(None, "ABCé ABCé"), (7, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit(1))
    want = []
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want.append(run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run)
    assert Counter(r["word"] for r in variants.spelled(docs).collect()) == Counter(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 400)), max_size=12), st.integers(1, 9))
def test_many_equal_groups_are_dealt_as_single_pops_would(sizes, shards):
    heap, single = [(0, s) for s in range(shards)], [(0, s) for s in range(shards)]
    for size, n in sorted(dict(sizes).items(), reverse=True):
        got, want = sharding.deal(heap, size, n), Counter()
        for _ in range(n):
            load, shard = heapq.heappop(single)
            want[shard] += 1
            heapq.heappush(single, (load + size, shard))
        assert got == want
        assert sorted(heap) == sorted(single)


def test_groups_stay_together_and_bytes_are_level(spark):
    texts = ["one"] * 40 + [None, "", None, ""] + [f"text {'x' * (i % 17)} {i}" for i in range(120)] + ["long " * 400]
    docs = spark.createDataFrame([(i % 97 if i % 5 else None, t, "kept", 0) for i, t in enumerate(texts)], "doc_id long, text string, shard string, Bytes int")
    text = F.coalesce("text", F.lit(""))
    rows = sharding.shard(docs, text, F.octet_length(text) + 16, ["doc_id"], 6).collect()
    assert len(rows) == len(texts) and {r["shard"] for r in rows} == {"kept"}
    homes, slots, loads, totals = defaultdict(set), defaultdict(list), Counter(), Counter()
    for r in rows:
        size = len((r["text"] or "").encode()) + 16
        homes[r["text"] or ""].add(r["shard_"])
        slots[r["shard_"]].append(((r["doc_id"] is not None, r["doc_id"] or 0), r["slot"]))
        loads[r["shard_"]] += size
        totals[r["text"] or ""] += size
    assert all(len(h) == 1 for h in homes.values())
    for held in slots.values():
        assert sorted(s for _, s in held) == list(range(len(held)))
        assert [k for k, _ in sorted(held, key=lambda x: x[1])] == sorted(k for k, _ in held)
    heap = [(0, s) for s in range(6)]
    for total in sorted(totals.values(), reverse=True):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + total, shard))
    assert {s: x for x, s in heap} == dict(loads)
    again = sharding.shard(docs, text, F.octet_length(text) + 16, ["doc_id"], 6)
    assert Counter((r["doc_id"], r["text"], r["shard_"], r["slot"]) for r in again.collect() if r["text"]) == Counter((r["doc_id"], r["text"], r["shard_"], r["slot"]) for r in rows if r["text"])


def test_nothing_to_shard(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(docs, F.col("text"), F.lit(1), ["doc_id"]).count() == 0


def ranked(docs: list, queries: list, best: int = 10) -> dict:
    terms = lambda t: [x for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))]
    said = [(i, Counter(terms(t))) for i, t in docs]
    said = [(i, c) for i, c in said if c]
    n, words = len(said), sum(c.total() for _, c in said)
    df = Counter(t for _, c in said for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    asked = defaultdict(set)
    for q, t in queries:
        asked[q] |= set(terms(t))
    out = {}
    for q, ts in asked.items():
        scores = []
        for i, c in said:
            m = 10 + (90 * c.total() * n) // words
            s = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, (i is not None, i), i))
        out[q] = [(i, -s) for s, _, i in sorted(scores, key=lambda x: x[:2])[:best]]
    return {q: x for q, x in out.items() if x}


def found(rows) -> dict:
    out = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: r["rank"]):
        out[r["item"]].append((r["id"], r["score"]))
        assert r["rank"] == len(out[r["item"]])
    return dict(out)


@pytest.mark.parametrize("block_postings", [1, 300, 1 << 22])
def test_search_equals_scoring_all(spark, block_postings):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["ÀÉ", "日本", "x9"]
    shares = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda: " ".join(rng.choice(vocabulary, rng.integers(1, 40), p=shares / shares.sum()))
    docs = [(int(i), text()) for i in rng.permutation(400)] + [(900, None), (901, ""), (902, "-- !"), (903, "W1 w2-W3"), (904, "W1 w2-W3")] + [(1000 + i, "the same text w5 w6") for i in range(50)]
    queries = [(i, text()) for i in range(30)] + [(100, None), (101, "!"), (102, "nowhere"), (103, "w1 W1 w1"), (103, "w2"), (104, "w5 w6 the same"), (None, "w9")]
    found_docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("term", F.lit(1))
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumn("block", F.lit(1))
    got = found(treaps.search(treaps.index(found_docs, block_postings=block_postings), asked, chunk=10))
    assert got == ranked(docs, queries)


def test_search_by_text_keys_and_without_documents(spark):
    docs = [("b", "one two"), (None, "one two"), ("a", "one two"), ("c", "one " * 5000 + "three")]
    queries = [("q", "one three"), ("r", "two")]
    frame = spark.createDataFrame(docs, "doc_id string, text string")
    asked = spark.createDataFrame(queries, "item_id string, text string")
    assert found(treaps.search(treaps.index(frame), asked)) == ranked(docs, queries)
    assert treaps.search(treaps.index(frame.limit(0)), asked).count() == 0
    assert treaps.search(treaps.index(frame), asked.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 3, 10]), st.sampled_from([1, 8, 32]), st.sampled_from([40, 1 << 19]))
def test_walks_give_the_best_of_each_query(seed, best, leaf, frontier):
    rng = np.random.default_rng(seed)
    docs, terms, queries = int(rng.integers(1, 200)), int(rng.integers(1, 8)), int(rng.integers(1, 6))
    runs = [np.flatnonzero(rng.random(docs) < rng.random()) for _ in range(terms)]
    runs = [r if len(r) else np.array([0]) for r in runs]
    impacts = [np.sort(rng.integers(1, 50, len(r)))[:: rng.choice([1, -1])] for r in runs]
    doc, impact = np.concatenate(runs), np.concatenate(impacts)
    asked = [np.flatnonzero(rng.random(terms) < 0.6) for _ in range(queries)]
    was, treaps.LEAF, treaps.FRONTIER = (treaps.LEAF, treaps.FRONTIER), leaf, frontier
    try:
        walk = treaps.Walk(doc, impact, np.concatenate([[0], np.cumsum([len(r) for r in runs])]), docs, queries, best)
        pairs = [(q, t) for q, ts in enumerate(asked) for t in ts]
        if pairs:
            walk.run(*np.array(pairs).T)
    finally:
        treaps.LEAF, treaps.FRONTIER = was
    got = list(zip(*(x.tolist() for x in walk.top)))
    want = []
    for q, ts in enumerate(asked):
        scores = np.zeros(docs, int)
        for t in ts:
            scores[runs[t]] += impacts[t]
        want += [(q, d, int(scores[d])) for d in sorted(range(docs), key=lambda d: (-scores[d], d))[:best] if scores[d]]
    assert sorted(got) == sorted(want)


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(1)
    rank = rng.permutation(500).tolist()
    left, right, roots = treaps.treaps(rank, [0, 200, 201, 500])
    for root, (begin, end) in zip(roots, [(0, 200), (200, 201), (201, 500)]):
        order, stack, node = [], [], root
        while stack or node >= 0:
            while node >= 0:
                stack.append(node)
                node = left[node]
            node = stack.pop()
            order.append(node)
            assert all(c < 0 or rank[c] < rank[node] for c in (left[node], right[node]))
            node = right[node]
        assert order == list(range(begin, end))
