"""Likeness of names and merged accounts against plain versions."""

import heapq
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.people import jaro_winkler
from tidemark.operators import graph, identity


def plain(a, b, halving):
    """Jaro-Winkler, character by character."""
    if a == b:
        d = 1.0
    elif not a or not b:
        d = 0.0
    else:
        reach = max(len(a), len(b)) // 2 - 1
        at, taken = [], set()
        for i, c in enumerate(a):
            j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == c), -1)
            at.append(j)
            taken.add(j)
        right = [b[j] for j in sorted(j for j in at if j >= 0)]
        apart, k = 0.0, 0
        for c, j in zip(a, at):
            if j >= 0:
                apart += c != right[k]
                k += 1
            if halving:
                apart /= 2
        if not halving:
            apart = apart // 2
        d = (k / len(a) + k / len(b) + (k - apart) / k) / 3 if k else 0.0
    if d > 0.7:
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        d += 0.1 * min(4, same) * (1 - d)
    return d


@pytest.mark.parametrize("halving", [True, False])
def test_jaro_winkler_of_random_texts(spark, halving):
    rng = random.Random(7)
    text = lambda: "".join(rng.choice("aabcdé😀 ") for _ in range(rng.randrange(12)))
    pairs = [("martha", "marhta"), ("", ""), ("", "a"), ("a", ""), ("dixon", "dicksonx"), ("a", "b"), ("ab", "ba"), (None, "a"), ("a", None), ("x" * 300, "x" * 299 + "y")]
    for _ in range(400):
        a = text()
        b = a[: rng.randrange(len(a) + 1)] + text() if rng.random() < 0.6 else text()
        pairs.append((a, b))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", jaro_winkler(F.col("a"), F.col("b"), halving).alias("d"))
    assert "Python" not in rows._jdf.queryExecution().toString()
    for r in rows.collect():
        want = None if r.a is None or r.b is None else plain(r.a, r.b, halving)
        assert r.d == (None if want is None else pytest.approx(want, abs=1e-12)), (r.a, r.b)


def merged(spark, rows, **options):
    accounts = identity.normalised(spark.createDataFrame(rows, "uid long, login string, name string, email string"))
    labels = identity.link_labels(identity.clue_pairs(accounts, **options), accounts)
    members = graph.min_label_components(labels.select("a", "b").distinct()).select(F.col("node").alias("uid"), F.col("component").alias("cluster"))
    return {r.uid: r.representative for r in identity.merged_accounts(accounts, members, labels).collect()}


def test_an_address_counts_for_all_its_pairs(spark):
    four = [(i, f"login{i}", f"name{i}", "one@mail.org") for i in (1, 2, 3)] + [(4, "login4", "bee", "one@mail.org")]
    fifth = (5, "bee", "bee", "other@place.org")
    assert merged(spark, [*four, fifth]) == {2: 1, 3: 1, 4: 1, 5: 1}  # six pairs of one address, five members


def test_other_clues_between_accounts_of_one_address_do_not_count(spark):
    rows = [(1, "x1", "Ann Lee", "a.b@mail.org"), (2, "x2", "Cid Orr", "a.b@mail.org"), (3, "x3", "Cid Orr", "a.b@mail.org"), (4, "x4", "Dan Poe", "a.c@far.org"), (5, "x5", "Dan Poe", "z.c@near.org"), (6, "x6", "Eve", "a.b@third.org")]
    assert merged(spark, rows) == {2: 1, 3: 1, 5: 4}


def _by_heap(edges, node):
    """The definition, one neighbourhood at a time."""
    out = {}
    for s, t, at in edges:
        out.setdefault(s, []).append((at, t))
    people, passed = sorted({x for e in edges for x in e[:2]}), 0
    for source in people:
        done, heap = {}, [(0, source, (source,))]
        while heap:
            _, here, path = heapq.heappop(heap)
            if here in done:
                continue
            done[here] = path
            for when, there in out.get(here, []):
                if there not in done:
                    heapq.heappush(heap, (when, there, (*path, there)))
        passed += sum(node in p for p in done.values())
    return passed / len(people) ** 2


def test_ego_betweenness_of_a_crowd(spark, monkeypatch):
    """Equal to the definition with many equal times, alike and different neighbourhoods in several parts; a crowd of 300 that all know each other shares its trees."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(identity, "SOURCES_A_TASK", 4)
    few = {(int(s), int(t)): int(at) for s, t, at in zip(rng.integers(0, 12, 50), rng.integers(0, 12, 50), rng.integers(1, 6, 50), strict=True) if s != t}
    few |= {(s + 100, t + 100): at for (s, t), at in list(few.items())[:12]} | {(11, 100): 3}
    rows = [(*k, at) for k, at in few.items()]
    for radius in (1, 2):
        near = {n: {n} for r in rows for n in r[:2]}
        for _ in range(radius):
            near = {n: m | {b if a in m else a for a, b, _ in rows if a in m or b in m} for n, m in near.items()}
        got = {r["node"]: r["share"] for r in identity.ego_betweenness(spark.createDataFrame(rows, "src long, tgt long, ts long"), radius).collect()}
        assert got.keys() == near.keys()
        for n, m in near.items():
            assert got[n] == pytest.approx(_by_heap([e for e in rows if e[0] in m and e[1] in m], n)), n
    monkeypatch.setattr(identity, "SOURCES_A_TASK", 32)
    k = 300
    s, t = (F.col("id") / k).cast("long"), F.col("id") % k
    began = time.perf_counter()
    assert identity.ego_betweenness(spark.range(k * k).select(s.alias("src"), t.alias("tgt"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("ts")).where("src <> tgt")).count() == k
    assert time.perf_counter() - began < 90


def test_neighbourhoods_are_found_without_pairs(spark, monkeypatch):
    """Bits of several tasks give the neighbourhoods of joins for each radius; a crowd's edges are stored once, whatever the tasks that read them."""
    rng = np.random.default_rng(7)
    rows = [(int(s), int(t), int(at)) for s, t, at in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.integers(1, 9, 150), strict=True) if s != t]
    df = spark.createDataFrame(rows, "src long, tgt long, ts long")
    monkeypatch.setattr(identity, "SOURCES_A_TASK", 8)
    stored, keep = [], identity.shared_table
    monkeypatch.setattr(identity, "shared_table", lambda df, label: stored.append(label) or keep(df, label))
    for radius in (2, 3):
        got = []
        for people, nodes in ((0, 1024), (1000, 16)):
            monkeypatch.setattr(identity, "BROADCAST_ROWS", people)
            monkeypatch.setattr(identity, "NODES_A_TASK", nodes)
            stored.clear()
            got.append({r["node"]: r["share"] for r in identity.ego_betweenness(df, radius).collect()})
            assert ("near" in stored) == (people == 0) and ("around" in stored) == (people > 0)
        assert got[0] == got[1]
