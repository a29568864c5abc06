"""Near duplicates, repeats, mixing, quality, media and the pipeline, against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import components, media, minhash, mixing, quality, repeats
from tidemark.llm.suffix_index import RunIndex

SMALL = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[i:] for i in range(width)), strict=False))


def classes(sets, percent=80):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                r, s = find(a), find(b)
                root[max(r, s)] = min(r, s)
    return {i: find(i) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10_000)}"
    return " ".join(out)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_by_brute_force(spark, width):
    rng = random.Random(width)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    # near copies on both sides of the threshold, so that links can run through others
    texts = [edited(rng, base, rng.randrange(0, 16)) for _ in range(120)] + ["Same Text"] * 5 + ["same text", None, "", " \n", "one", "one", "two words", "x " * 5000]
    texts += [" ".join(f"u{rng.randrange(9)}" for _ in range(8)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("bands", F.lit("clash"))
    got = {r.doc_id: r for r in minhash.near_duplicates(df, width=width).collect()}
    sets = {i: shingle_set(t, width) for i, t in enumerate(texts)}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == classes(sets)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_unequal_words_stay_apart(spark):
    """Words on which polynomial hashes modulo 2^64 agree whatever the base."""
    rows = []
    for i, power in enumerate((10, 11, 12)):
        word = "a"
        for _ in range(power):
            word += word.translate(str.maketrans("ab", "ba"))
        rows += [(2 * i, word), (2 * i + 1, word.translate(str.maketrans("ab", "ba")))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i, _ in rows}
    with pytest.raises(ValueError):
        minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=70)


def test_links_of_a_crowded_group(spark, monkeypatch):
    """Members of one leader's group that link to each other but not to the leader, over many blocks."""
    monkeypatch.setattr(minhash, "GROUP_BLOCK", 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(12):
        kind = edited(rng, base, 11).split()
        texts += [edited(rng, kind, rng.randrange(4)) for _ in range(8)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(9000, texts[0]), (9000, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    want = classes({i * 3: shingle_set(t, 2) for i, t in enumerate(texts)})
    assert len(set(want.values())) > 2
    assert {r.doc_id: r.component_id for r in got if r.doc_id < 9000} == want


def test_near_duplicate_query(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r.component_id for r in minhash.op7_minhash(spark, SMALL).collect()}
    assert got == classes({i: shingle_set(t, 2) for i, t in zip(docs.doc_id, docs.text, strict=True)})


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(200, 100), (200, 300), (5, 5)], "a long, b long")
    want = {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100}
    assert {r.node: r.component for r in components.components(edges).collect()} == want
    assert components.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("length", [8, 24, 40])
def test_run_index(length):
    rng = random.Random(length)
    for _ in range(150):
        letters = rng.choice([1, 2, 3, 20])
        base = bytes(rng.randrange(97, 97 + letters) for _ in range(120))
        texts = []
        for _ in range(rng.randrange(1, 8)):
            t = b""
            for _ in range(rng.randrange(1, 5)):
                a = rng.randrange(110)
                t += base[a : a + rng.randrange(1, 80)] + bytes(rng.randrange(97, 97 + letters) for _ in range(rng.randrange(6)))
            texts.append(t)
        times = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [[i for i in range(len(t) - length + 1) if times[t[i : i + length]] > 1] for t in texts]
        assert [x.tolist() for x in RunIndex(texts, length).repeated()] == want


def removed(texts, length):
    times = collections.Counter(b[i : i + length] for b in texts.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in texts.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[k] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [16_384, 1])
def test_repeats_by_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(3)]
    texts = []
    for _ in range(60):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(60)
            parts += [s[a : a + rng.randrange(40, 200)], text(rng.randrange(20))]
        texts.append("".join(parts))
    texts += [None, "", texts[3], texts[3], "z" * 700, "ab" * 300, shared[0] * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("anchor", F.lit("clash"))
    made = repeats.remove(df, length=60, gram=16)
    got = {r.doc_id: (r.n_bytes, sum(s.b - s.a for s in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in made.collect()}
    assert got == removed({i: (t or "").encode() for i, t in enumerate(texts)}, 60)
    assert repeats.remove(df.limit(0)).count() == 0


def passages(texts, length):
    """(runs, words) that stretches of words cover which another text holds too."""
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) for k, t in texts.items()}
    held = collections.defaultdict(set)
    for k, w in words.items():
        for i in range(len(w) - length + 1):
            held[tuple(w[i : i + length])].add(k)
    out = {}
    for k, w in words.items():
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            if len(held[tuple(w[i : i + length])]) > 1:
                gone[i : i + length] = True
        out[k] = (int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), int(gone.sum()))
    return out


@pytest.mark.parametrize("crowd", [16_384, 1])
def test_passages_of_words_by_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(12)}" for _ in range(n)]
    shared = [text(40) for _ in range(3)]
    texts = []
    for _ in range(60):
        parts = text(rng.randrange(20))
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(30)
            parts += s[a : a + rng.randrange(8, 30)] + text(rng.randrange(8))
        texts.append(" ".join(parts))
    # the last one repeats itself only, which isn't across texts
    texts += [None, "", texts[3].upper(), texts[3], "one two three four five six seven eight nine ten " * 4]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("owner", F.lit("clash"))
    hits = repeats.find(df, length=10, gram=3, words=True, across=True)
    found = {r.doc_id: (r.p.runs, r.p.total) for r in hits.select("doc_id", repeats._covered(F.col("hits")).alias("p")).collect()}
    assert {i: found.get(i, (0, 0)) for i in range(len(texts))} == passages(dict(enumerate(texts)), 10)
    assert found.get(len(texts) - 1) is None
    assert repeats.find(df.limit(0), words=True, across=True).count() == 0


def test_repeats_of_one_key(spark):
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(300))
    rows = [(1, long), (1, long), (None, "x" + long), (None, "short"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, sum(s.b - s.a for s in r.removed)) for r in repeats.remove(df, length=60, gram=16).collect())
    assert got == [(0, 5, 0), (0, 301, 300), (1, 300, 300), (1, 300, 300), (2, 0, 0)]
    with pytest.raises(ValueError):
        repeats.remove(df, length=2000)


def test_repeats_query(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    rows = repeats.op10_repeats(spark, SMALL).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == removed({i: (t or "").encode() for i, t in zip(docs.doc_id, docs.text, strict=True)}, 400)
    assert {r.doc_id: (r.n_passages, r.n_passage_words) for r in rows} == passages(dict(zip(docs.doc_id, docs.text, strict=True)), 51)


def test_flow_is_of_least_cost():
    flow = mixing.route({"a": (10, ["A"]), "ab": (10, ["A", "B"]), "b": (5, ["B"])}, {"A": 15, "B": 10})
    taken = {p: sum(f.values()) for p, f in flow.items()}
    assert sum(taken.values()) == 25
    assert taken == {"a": 10, "ab": 10, "b": 5}  # nothing is repeated while fresh words are left
    flow = mixing.route({"a": (10, ["A"]), "ab": (10, ["A", "B"])}, {"A": 15, "B": 20})
    assert sum(sum(f.values()) for f in flow.values()) == 35
    assert sum(f.get("B", 0) for f in flow.values()) == 20


def test_mixing_query(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    docs["words"] = docs.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    got = mixing.op2_mixing(spark, SMALL).toPandas()
    again = mixing.op2_mixing(spark, SMALL).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    both = got.merge(docs, on="doc_id")
    assert (both["size"] == both.words).all()
    assert (both.taken <= 2 * both["size"]).all()
    per = both.groupby("source").agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    assert (per["size"] == per.told).all()
    weights = np.array([[3, 1, 2][i % 3] for i in range(len(per))], float)
    want, left = np.zeros(len(per)), np.ones(len(per), bool)
    while True:  # the excess is shared again until none is above
        level = (1.5 * per["size"].sum() - want[~left].sum()) / weights[left].sum()
        over = left & (weights * level > 2 * per["size"].to_numpy())
        if not over.any():
            break
        want[over] = 2 * per["size"].to_numpy()[over]
        left &= ~over
    want[left] = weights[left] * level
    assert np.allclose(per.target, want)
    assert (per.taken - per.target).abs().max() <= 1


def test_mixing_edges(spark):
    rows = spark.createDataFrame([(1, ["a"], 10), (2, ["a", "b"], 10), (3, ["b", None], 0), (4, [None], 6), (5, None, 3), (6, ["a"], None)], "doc_id long, sources array<string>, size long")
    targets = spark.createDataFrame([("a", 12.0), ("b", 15.0), (None, 12.0)], "source string, target double")
    got = {r.doc_id: r.taken for r in mixing.mix(rows, targets).collect()}
    assert got[4] == 12
    assert got[3] == got[5] == got[6] == 0
    assert got[1] + got[2] == 27
    assert mixing.mix(rows.limit(0), targets).count() == 0
    none = spark.createDataFrame([], "source string, source_size long")
    assert mixing.fill_targets(none, [3, 1, 2], 1.5, 2).count() == 0


def test_mixing_of_many_patterns(spark):
    own = F.concat(F.lit("u"), F.col("doc_id").cast("string"))
    docs = spark.range(50_100).withColumnRenamed("id", "doc_id").select("doc_id", F.array(F.lit("a"), F.lit("b"), own).alias("sources"), F.lit(10).alias("size"))
    targets = spark.createDataFrame([("a", 100_000.0), ("b", 200_000.0), ("u7", 1000.0)], "source string, target double")
    got = mixing.mix(docs, targets).agg(F.sum("taken"), F.max("taken"), F.count("*")).first()
    assert tuple(got) == (300_020, 20, 50_100)  # each source gets its words; u7 has a single document


def test_flow_fills_as_much_as_can_be():
    rng = random.Random(5)
    for _ in range(200):
        sources = "ABCDE"[: rng.randint(1, 5)]
        offers = {f"p{i}": (rng.randint(0, 9), sorted(rng.sample(sources, rng.randint(1, len(sources))))) for i in range(rng.randint(1, 7))}
        quotas = {s: rng.randint(0, 25) for s in sources}
        for copies in (1, 2):
            flow = mixing.route(offers, quotas, copies)
            for p, f in flow.items():
                assert set(f) <= set(offers[p][1]) and min(f.values(), default=0) > -1e-6
                assert sum(f.values()) <= copies * offers[p][0] + 1e-6
            assert all(sum(f.get(s, 0) for f in flow.values()) <= quotas[s] + 1e-6 for s in sources)
            # By the least cut: sources outside it, and the patterns that reach only them.
            cuts = [sum(quotas[s] for i, s in enumerate(sources) if not m >> i & 1) + sum(copies * n for n, of in offers.values() if any(m >> sources.index(s) & 1 for s in of)) for m in range(1 << len(sources))]
            assert abs(sum(sum(f.values()) for f in flow.values()) - min(cuts)) < 1e-6
            if copies == 2:  # nothing is repeated while fresh words are left
                fresh = mixing.route(offers, quotas, 1)
                assert sum(min(sum(f.values()), offers[p][0]) for p, f in flow.items()) >= sum(sum(f.values()) for f in fresh.values()) - 1e-6


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.where("doc_id % 3 > 0")
    rated = quality.score(docs, quality.fit(docs, train)).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    right = ((rated.quality_score >= quality.LEAST) == (rated.quality == 1)).mean()
    assert right > 0.95
    good = rated[rated.quality == 1]
    assert (good.quality_score >= quality.LEAST).mean() > 0.97


def plain_bins(text):
    """The bins of a text, one measure after the other."""
    raw = (text or "").encode()
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not words:
        return [0] * len(quality.MEASURES)
    last = quality.BINS - 1
    out = [min(last, int(np.ceil(np.sqrt(sum(b in set(kind) for b in raw) / len(raw)) * last))) for kind in quality.KINDS.values()]
    top = max(collections.Counter(words).values())
    return [*out, min(last, len(raw) // len(words)), min(last, len(set(words)) * quality.BINS // len(words)), min(last, int(np.ceil(np.sqrt(top / len(words)) * last))), min(last, int(np.log2(len(words) + 1)))]


def test_quality_posterior_by_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        host = rng.choice("aab")
        good = rng.random() < (0.8 if host == "a" else 0.4)
        words = [rng.choice(["plain", "words", "in", "a", "row,"]) if good or rng.random() < 0.3 else rng.choice(["WIN!!!", "$$$", "99", "now!"]) for _ in range(rng.randrange(0, 90))]
        rows.append((i, " ".join(words), host, rng.choice(["x", "y"]), int(good) if i % 3 else None))
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    model = quality.fit(docs, spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int"))
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    told = {r.doc_id: r for r in quality.fitted(model).collect()}
    bins = {r[0]: plain_bins(r[1]) for r in rows}
    cell = lambda b, m: b[m] + quality.BINS * sum(b[-1] >= x for x in quality.LENGTHS)
    counts = np.zeros((2, len(quality.MEASURES), quality.CELLS))
    for i, _, _, _, y in rows:
        for m in range(len(quality.MEASURES)):
            if y is not None:
                counts[y, m, cell(bins[i], m)] += 1
    ratio = np.zeros(counts.shape[1:])
    for m in range(len(quality.MEASURES)):
        for c in range(0, quality.CELLS, quality.BINS):
            bad, good = (counts[y, m, c : c + quality.BINS] + 0.5 for y in (0, 1))
            ratio[m, c : c + quality.BINS] = quality.DAMP * (np.log(good / good.sum()) - np.log(bad / bad.sum()))
    rate = counts[1, 0].sum() / counts[:, 0].sum()
    evidence = {i: sum(ratio[m, cell(b, m)] for m in range(len(b))) for i, b in bins.items()}
    soft = {i: y if y is not None else 1 / (1 + np.exp(-(evidence[i] + np.log(rate / (1 - rate))))) for i, _, _, _, y in rows}

    def strength(groups, means):
        n, good = np.array([len(g) for g in groups]), np.array([sum(soft[i] for i in g) for g in groups])
        p, mean = good / n, np.array(means)
        spread, inner = (n * ((p - mean) ** 2 - mean * (1 - mean) / n)).sum() / n.sum(), (n * mean * (1 - mean)).sum() / n.sum()
        return min(max(inner / spread - 1, 2.0), 1e5) if spread > 0 else 1e5

    hosts = {h: [r[0] for r in rows if r[2] == h] for h in "ab"}
    k = strength(list(hosts.values()), [rate] * 2)
    host_rate = {h: (sum(soft[i] for i in g) + k * rate) / (len(g) + k) for h, g in hosts.items()}
    paths = {(h, p): [r[0] for r in rows if r[2:4] == (h, p)] for h in "ab" for p in "xy"}
    k = strength(list(paths.values()), [host_rate[h] for h, _ in paths])
    for (h, p), g in paths.items():
        path_rate = (sum(soft[i] for i in g) + k * host_rate[h]) / (len(g) + k)
        for i in g:
            want = 1 / (1 + np.exp(-(evidence[i] + np.log(path_rate / (1 - path_rate)))))
            assert abs(got[i].quality_score - want) < 1e-9
            assert abs(told[i].quality_score - want) < 1e-9


def test_quality_shrinks_small_sites(spark):
    rows = [(i, "fine words in a row here", "big", "en") for i in range(200)] + [(900, "fine words in a row here", "tiny", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)] + [(900, 0)], "doc_id long, quality int")
    rates = {r.host: r.path_rate for r in quality.fit(df, labels).sites.collect()}
    assert abs(rates["big"] - 0.75) < 0.03
    assert rates["tiny"] > 0.2  # one bad document doesn't condemn a site


def test_quality_edges(spark):
    rows = spark.createDataFrame([(1, None, None, None, "x"), (2, "", "s", "en", "x"), (2, "", "s", "en", "x"), (3, "word " * 20_000, "s", None, "x")], "doc_id long, text string, source string, lang string, evidence string")
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0)], "doc_id long, quality int")
    got = quality.score(rows, quality.fit(rows, labels)).collect()
    assert len(got) == 4
    assert all(0 <= r.quality_score <= 1 for r in got)
    assert quality.score(rows.limit(0), quality.fit(rows.limit(0), labels.limit(0))).count() == 0


def test_media_groups(spark):
    got = media.op4_media(spark, SMALL).toPandas()
    base = got.vec_id // 4 * 4
    want = np.where(got.vec_id % 4 < 3, base, got.vec_id)
    assert (got.group_id == want).mean() > 0.98


def test_media_turns_and_edges(spark):
    picture = media.decode_pgm(media.drawn(spark.range(1), "id").first().image)
    turned = media.encode_pgm(np.rot90(picture).copy())
    whole = media.encode_pgm(picture)
    rows = [(1, bytearray(whole)), (2, bytearray(turned)), (3, bytearray(whole)), (4, None), (5, bytearray(b"no image")), (6, bytearray(b"P5\n4 4\n255\n" + bytes(16))), (7, bytearray(b"P5\n64 64\n255\n" + bytes(4096))), (8, bytearray(b"P5\n9"))]
    df = spark.createDataFrame(rows, "image_id long, image binary").withColumn("corners", F.lit(1))
    got = {r.image_id: r.group_id for r in media.find_copies(df).collect()}
    assert got[1] == got[2] == got[3] == 1
    assert [got[i] for i in (4, 5, 6, 7, 8)] == [4, 5, 6, 7, 8]
    assert media.find_copies(df.limit(0)).count() == 0


def brute_links(pictures):
    """The links of all pairs of images, from every pair of corners that agree in a table."""
    links = set()
    rows = [np.array([[i, *c["keys"], *[c[n] for n in media.PLACE]] for c in d], np.int64).reshape(-1, 1 + media.TABLES + len(media.PLACE)) for i, d in enumerate(media.describe(pictures))]
    keys = slice(1, 1 + media.TABLES)
    for b in range(len(pictures)):
        for a in range(b):
            met = [(i, j) for i, p in enumerate(rows[a]) for j, q in enumerate(rows[b]) if (p[keys] == q[keys]).any() and sum(int(x ^ y).bit_count() for x, y in zip(p[keys], q[keys], strict=True)) <= media.MOST_APART]
            if len(met) >= media.VOTES:
                i, j = np.array(met).T
                _, factors, shifts = media._votes(rows[a][i, 1 + media.TABLES :], rows[b][j, 1 + media.TABLES :], np.zeros(len(met), np.int64), media.VOTES)
                if any(media._supported(rows[a], rows[b], f, m) for f, m in zip(factors, shifts, strict=True)):
                    links.add((a, b))
    return links


def test_media_corners_and_descriptors_by_hand():
    """The strongest local maximum of each cell, and the comparisons about it, pixel by pixel."""
    rng = np.random.default_rng(3)
    picture = rng.integers(0, 256, (40, 52)).astype(np.uint8)
    f, r, g = picture.astype(np.float32), media.RADIUS, media.GRID
    dy, dx = np.gradient(f)
    add = lambda v, y, x: v[y - 1 : y + 2, x - 1 : x + 2].sum()
    response = {}
    for y in range(r - 1, 41 - r):
        for x in range(r - 1, 53 - r):
            xx, yy, xy = add(dx * dx, y, x), add(dy * dy, y, x), add(dx * dy, y, x)
            response[y, x] = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    best = {}
    for (y, x), v in response.items():
        if r <= y < 40 - r and r <= x < 52 - r and v > 1 and all(v > response[y + i, x + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j):
            cell = ((y - r) // g, (x - r) // g)
            best[cell] = max(best.get(cell, (-1.0, 0, 0)), (v, y, x))
    _, ys, xs = media._corners(picture[None].astype(np.float32))
    assert sorted(zip(ys.tolist(), xs.tolist())) == sorted((y, x) for _, y, x in best.values())
    turn, keys = media._describe(picture[None].astype(np.int32), np.zeros(len(ys), np.int64), ys, xs)
    for y, x, t, k in zip(ys, xs, turn, keys):
        disc = [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= r * r]
        angle = np.arctan2(sum(int(picture[y + i, x + j]) * i for i, j in disc), sum(int(picture[y + i, x + j]) * j for i, j in disc))
        assert t == round(angle / (2 * np.pi) * media.TURNS) % media.TURNS
        padded = np.pad(picture.astype(int), 2, mode="edge")
        smooth = lambda i, j: padded[y + i + 1 : y + i + 4, x + j + 1 : x + j + 4].sum()  # noqa: E731, B023
        bits = [smooth(a, b) < smooth(c, d) for a, b, c, d in media._tests()[t]]
        each = media.TESTS // media.TABLES
        assert k.tolist() == [sum(int(v) << n for n, v in enumerate(bits[i * each : (i + 1) * each])) for i in range(media.TABLES)]


def sampled(p, yy, xx):
    y, x = np.clip(yy, 0, p.shape[0] - 1), np.clip(xx, 0, p.shape[1] - 1)
    a, b = np.floor(y).astype(int), np.floor(x).astype(int)
    c, d, u, v = np.minimum(a + 1, p.shape[0] - 1), np.minimum(b + 1, p.shape[1] - 1), y - a, x - b
    return p[a, b] * (1 - u) * (1 - v) + p[a, d] * (1 - u) * v + p[c, b] * u * (1 - v) + p[c, d] * u * v


def resized(p, f):
    h, w, third = int(p.shape[0] * f), int(p.shape[1] * f), (-1 / 3, 0, 1 / 3)
    grid = lambda dy, dx: np.meshgrid((np.arange(h) + 0.5 + dy) / f - 0.5, (np.arange(w) + 0.5 + dx) / f - 0.5, indexing="ij")
    return sum(sampled(p, *grid(dy, dx)) for dy in third for dx in third) / 9


def turned(p, degrees):
    a, m, k = np.deg2rad(degrees), (p.shape[0] - 1) / 2, (p.shape[1] - 1) / 2
    yy, xx = np.meshgrid(np.arange(p.shape[0]) - m, np.arange(p.shape[1]) - k, indexing="ij")
    return sampled(p, np.cos(a) * yy + np.sin(a) * xx + m, np.cos(a) * xx - np.sin(a) * yy + k)


def painted(p):
    q = p.copy()
    q[40:80, 40:80] = 60
    return q


EDITS = {
    "contrast": lambda p: p * 0.7 + 30,
    "painted": painted,
    "half size": lambda p: resized(p, 0.5),
    "size 0.7": lambda p: resized(p, 0.7),
    "size 0.85": lambda p: resized(p, 0.85),
    "quarter turn": lambda p: np.rot90(p).copy(),
    "turn by 5": lambda p: turned(p, 5),
    "turn by 15": lambda p: turned(p, 15),
    "turn by 40": lambda p: turned(p, 40),
    "crop to 0.7": lambda p: p[16:128, 16:128],
    "crop to half": lambda p: p[26:106, 26:106],
    "noise": lambda p: p + np.random.default_rng(1).normal(0, 8, p.shape),
}


def test_media_recall_on_edits():
    """Each edit of a picture is linked to it, and no other pictures are."""
    plain = []
    for seed in range(10):
        rng = np.random.default_rng(seed)
        p = np.full((160, 160), 128.0)
        for _ in range(60):
            (y, x), (h, w) = rng.integers(0, 160, 2), rng.integers(4, 53, 2)
            p[y : y + h, x : x + w] = rng.integers(0, 256)
        plain.append(p)
    every = [np.clip(np.rint(f(p)), 0, 255).astype(np.uint8) for f in (lambda p: p, *EDITS.values()) for p in plain]
    rows = np.array([[i, *c["keys"], *[c[n] for n in media.PLACE]] for i, d in enumerate(media.describe(every)) for c in d], np.int64)
    links = {pair for a, b in media.linked(rows, rows, media.VOTES) for pair in zip(a.tolist(), b.tolist())}
    assert all(a % 10 == b % 10 for a, b in links)
    for k, name in enumerate(EDITS):
        assert sum((i, 10 * (k + 1) + i) in links for i in range(10)) >= 9, name


@pytest.mark.parametrize("block", [8192, 7])
def test_media_links_of_all_pairs(spark, block):
    plain = [media.decode_pgm(r.image).copy() for r in media.drawn(spark.range(28), "id").orderBy("id").collect()]
    # Edited copies of one picture, its brightness only and its cut, among others that all bear one mark.
    plain += [(plain[0] * f + 10).astype(np.uint8) for f in (0.5, 0.6, 0.7, 0.9)]
    plain += [plain[0][: 64 - k, k:].copy() for k in (1, 3, 5)]
    mark = plain[3][20:44, 20:44]
    for p in plain[7:28]:
        p[20:44, 20:44] = mark
    want = collections.Counter(i for link in brute_links(plain) for i in link)
    rows = [(i, bytearray(media.encode_pgm(p))) for i, p in enumerate(plain)]
    got = media.find_copies(spark.createDataFrame(rows, "image_id long, image binary"), block=block)
    assert {r.image_id: r.n_links for r in got.collect()} == {i: want[i] for i in range(len(plain))}
    assert want[0] >= 8
    named = media.find_copies(spark.createDataFrame([(f"{i:03}", b) for i, b in rows], "image_id string, image binary"), block=block)
    assert {int(r.image_id): r.n_links for r in named.collect()} == {i: want[i] for i in range(len(plain))}


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = corpus_pipeline.stored(stage(spark, kept, sf), "test")
        if i < 4:
            assert made.columns == docs.columns
        before, after = kept.toPandas(), made.toPandas()
        if i == 0:
            labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
            bad, good = (set(labels[labels.quality == q].doc_id) for q in (0, 1))
            assert len(bad & set(after.doc_id)) < 0.1 * len(bad)
            assert len(good - set(after.doc_id)) < 0.02 * len(good)
        if i == 1:
            want = classes({d: shingle_set(t, 5) for d, t in zip(before.doc_id, before.text, strict=True)})
            assert set(after.doc_id) == set(want.values())
        if i == 2:
            assert len(after) == len(before)
            assert not after.text.str.contains(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+").any()
            assert (after.n_chars == after.text.str.len()).all()
        if i == 3:
            assert set(after.doc_id) <= set(before.doc_id)
            assert after.doc_id.value_counts().max() <= 2
        if i == 4:
            text = dict(zip(before.doc_id, before.text, strict=True))
            assert all(d == hashlib.sha256(text[k].encode()).hexdigest() for k, d in zip(after.doc_id, after.decoded_sha256, strict=True))
        kept = made
