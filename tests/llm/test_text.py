"""Language, personal data, fingerprints, chat and tokens: brute force, round trips and held-out accuracy."""

import hashlib
import json
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, language, order_minhash, pii

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SMALL}/documents.parquet")


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string, spans string, score double, `_bins` string")


def odd_rows(spark):
    """Nulls, empty and blank texts, repeated rows, a long text, columns whose names clash."""
    texts = [None, "", " \n", "a", "same text here", "same text here", "word " * 30_000, "中文字符", "x" * 50_000, "1" * 40_000]
    return table(spark, [(i, t, None, "c", "c", 0.5, "c") for i, t in enumerate(texts)])


def test_language_held_out(spark, docs):
    got = language.op1_language(spark, SMALL).toPandas().merge(docs, on="doc_id")
    held = got[got.held_out]
    assert len(got) == len(docs)
    assert len(held) > 10
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = odd_rows(spark)
    assert {r.lang_pred for r in language.predict(rows, language.train(rows)).collect()} == {"und"}
    taught = table(spark, [(1, "der die das und", "de", "", "", 0.0, ""), (2, "the and of to", "en", "", "", 0.0, ""), (3, None, "fr", "", "", 0.0, ""), (4, "12 34", "es", "", "", 0.0, "")])
    profiles = language.train(taught)
    assert {r.lang for r in profiles.collect()} == {"de", "en"}
    got = {r.doc_id: r for r in language.predict(rows, profiles).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 9)] == ["und"] * 4
    assert got[3].lang_pred in {"de", "en"}
    assert language.predict(rows.limit(0), profiles).count() == 0
    assert set(rows.columns) <= set(language.predict(rows, profiles).columns)


def grams(text, most):
    """The most frequent n-grams of a text or texts, ties by code points."""
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split()
    count: dict = {}
    for w in words:
        padded = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                if (g := padded[i : i + n]) != " ":
                    count[g] = count.get(g, 0) + 1
    order = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return sorted(count, key=lambda g: (-count[g], order(g)))[:most]


def test_language_distances_by_brute_force(spark, docs):
    rows = docs[["doc_id", "text", "lang"]]
    df = spark.createDataFrame(rows)
    got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.predict(df, language.train(df, profile=60), profile=60).collect()}
    profiles = {k: grams(" ".join(t for t in g.text if t), 60) for k, g in rows.groupby("lang")}
    for i, t in zip(rows.doc_id, rows.text, strict=True):
        own = grams(t or "", 60)
        if not own:
            assert got[i] == ("und", 0.0)
            continue
        far = {k: sum(abs(p.index(g) - n) if g in p else 60 for n, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert got[i] == (best, round(1 - far[best] / (60 * len(own)), 9)), i


def test_language_in_blocks_of_profiles(spark, docs, monkeypatch):
    rows = spark.createDataFrame(docs[["doc_id", "text", "lang"]])
    profiles = language.train(rows).persist()
    whole = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(rows, profiles).collect()}
    monkeypatch.setattr(language, "LANGUAGES", 1)
    assert {r.doc_id: (r.lang_pred, r.score) for r in language.predict(rows, profiles).collect()} == whole


def base_spans(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        total = sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii_by_brute_force(spark):
    rng = random.Random(2)
    bits = ["a", "b@c.de", "@", "x.y", "1", "12", "4111 1111 1111 1111", "5500000000000004", " ", "-", "+", "1.2.3.4", ".", "(", ")", "😀", "é", "+49 (0)30 123456", "255", "256", "_", "\n", "%", "0"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(1500)]
    texts += ["1" * 30_000, "1 " * 30_000, "a." * 30_000, "a@b" + ".c" * 30_000, "+1" + "(" * 30_000, "x" * 100_000 + "@b.c", " a@b.c" * 500, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find(df).select("doc_id", pii.listed(F.col("spans"), pii.BASE).alias("s")).collect()}
    assert [i for i, t in enumerate(texts) if got[i] != base_spans(t)] == []


def test_pii_added_kinds_and_mask(spark):
    df = spark.createDataFrame([(1, "iban DE89 3704 0044 0532 0130 00, mail a@b.org"), (2, "DE88 3704 0044 0532 0130 00"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.mask(pii.find(df)).collect()}
    assert got[1].text == "iban [IBAN], mail [EMAIL]"
    assert all(0 <= s.score <= 1 for s in got[1].spans)
    assert got[2].text == "DE88 3704 0044 0532 0130 00"
    assert got[3].text is None
    assert got[3].spans == []
    assert pii.find(odd_rows(spark)).where(F.size("spans") > 0).count() == 0


def test_pii_query(spark, docs):
    got = pii.op5_pii(spark, SMALL).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        assert got.base_sha256[i] == hashlib.sha256(base_spans(t or "").encode()).hexdigest()


def test_order_minhash_query(spark, docs):
    got = order_minhash.op6_order_minhash(spark, SMALL).toPandas().set_index("doc_id")
    rows = docs.sort_values("doc_id", ascending=False).reset_index(drop=True)
    for i, r in rows.iterrows():
        third = len(r.text) // 3
        edited = r.text[: len(r.text) - third] + rows.text[(i + 1) % len(rows)][:third]
        assert got.edited_sha256[r.doc_id] == hashlib.sha256(edited.encode()).hexdigest()
        assert got.n_chars[r.doc_id] == len(r.text)
    assert got.near_edited.between(0, 1).all()
    assert got.near_edited.mean() > 10 * got.near_next.mean()
    prints = pd.DataFrame({"t": docs.set_index("doc_id").text, "f": got.fingerprint})
    assert (prints.groupby("t").f.nunique() == 1).all()


def test_order_minhash_notices_order_and_repeats(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words[150:] + words[:150]), " ".join(words[:290] + ["new"] * 10), " ".join(["a", "b"] * 50), " ".join(["a", "b"] * 60)]
    sig = spark.createDataFrame([(t,) for t in texts], "text string").select(order_minhash.signature(F.col("text")).alias("s")).collect()
    df = spark.createDataFrame([(sig[0].s, sig[i].s) for i in range(5)] + [(sig[3].s, sig[4].s)], "a array<bigint>, b array<bigint>")
    same, moved, edited, _, _, repeated = [r.x for r in df.select(order_minhash.likeness(F.col("a"), F.col("b")).alias("x")).collect()]
    assert same == 1
    assert moved < 0.65 < edited < 1  # 32 tuples: about one half and six sevenths are expected
    assert repeated < 1


def plain_signature(spark, text):
    """The signature by its definition, with Spark's hash of each k-mer and of each tuple."""
    tokens = re.findall(order_minhash.TOKEN, text)
    if not tokens:
        return []
    hashed = lambda rows, schema, *cols: [r.h for r in spark.createDataFrame(rows, schema).select(F.xxhash64(*cols).alias("h")).collect()]
    bits, mask = order_minhash._PLACE_BITS, (1 << 64) - 1
    kmers = [h >> bits for h in hashed([(t, u) for t, u in zip(tokens, [*tokens[1:], None], strict=True)], "t string, u string", "t", "u")]
    seen: dict = {}
    chosen = []
    for place, k in enumerate(kmers):
        n = seen[k] = seen.get(k, -1) + 1
        if n:  # occurrences count from one with the first repeat, whose number is 0
            (h,) = hashed([(k, n - 1)], "k long, n int", "k", "n")
            chosen.append((h >> bits, place))
        else:
            chosen.append((k, place))
    out = []
    for b in range(order_minhash.BUCKETS):
        own = sorted(c for c in chosen if (c[0] & (mask >> bits)) >> (64 - bits - order_minhash.BUCKET_BITS) == b)
        own.sort(key=lambda c: (c[0], c[1]))
        pair = [h for h, _ in sorted(own[: order_minhash.LENGTH], key=lambda c: c[1])]
        if pair:
            names = [f"h{i}" for i in range(len(pair))]
            (h,) = hashed([tuple(pair)], ", ".join(f"{n} long" for n in names), *names)
            out.append((b << (64 - order_minhash.BUCKET_BITS)) | ((h & mask) >> order_minhash.BUCKET_BITS))
    return out


def test_signature_by_its_definition(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["ab", "ba", "c", "d e", "é", "中文"]) for _ in range(rng.randrange(1, 25))) for _ in range(12)] + ["", "one"]
    got = [[x & ((1 << 64) - 1) for x in r.s] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", order_minhash.signature(F.col("t")).alias("s")).orderBy("i").collect()]
    assert [sorted(x) for x in got] == [sorted(plain_signature(spark, t)) for t in texts]


def test_next_rows(spark):
    rng = random.Random(3)
    rows = [(k, f"t{i}", "r", "c", "n") for i, k in enumerate(rng.sample(range(10_000), 400))] + [(None, "last", "r", "c", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, range string, copy string, next_text string")
    made = order_minhash.with_next(df, "doc_id", ["text"])
    assert made.columns == ["doc_id", "text", "range", "copy", "next_text"]
    got = made.collect()
    ordered = [t for _, t, *_ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)]
    assert {r.text: r.next_text for r in got} == dict(zip(ordered, [*ordered[1:], ordered[0]], strict=True))
    assert {(r.range, r.copy) for r in got} == {("r", "c")}
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (1, "c")], "doc_id long, text string")
    got = order_minhash.with_next(twice, "doc_id", ["text"]).collect()
    assert sorted(r.text for r in got) == ["a", "a", "b", "c"]
    assert sorted(r.next_text for r in got) == ["a", "a", "b", "c"]


def test_order_minhash_edges(spark):
    got = {r.doc_id: r for r in order_minhash.fingerprint(odd_rows(spark)).collect()}
    assert got[0].signature == got[1].signature == got[2].signature == []
    assert got[4].signature == got[5].signature != []
    assert order_minhash.with_next(odd_rows(spark).limit(0), "doc_id", ["text"]).count() == 0
    one = order_minhash.with_next(odd_rows(spark).where("doc_id = 3"), "doc_id", ["text"]).collect()
    assert [r.next_text for r in one] == ["a"]


def test_chat_round_trip(spark):
    rng = random.Random(3)
    bits = ["\\", "<|", "|>", "<|im_end|>\n", "<|im_start|>", "n", "\n", "a", "é", "<\\|", "\\\\", "|", "<"]
    say = lambda k: "".join(rng.choice(bits) for _ in range(rng.randrange(k)))
    rows = [(c, t, rng.choice(["user", "assistant", say(6), None]), rng.choice([say(12), None])) for c in range(200) for t in range(rng.randrange(1, 6))]
    rows += [(1000, t, "user", "x") for t in range(2000)]
    want: dict = {}
    for c, _, r, s in rows:
        want.setdefault(c, []).append((r or "", s or ""))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    written = chat.render(chat.canonical(df)).drop("turns")
    assert written.where(F.contains("formatted", F.lit("<|im_end|><|"))).count() == 0
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in chat.parse(written).collect()} == want
    assert chat.canonical(df.limit(0)).count() == 0


def test_chat_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}], "id": 3}, "messages", [("user", "hi"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "conversations", [("user", "a"), ("assistant", "b")]),
        ({"instruction": "i", "input": "x", "output": "o"}, "instruction with input", [("user", "i\n\nx"), ("assistant", "o")]),
        ({"prompt": "p", "completion": "c"}, "prompt and completion", [("user", "p"), ("assistant", "c")]),
        ({"question": "q", "answer": "a", "system": "s"}, "question with system", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ({"other": 1}, None, None),
        # any element may have the fields, and an empty list has no turns
        ({"messages": [{"tool_call": 1}, {"role": "user", "content": "hi"}]}, "messages", [("", ""), ("user", "hi")]),
        ({"messages": []}, "messages", []),
        ({"messages": "text"}, None, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(r[0]), "c", "d", "e") for i, r in enumerate(records)] + [(98, "{bad", "c", "d", "e"), (99, None, "c", "d", "e")], "i int, record string, _v string, _print string, _told string")
    made = chat.turns_of_json(df, "record")
    assert made.columns == [*df.columns, "layout", "turns"]
    got = {r.i: r for r in made.collect()}
    assert {(r._v, r._print, r._told) for r in got.values()} == {("c", "d", "e")}
    for i, (_, layout, turns) in enumerate(records):
        assert got[i].layout == layout
        assert (got[i].turns and [tuple(t) for t in got[i].turns]) == turns
    assert got[98].turns is got[99].turns is None
    odd = spark.createDataFrame([(None, 0, "user", "a"), (1, None, "user", "b"), (1, 2, "user", "z"), (1, 2, "user", "y"), (1, 2, None, None), (None, 1, "user", "c")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in chat.canonical(odd).collect()} == {None: [("user", "a"), ("user", "c")], 1: [("user", "b"), ("", ""), ("user", "y"), ("user", "z")]}
    typed = spark.createDataFrame([("p", "r", 1)], "prompt string, response string, turns int")
    assert [tuple(t) for t in chat.canonical(typed).first().turns] == [("user", "p"), ("assistant", "r")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical(spark.range(1))


def test_chat_query(spark):
    rows = pd.read_parquet(f"{SMALL}/conversations.parquet").sort_values(["conv_id", "turn"])
    got = chat.op9_chat(spark, SMALL).toPandas().set_index("conv_id")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, g in rows.groupby("conv_id"):
        said = [t or "" for t in g.text]
        own = "".join(t for r, t in zip(g.role, said, strict=True) if r == "assistant")
        assert got.turns_sha256[c] == digest("".join(f"{r}\n{t}\n" for r, t in zip(g.role, said, strict=True)))
        assert (got.loss_chars[c], got.loss_sha256[c]) == (len(own), digest(own))
    assert got.loss_chars[-1] == len("<|im_end|><|im_start|>assistant ok")


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_path()
    lib = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(1)
    bits = ["a", "A", " ", "  ", "\n", "\t", "é", "<|endoftext|>", "<|endo", "'s", "'LL", "1", "½", "中", "😀", "\x1c", "\x85", "\xa0", "!", "aaaa", "aaa", "﻿", "̀", "_", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["a" * 1001, " " * 333, "ab" * 500, "x" * 20_000]
    ids, counts = bpe.Encoder(bpe.load_vocabulary(path)).encode(texts)
    at = 0
    for t, n, told in zip(texts, counts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[at : at + n].tolist() == told.ids, t
        at += n


def test_bpe_round_trip_and_edges(spark):
    path = bpe.default_path()
    got = bpe.decode(bpe.encode(odd_rows(spark), path, ids="ids"), path).collect()
    assert [r.decoded for r in got] == [r.text or "" for r in got]
    assert [len(r.ids) for r in got[:2]] == [0, 0]
    broken = spark.createDataFrame([([50256, -1, 99_999, 447],), (None,)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(broken, path).collect()] == ["<|endoftext|>�", ""]
    assert bpe.encode(odd_rows(spark).limit(0), path).count() == 0


def test_bpe_query(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.default_path())
    got = bpe.op8_bpe(spark, SMALL).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got.ids_sha256[i] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
