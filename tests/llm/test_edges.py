"""Clashing column names, nulls, repeated rows and empty tables, through every operator and pipeline stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, chat, language, media, minhash, mixing, order_minhash, pii, quality, repeats

#: Names that operators use, or once used, for columns of their own.
CLASHES = ["_range", "_host", "_path", "_v", "_print", "_bins", "_next", "_key", "_hash", "k", "mark", "hits", "host", "path", "bins", "copy", "tie", "first", "goes", "spans_", "times", "key", "anchor", "bands", "d1", "id", "_sha", "corners", "_told"]
#: Two rows of one key and text, two of one key, null keys and texts.
ROWS = [(1, "one two three four five six seven eight " * 12, "a", "en"), (2, None, None, None), (3, "", "a", None), (3, "", "a", None), (4, "other words of some length that stand here and there alone", "b", "en"), (4, "a text of the same key, mail x@y.org", None, "de"), (None, "null key with words in a text that is not short at all", "b", "en"), (5, "one two three four five six seven eight " * 12, "b", "en")]


@pytest.fixture(scope="module")
def frame(spark):
    rows = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, source string, lang string, n_chars long")
    return rows.withColumns({c: F.concat(F.lit(f"{c}="), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES})


def kept(made, frame):
    """The rows of the caller's own columns, which no operator may change."""
    names = ["doc_id", *CLASHES]
    order = lambda df: sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    return order(made) == order(frame)


def test_operators_keep_columns(spark, frame):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    path = bpe.default_path()
    model = quality.fit(frame, labels)
    made = [
        language.predict(frame, language.train(frame)),
        quality.score(frame, model),
        pii.mask(pii.find(frame)),
        order_minhash.fingerprint(frame),
        order_minhash.with_next(frame, "doc_id", ["text"]),
        bpe.decode(bpe.encode(frame, path), path),
    ]
    for df in made:
        assert set(frame.columns) <= set(df.columns)
        assert kept(df, frame)
    told = chat.turns_of_json(frame.withColumn("record", F.lit('{"prompt": "p", "response": "r"}')), "record")
    assert kept(told, frame)
    assert {r.layout for r in told.select("layout").collect()} == {"prompt and response"}
    assert quality.fitted(model).count() == frame.count()


def test_operators_of_sets(frame):
    near = minhash.near_duplicates(frame, width=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in near if r.doc_id in (1, 5)) == [(1, 1), (5, 1)]
    assert len(near) == len(ROWS)
    gone = repeats.remove(frame, length=60, gram=16).collect()
    assert sorted((r.doc_id, sum(s.b - s.a for s in r.removed)) for r in gone if r.doc_id in (1, 5)) == [(1, 480), (5, 480)]
    assert len(gone) == len(ROWS)
    sized = frame.withColumn("sources", F.array("source")).withColumn("size", F.length("text").cast("long"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    taken = mixing.mix(sized, mixing.fill_targets(sums, [3, 1, 2], 1.5, 2)).collect()
    assert len(taken) == len(ROWS)
    assert all(0 <= r.taken <= 2 * r.size for r in taken)
    pictures = frame.select("doc_id", *CLASHES).withColumn("image", F.lit(b"no picture"))
    found = media.find_copies(pictures, "doc_id").collect()
    assert len(found) == len(ROWS)
    assert all(r.n_links == 0 for r in found)


def test_empty_tables(spark, frame):
    none = frame.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fitted(quality.fit(none, labels)).count() == 0
    assert language.predict(none, language.train(none)).count() == 0
    assert pii.mask(pii.find(none)).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert mixing.mix(none.select("doc_id", F.array("source").alias("sources"), F.lit(1).alias("size")), spark.createDataFrame([], "source string, target double")).count() == 0
    assert media.find_copies(spark.createDataFrame([], "image_id long, image binary")).count() == 0
    assert chat.turns_of_json(none, "text").count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, frame, tmp_path, empty):
    rows = frame.limit(0) if empty else frame
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = rows
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "edges")
        if i < 4:
            assert made.columns == rows.columns
            bad = made.select("doc_id", *CLASHES).where(" or ".join(f"not (`{c}` <=> concat('{c}=', coalesce(cast(doc_id as string), 'none')))" for c in CLASHES))
            assert bad.count() == 0
        docs = made
    if empty:
        assert docs.count() == 0


def test_pipeline_keeps_null_keys(spark, frame):
    near = corpus_pipeline.near_duplicate_stage(spark, frame, "")
    assert {r.doc_id for r in near.collect()} == {1, 2, 3, 4, None}
    mixed = corpus_pipeline.mixing_stage(spark, near, "")
    assert None in {r.doc_id for r in mixed.collect()}
    masked = corpus_pipeline.pii_stage(spark, frame, "").where("doc_id = 4").collect()
    assert {r.text for r in masked} >= {"a text of the same key, mail [EMAIL]"}
    assert all(r.n_chars == len(r.text) for r in masked)


def test_keys_of_any_type(spark):
    """String, date and struct keys where an order of keys is all that is needed."""
    words = "one two three four five six seven eight nine ten "
    rows = [("b", words * 3 + "eleven"), ("a", words * 3 + "twelve"), ("c", "quite another text of several words that stands alone"), (None, None), ("d", words * 3 + "thirteen")]
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    for key in (F.col("doc_id"), F.struct("doc_id"), F.to_date(F.concat(F.lit("2024-01-"), F.lpad((F.ascii("doc_id") - 90).cast("string"), 2, "0")))):
        typed = frame.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), key))
        names = {r.text: r.doc_id for r in typed.collect()}
        classes = {r.doc_id: r.component_id for r in minhash.near_duplicates(typed, width=2).collect()}
        same = [names[words * 3 + x] for x in ("eleven", "twelve", "thirteen")]
        assert {classes[k] for k in same} == {names[words * 3 + "twelve"]}
        assert classes[names[rows[2][1]]] == names[rows[2][1]]
        if typed.schema["doc_id"].dataType.typeName() != "struct":
            after = {r.text: r.next_text for r in order_minhash.with_next(typed, "doc_id", ["text"], parts=3).collect()}
            down = [t for _, t in sorted(rows[:3] + rows[4:], reverse=True)] + [None]
            assert [after[t] for t in down] == [*down[1:], down[0]]


def test_null_keys_with_equal_hashes(spark):
    """Two texts of one 32-bit hash and no key: each keeps its own bytes."""
    passage = "".join(f"{i:03}-" for i in range(113))[:450]
    first = spark.range(200_000).select(F.concat(F.lit(passage), F.lpad(F.md5(F.col("id").cast("string")), 41, "x")).alias("t"))
    second = spark.range(200_000).select(F.concat(F.repeat(F.sha2((-F.col("id")).cast("string"), 256), 1), F.lit(" stands alone "), F.sha2(F.col("id").cast("string"), 512)).alias("u"))
    pair = first.withColumn("h", F.hash("t")).join(second.withColumn("h", F.hash("u")), "h").first()
    assert pair is not None
    frame = spark.createDataFrame([(None, pair.t), (None, pair.u), (5, "." + passage + "!")], "doc_id long, text string")
    got = {r.n_bytes: r for r in repeats.remove(frame).collect()}
    assert sum(s.b - s.a for s in got[491].removed) == 450 and bytes(got[491].kept).decode() == pair.t[450:]
    assert not got[len(pair.u)].removed and bytes(got[len(pair.u)].kept).decode() == pair.u
    assert bytes(got[452].kept) == b".!"


def test_nothing_and_very_long_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert order_minhash.with_next(none, "doc_id", ["text"]).count() == 0
    path = bpe.default_path()
    assert bpe.decode(bpe.encode(none, path), path).count() == 0
    assert repeats.remove(none).count() == 0
    long = "word " * 400_000
    sized = spark.createDataFrame([(1, long), (2, "a b")], "doc_id long, text string").withColumn("size", mixing.word_count(F.col("text"))).withColumn("sources", F.array(F.lit("s")))
    sums = sized.groupBy(F.lit("s").alias("source")).agg(F.sum("size").alias("source_size"))
    taken = {r.doc_id: r.taken for r in mixing.mix(sized, mixing.fill_targets(sums, [3, 1, 2], 1.5, 2)).collect()}
    assert abs(sum(taken.values()) - 1.5 * 400_002) <= 2
    turns = spark.createDataFrame([(None, 0, "user", long), (None, 0, "user", long), (7, None, "assistant", None), (7, None, "assistant", "<|im_end|>")], "conv_id long, turn long, role string, text string")
    back = chat.parse(chat.render(chat.canonical(turns)).select("conv_id", "formatted"))
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in back.collect()} == {None: [("user", long)] * 2, 7: [("assistant", ""), ("assistant", "<|im_end|>")]}
