import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans import wider
from tidemark.sources import readers, writers


def test_json_round_trip(spark, tmp_path):
    rows = [{"id": 1, "number": 7, "merged": True, "merged_by_data": {"id": 5}, "comments_data": []}, {"id": 2, "merged": False, "closed_by": {"id": 6}, "user_data": {"login": "x"}}]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "own--repo--with-issue-data.json").write_text(json.dumps(rows, indent=1))
    df = readers.drop_empty(readers.json_arrays(spark, str(tmp_path / "raw")))
    got = df.select("id", readers.repository(F.col("__source_path")).alias("repo"), readers.integrator()["id"].alias("by"), "comments_data").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "own/repo", 5, None), (2, "own/repo", 6, None)]
    writers.json_lines(df, str(tmp_path / "lines"))
    assert readers.json_lines(spark, str(tmp_path / "lines")).count() == 2


def test_bad_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}\n{bad\n')
    assert readers.json_lines(spark, str(tmp_path / "a.json"), strict=False).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_lines(spark, str(tmp_path / "a.json")).collect()


def test_lists_and_csv(spark, tmp_path):
    (tmp_path / "names").write_text(" A/b \n\na/B\nA/b\n")
    assert {r.name for r in readers.name_list(spark, str(tmp_path / "names")).collect()} == {"A/b", "a/B"}
    assert readers.name_list(spark, str(tmp_path / "names"), lower=True).count() == 1
    (tmp_path / "bots").write_text("Bot One <b@x.org>;3\nBot One <b@x.org>;4\nplain;1\n")
    assert [tuple(r) for r in readers.bot_list(spark, str(tmp_path / "bots")).collect()] == [("Bot One", "b@x.org")]
    (tmp_path / "r.csv").write_text('a,b\n"x, ""y""",1\n')
    assert tuple(readers.registry_csv(spark, str(tmp_path / "r.csv"), "a string, b int").first()) == ('x, "y"', 1)


def test_writers(spark, tmp_path):
    df = spark.range(20).select("id", (20 - F.col("id")).alias("t"), F.when(F.col("id") < 4, "npm").when(F.col("id") < 6, "pip").alias("platform"), F.struct(F.lit(1).alias("x")).alias("s"), F.array(F.lit(2)).alias("l"))
    writers.split_by(df, str(tmp_path / "split"), "platform", ["npm"])
    assert sorted(p.name for p in (tmp_path / "split").iterdir() if p.is_dir()) == ["platform=npm", "platform=unknown"]
    writers.chronological(df, str(tmp_path / "time"), "t", "id")
    assert spark.read.parquet(str(tmp_path / "time")).count() == 20
    writers.csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id", "t", "platform", "s_x", "l_0"]
    with pytest.raises(ValueError, match="longer"):
        writers.csv(df, str(tmp_path / "csv"), {"l": 0})


def test_places_come_from_files(spark, tmp_path):
    df = spark.range(200).select("id", (F.col("id") % 50).alias("t"))
    path = str(tmp_path / "ordered")
    writers.chronological(df, path, "t", "id")
    rows = readers.placed(spark, path, "t").orderBy("__place").collect()
    assert [r["__place"] for r in rows] == list(range(200)) and [(r.t, r.id) for r in rows] == sorted((i % 50, i) for i in range(200))
    df.repartition(3).write.parquet(str(tmp_path / "mixed"))
    with pytest.raises(ValueError, match="in order"):
        readers.placed(spark, str(tmp_path / "mixed"), "t")


def test_quarantine_lists_and_reads_files_once(spark):
    """A file for each repository and thousand of keys, in a folder for each repository and in none of its own, and one read for what is good and what is not."""
    got = wider.json_quarantine(spark, "/root/testdata/sf0.01")
    files = got.inputFiles()
    keys = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select(F.col("o_orderkey") % 5, F.floor(F.col("o_orderkey") / 1000))
    assert len(files) == keys.distinct().count() and {f.split("/")[-2] for f in files} == {f"from=own{r}--repo" for r in range(5)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_told_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": "x"}, null, {"id": 2, "__source_path": "other"}]')
    (tmp_path / "b.json").write_text('[{"id": 3}')
    told = readers.told_arrays(spark, str(tmp_path), "id bigint, __source_path string")
    got = told.where("what = 'good'").select("record.*", "place").union(told.where("what <> 'good'").select(F.lit(None), "what", "place")).collect()
    assert sorted((r[0] or 0, r[1][-6:], -1 if r[2] is None else r[2]) for r in got) == [(0, "file", -1), (0, "record", 1), (0, "record", 2), (1, "a.json", 0), (2, "other", 3)]


def test_damaged_records_and_files(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.json").write_text('[{"id": 1}, {"id": "x"}, 7, null, {"id": 2, "title": "t"}]')
    (folder / "b.json").write_text('[{"id": 3}')
    (folder / "c.json").write_text("[]")
    good, rejects = readers.quarantined_arrays(spark, str(folder), "id bigint, title string, __source_path string")
    assert sorted((r.id, r["__source_path"][-6:]) for r in good.collect()) == [(1, "a.json"), (2, "a.json")]
    assert sorted((r.file[-6:], r.what, -1 if r.place is None else r.place) for r in rejects.collect()) == [("a.json", "record", 1), ("a.json", "record", 2), ("a.json", "record", 3), ("b.json", "file", -1)]
    (tmp_path / "lines").write_text('{"id": 1}\n\n{bad\n{"id": 2}\n')
    good, rejects = readers.quarantined_lines(spark, str(tmp_path / "lines"), "id bigint")
    assert sorted(r.id for r in good.collect()) == [1, 2] and [r.text for r in rejects.collect()] == ["{bad"]
