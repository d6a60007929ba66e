"""Golden files for readers, writers and incremental runs."""

import glob
import gzip
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import answers, episodes
from corpusloom.sources import readers, writers
from corpusloom.streaming import incremental


def _put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


XML = """<?xml version="1.0" encoding="utf-8"?>
<posts>
  <row Id="1" PostTypeId="1" Score="83" Body="&lt;p&gt;Round &amp;amp; flat&lt;/p&gt;&#xA;" Tags="|a-b|satu|" LastActivityDate="2020" />
  <row Id="2" PostTypeId="1" Score="x" Tags="&lt;satu&gt;&lt;q&gt;" />
  <row Id="3" PostTypeId="1" Body="broken />
  <row Id="4" Score="1" Tags="|other|" />
</posts>
"""


def test_xml_rows_and_snapshots(spark, tmp_path):
    _put(tmp_path / "a" / "Posts.xml", XML)
    _put(tmp_path / "b" / "Posts.xml", XML.replace('Score="83"', 'Score="90"').replace("2020", "2021"))
    cols = ["Id", "PostTypeId", "Score", "Body", "Tags", "LastActivityDate"]
    df = readers.read_xml_rows(spark, f"{tmp_path}/*/Posts.xml", cols)
    got = sorted((r.Id, r.Score) for r in df.collect())
    assert got == [("1", "83"), ("1", "90"), ("2", "x"), ("2", "x"), ("4", "1"), ("4", "1")]
    one = df.where("Id = 1 AND Score = '83'").first()
    assert one.Body == "<p>Round &amp; flat</p>\n" and one.Tags == "|a-b|satu|"
    q = {r.Id: (r.Score, r.Tags) for r in answers.tagged_questions(df, "satu").collect()}
    assert q == {"1": ("90", ["a-b", "satu"]), "2": ("x", ["satu", "q"])}


def test_json_arrays_and_gzip(spark, tmp_path):
    _put(tmp_path / "x" / "1.json", json.dumps([{"title": "a", "wikitext": "t"}, {"title": "b"}], indent=2))
    _put(tmp_path / "x" / "2.json", "[]")
    _put(tmp_path / "y" / "3.json", json.dumps([{"title": "c", "wikitext": "u"}]))
    df = readers.read_json_arrays(spark, f"{tmp_path}/*/*.json", "title string, wikitext string")
    assert sorted((r.title, r.wikitext) for r in df.where("title IS NOT NULL").collect()) == [("a", "t"), ("b", None), ("c", "u")]
    with gzip.open(tmp_path / "z.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "z.jsonl.gz"), "a int", spread=3).agg(F.sum("a")).first()[0] == 3


SRT = """1
00:00:01,000 --> 00:00:02,500
<i>Hello</i> there,
friend

2
00:00:03,000 --> 00:00:04,000
{x} A &amp; B"""


def test_srt(spark, tmp_path):
    _put(tmp_path / "e 1.srt", SRT)
    _put(tmp_path / "e 2.srt", "﻿" + SRT.replace("\n", "\r\n"))
    rows = readers.read_srt(spark, f"{tmp_path}/*.srt").orderBy("path", "pos").collect()
    assert [r.content for r in rows] == ["Hello there, friend", "{x} A & B"] * 2
    assert rows[0].start == "00:00:01,000" and rows[0].end == "00:00:02,500"
    text = episodes.episode_text(readers.with_episode_number(readers.read_srt(spark, f"{tmp_path}/*.srt")), "episode_number", [F.col("pos")], "content")
    assert sorted(map(tuple, text.select("episode_number", "content").collect())) == [
        ("001", "Hello there, friend\n{x} A & B"), ("002", "Hello there, friend\n{x} A & B")]


ASS = """[Script Info]
Title: x
Dialogue: 9,not,yet

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
Comment: 0,0:00:00.00,0:00:01.00,Default,,0,0,0,,skip
Dialogue: 0,0:00:01.00,0:00:02.00,Default,Bob,0,0,0,,Well, hello,\\Nyou <b>there</b>
"""


def test_ass(spark, tmp_path):
    _put(tmp_path / "[S] Show - 042 [720p].ass", ASS)
    df = readers.read_ass(spark, f"{tmp_path}/*.ass")
    (r,) = readers.with_episode_number(df, r"Show - (\d{3}) \[\d{3}p\]\.ass").collect()
    assert r.Layer == "Dialogue: 0" and r.Name == "Bob" and r.Effect == ""
    assert r.Text == "Well, hello,\nyou there" and r.episode_number == "042"


@pytest.mark.parametrize("n,want", [(5, [2, 2, 1]), (2, [2]), (0, []), (4, [2, 2])])
def test_rotation(spark, tmp_path, n, want):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(n)], "k int, v string").repartition(3)
    out = str(tmp_path / f"r{n}")
    writers.write_rotating_json(df, out, ["k"], 2)
    files = sorted(glob.glob(f"{out}/file_idx=*/*.txt"))
    got = [json.loads(open(f, encoding="utf-8").read()) for f in files]
    assert [len(g) for g in got] == want
    assert [x["k"] for g in got for x in g] == list(range(n))
    writers.write_rotating(df, str(tmp_path / f"plain{n}"), 2)
    if n:
        assert spark.read.json(str(tmp_path / f"plain{n}")).count() == n


def test_upsert_replaces_and_repeats(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "id string, v int")
    writers.upsert_parquet(frame([(f"k{i}", 0) for i in range(30)]), path, "id", [F.desc("v")], 4)
    change = frame([("k3", 5), ("k3", 7), ("new", 1)])
    for _ in range(2):
        writers.upsert_parquet(change, path, "id", [F.desc("v")], 4)
    got = {r.id: r.v for r in spark.read.parquet(path).collect()}
    assert len(got) == 31 == spark.read.parquet(path).count()
    assert got["k3"] == 7 and got["new"] == 1 and got["k4"] == 0


def test_splits(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    writers.write_splits({"wiki": a, "analyze": a.drop("s")}, str(tmp_path / "d"))
    got = readers.read_split(spark, str(tmp_path / "d"), "analyze")
    assert [(r.i, r.s) for r in got.collect()] == [(1, None)]
    assert "PartitionFilters: [isnotnull(split" in got._jdf.queryExecution().executedPlan().toString()


def test_lookup_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string")
    assert {r.k: r.v for r in readers.as_lookup(df, "k", [F.desc("n")]).collect()} == {"a": "y", "b": "z"}


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "link string, v int"
    work = lambda s: incremental.dedup_stream(s, "link")
    _put(tmp_path / "src" / "1.json", '{"link": "a", "v": 1}\n{"link": "b", "v": 1}\n{"link": "a", "v": 2}\n')
    incremental.ingest_stream(spark, src, schema, out, ck, work).awaitTermination()
    incremental.ingest_stream(spark, src, schema, out, ck, work).awaitTermination()
    _put(tmp_path / "src" / "2.json", '{"link": "b", "v": 3}\n{"link": "c", "v": 3}\n')
    incremental.ingest_stream(spark, src, schema, out, ck, work).awaitTermination()
    assert sorted(r.link for r in spark.read.schema(schema).parquet(out).collect()) == ["a", "b", "c"]


def test_append_new_replay_is_harmless(spark, tmp_path):
    out = str(tmp_path / "o")
    run = incremental.append_new(out, "k", [F.col("v")])
    f = lambda rows: spark.createDataFrame(rows, "k string, v int")
    run(f([("a", 1), ("b", 1)]), 0)
    for _ in range(2):
        run(f([("b", 2), ("c", 2), ("c", 1)]), 1)
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 1), ("c", 1)]


def test_resume_runs_nothing_twice(spark, tmp_path):
    out = str(tmp_path / "o")
    todo = spark.range(10).withColumnRenamed("id", "k")
    work = lambda d: d.withColumn("v", F.col("k") * 2)
    assert incremental.resume_batch(spark, todo.where("k < 4"), out, "k", work) == 4
    assert incremental.resume_batch(spark, todo, out, "k", work) == 6
    assert incremental.resume_batch(spark, todo, out, "k", work) == 0
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == list(range(10))


def test_denorm_job(spark, tmp_path):
    from corpusloom.plans.denorm import denorm_job

    posts = spark.createDataFrame([("a", "t", "s1"), ("b", "[removed]", "s1"), ("c", "u", "s2")], "id string, selftext string, subreddit string")
    comments = spark.createDataFrame([("1", "t3_a", "hi", 1, 5, 0), ("2", "t3_a", "yo", 1, 5, 0), ("3", "t3_a", "no", 1, 2, 0)],
                                     "id string, parent_id string, body string, ups long, score long, downs long")
    posts.write.parquet(str(tmp_path / "p"))
    comments.write.parquet(str(tmp_path / "c"))
    denorm_job(spark, str(tmp_path / "c"), str(tmp_path / "p"), str(tmp_path / "o"))
    got = {r.post_id: r.comments for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got["t3_c"] is None and [c["rank"] for c in got["t3_a"]] == [1, 1, 3]
    assert sorted(glob.glob(str(tmp_path / "o" / "subreddit=*")))[0].endswith("subreddit=s1")


@pytest.mark.parametrize("n, want", [(5, [2, 2, 1]), (2, [2]), (0, [])])
def test_rotation_with_flat_names(spark, tmp_path, n, want):
    """file_0.json, file_1.json, ... each one JSON array of at most two records."""
    import json

    df = spark.createDataFrame([(chr(97 + i), i + 1) for i in range(n)], "k string, v int")
    out = tmp_path / "flat"
    writers.write_rotating_json(df, str(out), ["k"], 2, flat=True)
    files = sorted(p for p in out.glob("*.json") if not p.name.startswith("."))
    assert [p.name for p in files] == [f"file_{i}.json" for i in range(len(want))]
    assert [len(json.loads(p.read_text())) for p in files] == want


def test_upsert_keeps_the_first_by_order(spark, tmp_path):
    path = str(tmp_path / "table")
    at = lambda rows: writers.upsert_parquet(spark.createDataFrame(rows, "k int, v int"), path, "k", [F.desc("v")], 4)
    at([(1, 10), (2, 1)])
    at([(1, 5), (3, 7), (2, 9)])
    at([(1, 5), (3, 7), (2, 9)])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, 10), (2, 9), (3, 7)]
    with pytest.raises(ValueError):
        writers.upsert_parquet(spark.createDataFrame([(1, 1)], "k int, v int"), path, "k", [F.desc("v")], 8)


def _files(root):
    return {p: p.stat().st_size for p in root.rglob("*.parquet")}


def test_files_have_the_size_asked_for(spark, tmp_path):
    """Ten small values and one with most rows: files of the asked size, whatever the number of tasks."""
    rows = spark.range(120_000).select(
        "id", F.sha2(F.col("id").cast("string"), 512).alias("t"), F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.concat(F.lit("v"), (F.col("id") % 100).cast("string"))).alias("by"),
    ).repartition(3)
    target = 1 << 20
    writers.write_partitioned(rows, str(tmp_path / "t"), "by", target)
    sizes = _files(tmp_path / "t")
    hot = [n for p, n in sizes.items() if p.parent.name == "by=hot"]
    assert len(hot) >= 5 and all(target / 2 <= n <= 2 * target for n in sorted(hot)[1:])
    # Small values share tasks; one that is shuffled together with the hot value lies in some of its tasks.
    assert len(sizes) - len(hot) <= 4 * 20
    assert spark.read.parquet(str(tmp_path / "t")).count() == 120_000
    assert "REBALANCE" in rows.hint("rebalance", "by")._jdf.queryExecution().executedPlan().toString()


def test_folders_of_a_keyed_table_follow_its_first_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "BUCKET_ROWS", 100)
    path = str(tmp_path / "t")
    writers.upsert_parquet(spark.range(2500).withColumn("v", F.lit(1)), path, "id", [F.desc("v")])
    assert spark.read.json(f"{path}/_layout").first().buckets == 25
    writers.upsert_parquet(spark.range(2000, 9000).withColumn("v", F.lit(2)), path, "id", [F.desc("v")])
    got = spark.read.parquet(path)
    assert got.count() == 9000 and got.where("v = 2").count() == 7000 and got.select("bucket").distinct().count() == 25
    with pytest.raises(ValueError, match="has 25 buckets"):
        writers.upsert_parquet(spark.range(3).withColumn("v", F.lit(2)), path, "id", [F.desc("v")], 8)
