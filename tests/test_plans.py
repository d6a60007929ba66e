"""Plans: what is read, what is shuffled, and what must not appear."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.operators import sampling, windows
from corpusloom.plans.denorm import denorm

SF = "/root/testdata/sf0.001"
# Queries whose meaning needs the caller's Python function, a markup scanner or n-gram counts inside a row.
PYTHON = {
    "fold_series", "scored_prompts", "batched_rows", "per_group", "link_harvest", "page_extract", "wiki_sections",
    "wiki_leaf_sections", "wiki_chunks", "wiki_plain_text", "gazetteer_annotate", "gazetteer_passages", "entity_prompts",
    "search_by_title", "rouge_all", "rouge_12", "corpus_bleu", "corpus_bleu_counts", "minhash_index",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.catalog.QUERIES))
def test_no_product_no_global_window_no_stray_python(spark, name):
    p = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    lines = p.splitlines()
    for i, line in enumerate(lines):
        # Windows without a key gather everything in one task: only rows per range partition may.
        if re.search(r"Window(GroupLimit)? \[", line) and any("SinglePartition" in x for x in lines[i + 1:i + 3]):
            assert "_p#" in line, line
    if name not in PYTHON:
        assert not re.search(r"Python|Pandas|ArrowEval", p), name


def test_denorm_reads_and_shuffles_little(spark, tmp_path):
    spark.createDataFrame([("a", "t", "s", 1)], "id string, selftext string, subreddit string, ups int").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("1", "t3_a", "b", 1, 2, 3, "x")], "id string, parent_id string, body string, ups int, score int, downs int, author string").write.parquet(str(tmp_path / "c"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(denorm(spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "c"))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # Comments by parent (window, lists and join share it) and posts by id.
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 2
    assert "StringStartsWith(parent_id,t3_)" in p
    assert "author" not in p
    assert "Not(In(selftext" in p.replace("NOT", "Not") or "selftext" in p.split("PushedFilters")[1]


def test_funnel_reads_once(spark):
    p = plan(entry.queries()["funnel_counts"](spark, SF))
    assert len(re.findall(r"FileScan parquet", p)) == 1


def test_top_k_cuts_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    for got in (sampling.top_k(df, ["k"], [F.col("id")], 2), windows.keep_one(df, ["k"], [F.col("id")])):
        p = plan(got)
        assert p.count("WindowGroupLimit") == 2


def test_filters_reach_the_scan(spark):
    p = plan(entry.queries()["point_lookup"](spark, SF))
    assert "EqualTo(o_custkey,7)" in p and "o_orderpriority" not in p


def test_no_local_checkpoint_in_the_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "corpusloom")):
        for f in files:
            if f.endswith(".py"):
                assert "localCheckpoint" not in open(os.path.join(folder, f), encoding="utf-8").read()


def test_shared_folder_follows_the_session(spark):
    from corpusloom.session import scratch_path, shared_dir

    assert scratch_path(spark, "x").startswith(shared_dir(spark).rstrip("/"))
