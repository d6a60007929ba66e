"""Question dumps to preference sets, and keyword-filtered answers to instruction rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import fixed, text
from corpusloom.operators import filters, joins, preference, sampling, sets, windows
from corpusloom.plans.stages import run_stages
from corpusloom.sources import readers, writers

POST_COLUMNS = ["Id", "PostTypeId", "Title", "Body", "Tags", "Score", "CreationDate", "LastActivityDate"]
ANSWER_SCHEMA = (
    "question_id bigint, answer_id bigint, title string, body string, body_markdown string, score bigint, up_vote_count bigint, "
    "is_accepted boolean, creation_date bigint"
)


def tagged_questions(posts: DataFrame, tag: str) -> DataFrame:
    """Dump rows with the tag, one per Id: of several snapshots the last active one."""
    t = posts.withColumn("Tags", text.split_tags("Tags"))
    hit = filters.filter_tag_like(t, "Tags", tag)
    return windows.keep_one(hit, ["Id"], [F.desc("LastActivityDate"), F.desc("Body")])


def question_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    a = filters.epoch_to_ts(answers, "creation_date")
    return joins.join_suffixed(a, questions, "question_id", "Id", ("_answer", "_question"))


def qa_preferences(answers: DataFrame, max_pairs: int | None = None) -> DataFrame:
    """(question_id, question, response_j, response_k): better answer first, HTML removed; all pairs unless capped."""
    scored = preference.with_preference_score(answers).withColumn("answer", text.html_to_text("body"))
    pairs = preference.preference_pairs(scored, max_pairs=max_pairs)
    titles = answers.groupBy("question_id").agg(F.min("title").alias("question"))
    return pairs.join(titles, "question_id").select(
        "question_id", "question", "answer_j", "response_j", "answer_k", "response_k"
    )


def preference_set(
    spark: SparkSession, dumps: str, answers: str, out: str, tag: str, shares: Mapping[str, float] | None = None, max_pairs: int | None = None,
) -> DataFrame:
    """From dumps of questions and files of answers to a dataset of preference pairs with named splits; returns its rows with `split`.

    `dumps` is a glob of row files, one snapshot each, `answers` one of JSON lines. The stages and their tables below `out`:
    `questions` with the tag, of several snapshots the last active one; `question_answers`, each answer once with its question, the
    last given first when files repeat it; `pairs`, HTML removed, all of them unless `max_pairs` caps a question; `dataset`, in which all
    pairs of a question lie in one split. A run that broke off goes on after its last complete table; other arguments than those
    `out` was begun with are refused. Questions without answers, answers without a question, and ties give no pairs.
    """
    shares = dict(shares or {"train": 0.9, "test": 0.1})

    def questions(_: Mapping[str, DataFrame]) -> DataFrame:
        return tagged_questions(readers.read_xml_rows(spark, dumps, POST_COLUMNS), tag)

    def joined(done: Mapping[str, DataFrame]) -> DataFrame:
        given = readers.read_jsonl(spark, answers, ANSWER_SCHEMA)
        once = windows.keep_one(given, ["answer_id"], [F.desc("up_vote_count"), F.desc("is_accepted"), F.desc("body")])
        return question_answers(once, done["questions"])

    def pairs(done: Mapping[str, DataFrame]) -> DataFrame:
        a = done["question_answers"]
        named = a.withColumnsRenamed({c: c.removesuffix("_answer") for c in a.columns if c.endswith("_answer")})
        return qa_preferences(named.select("question_id", "answer_id", "title", "body", "up_vote_count", "is_accepted"), max_pairs)

    tables = run_stages(spark, out, [("questions", questions), ("question_answers", joined), ("pairs", pairs)], {
        "dumps": dumps, "answers": answers, "tag": tag, "shares": shares, "max_pairs": max_pairs,
    })
    labelled = sampling.hash_split(tables["pairs"], "question_id", shares)
    writers.write_splits({k: labelled.where(F.col("split") == k).drop("split") for k in shares}, f"{out}/dataset")
    return spark.read.parquet(f"{out}/dataset")


def qa_to_instructions(
    splits: Sequence[DataFrame], words: Sequence[str], question: str, answer: str, suffix: str = "",
    instruction: str = fixed.ANSWER_INSTRUCTION,
) -> DataFrame:
    """Questions that name a keyword, over all splits, as instruction rows. An answer that is a
    list of passages stays a list."""
    got = filters.filter_keywords(sets.union_all(splits), question, words)
    return got.select(
        F.lit(instruction).alias("instruction"), F.concat(F.col(question), F.lit(suffix)).alias("input"),
        F.col(answer).alias("response"),
    )
