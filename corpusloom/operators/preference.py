"""Preference scores, orders and pairs over answers of one question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import skew
from corpusloom.session import stable

# Places of a question that are paired together, where all pairs are given.
BLOCK = 1024


def with_preference_score(df: DataFrame, up: str = "up_vote_count", accepted: str = "is_accepted", out: str = "pm_score") -> DataFrame:
    return df.withColumn(out, text.preference_score(up, accepted))


def preference_order(
    df: DataFrame, question: str = "question_id", answer: str = "answer_id", score: str = "pm_score",
    limit: int = skew.GROUP_LIMIT,
) -> DataFrame:
    """All better/worse pairs in linear size: the answer at place `rn` beats exactly the
    `n_worse` answers at places `tie_end + 1 .. n` of its question. Ties beat nobody."""
    placed = skew.place_within(df, [question], score, [F.col(answer)], limit)
    return placed.withColumn("n_worse", F.col("n") - F.col("tie_end"))


def preference_pairs(
    df: DataFrame, question: str = "question_id", answer: str = "answer_id", text_col: str = "answer",
    score: str = "pm_score", max_pairs: int | None = None, limit: int = skew.GROUP_LIMIT,
) -> DataFrame:
    """(question, answer_j, response_j, answer_k, response_k), j better than k.

    Without `max_pairs` every pair is given, which is quadratic in a question's answers by
    meaning; `preference_order` holds the same in linear size. With `max_pairs`, a question that
    has more gives that many different pairs, spread evenly by hash over its numbered pairs;
    the pairs themselves are never enumerated.

    Pairs of a question are numbered 0 .. total-1 along its ordered answers, an answer
    owning the `n_worse` numbers from `before` on. Total pairs are cut into `m` strata,
    each stratum takes one number, and an answer emits the numbers it owns.
    """
    order = preference_order(df.select(question, answer, text_col, score), question, answer, score, limit)
    if max_pairs is None:
        # An answer goes to the blocks that hold worse ones and is compared there: rows moved are answers times blocks, not pairs.
        block = lambda place: F.floor((place - 1) / BLOCK)
        better = order.where("n_worse > 0").select(
            question, F.col(answer).alias("answer_j"), F.col(text_col).alias("response_j"), "tie_end",
            F.explode(F.sequence(block(F.col("tie_end") + 1), block(F.col("n")))).alias("block"),
        )
        worse = order.where("rn > 1").select(
            question, "rn", block(F.col("rn")).alias("block"), F.col(answer).alias("answer_k"), F.col(text_col).alias("response_k")
        )
        # As many tasks as there are partitions: few rows here make many pairs, so their bytes are no measure of the work.
        better = better.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), question, "block")
        met = better.join(worse, [question, "block"]).where(F.col("rn") > F.col("tie_end"))
        return met.select(question, "answer_j", "response_j", "answer_k", "response_k")
    if max_pairs <= 0:
        raise ValueError("max_pairs must be positive")
    _, hot = skew.split_hot(df.select(question), [question], limit)
    if hot is None:
        by = Window.partitionBy(question)
        # The order that numbered the places, so no sort is added.
        run = by.orderBy(F.desc(score), F.col(answer)).rowsBetween(Window.unboundedPreceding, -1)
        o = order.withColumn("before", F.coalesce(F.sum("n_worse").over(run), F.lit(0)))
        o = o.withColumn("total", F.sum("n_worse").over(by))
    else:
        o = skew.running_before(stable(order), [question], [F.col("rn")], F.col("n_worse"), "before", limit)
        totals = order.groupBy(question).agg(F.sum("n_worse").alias("total"))
        o = skew.join_keys(o, totals, [question])
    m = F.least(F.col("total"), F.lit(max_pairs))
    first = F.expr(f"((before + 1) * least(total, {max_pairs}L) - 1) div total")
    last = F.expr(f"((before + n_worse) * least(total, {max_pairs}L) - 1) div total")
    j = (
        o.where("n_worse > 0")
        .withColumn("m", m)
        .withColumn("i", F.explode(F.sequence(first, last)))
        .withColumn("lo", F.expr("(i * total) div m"))
        .withColumn("width", F.expr("((i + 1) * total) div m - lo"))
        .withColumn("p", F.col("lo") + F.pmod(text.unit_hash(question, "i"), F.col("width")))
        .where("p >= before AND p < before + n_worse")
        .select(
            question, F.col(answer).alias("answer_j"), F.col(text_col).alias("response_j"),
            (F.col("tie_end") + 1 + F.col("p") - F.col("before")).alias("rn"),
        )
    )
    k = o.select(question, "rn", F.col(answer).alias("answer_k"), F.col(text_col).alias("response_k"))
    return j.join(k, [question, "rn"]).drop("rn")
