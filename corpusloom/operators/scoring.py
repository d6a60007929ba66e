"""Running a caller's function over rows: retries, memo, samples, chains, quality gate."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import fixed, text
from corpusloom.operators import neardup, windows
from corpusloom.session import stable


def map_rows(df: DataFrame, **cols: Column) -> DataFrame:
    return df.withColumns(cols)


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)


def flat_map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A batch function that may change the number of rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema=schema)


def apply_groups(
    df: DataFrame, keys: Sequence[str], fn: Callable[[tuple, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, order: Sequence[Column] = (),
) -> DataFrame:
    """`fn(key, batches)` for each group: its rows come in batches, by `order` where one is given, and it yields batches of the result.

    A group is read as a stream, so one of any size takes no more memory than its batches (`spark.sql.execution.arrow.maxRecordsPerBatch` rows) and what
    `fn` itself keeps. NULL is a key like others. The rows of a group go through one task, as the function is theirs alone; a function
    that can be split should be an aggregate.
    """
    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from fn(key, batches)

    # Grouping by the keys finds the rows dealt and sorted already.
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order) if order else df
    return rows.groupBy(*keys).applyInPandas(run, schema=schema)


def score_prompts(
    df: DataFrame, fn: Callable[[str], str], prompt: str = "prompt", samples: int = 1, retries: int = 3, tasks: int | None = None,
    wait: float = 0.5,
) -> DataFrame:
    """Each row with `sample_no`, `output` and `error`, one row per sample.

    Equal prompts are sent once. A call that raises is tried up to `retries` times, after waits of
    `wait`, 2 * `wait`, ... seconds; then the row carries the error and no output. A NULL prompt is
    not sent; its rows say so in `error`. Results are checkpointed, so every reader of them
    sees the same replies even if a task has to run again later.
    """
    asked = df.select(F.col(prompt).alias("_p")).distinct()
    if tasks:
        asked = asked.repartition(tasks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf["_p"]:
                for s in range(samples):
                    output, error = None, "no prompt" if p is None else None
                    for k in range(0 if p is None else retries):
                        time.sleep(wait * k)
                        try:
                            output, error = fn(p), None
                            break
                        except Exception as e:  # the caller's function may fail in any way
                            error = f"{type(e).__name__}: {e}"
                    rows.append((p, s, output, error))
            yield pd.DataFrame(rows, columns=["_p", "sample_no", "output", "error"])

    replies = stable(asked.mapInPandas(run, schema="_p string, sample_no int, output string, error string"))
    return df.join(replies, df[prompt].eqNullSafe(replies["_p"])).drop("_p")


def chain(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]], content: str = "content", output: str = "output") -> DataFrame:
    """Run steps in turn; the output of one becomes the content of the next."""
    for i, step in enumerate(steps):
        if i:
            df = df.drop(content).withColumnRenamed(output, content)
        df = step(df)
    return df


def quality_gate(
    df: DataFrame, scores: DataFrame, id_col: str, threshold: float = 0.1, num_perm: int | None = 64, dedup_on: str = "input"
) -> DataFrame:
    """Near-duplicates out, scores joined by id, only those above the threshold kept, and the
    instruction replaced by cycling the phrasings of the row's kind."""
    kept = neardup.dedup_near(df, id_col, dedup_on, 10, 0.7, num_perm)
    good = kept.join(scores.select(id_col, "score"), id_col).where(F.col("score") > threshold)
    return relabel_instructions(good, "input", id_col)


def relabel_instructions(df: DataFrame, input_col: str, id_col: str) -> DataFrame:
    return windows.round_robin(
        df, text.is_multiple_choice(input_col), [F.col(id_col)],
        {True: fixed.CHOICE_INSTRUCTIONS, False: fixed.QUESTION_INSTRUCTIONS},
    )
