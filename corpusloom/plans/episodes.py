"""Subtitle cues to episode documents and dialogue contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import prompts, skew

CONTEXT_SCHEMA = "array<struct<context:string,character_lines:array<struct<character:string,line:string>>>>"


def episode_text(
    cues: DataFrame, episode: str, order: list[Column], col: str, sep: str = "\n", out: str = "content",
    list_limit: int = skew.GROUP_LIMIT,
) -> DataFrame:
    """(episode, piece, content): cue texts joined in order. `skew.ordered_rows` gives the cues as rows, with their places."""
    lists = skew.ordered_lists(cues, [episode], order, [F.col(col).alias("v")], "_l", list_limit)
    return lists.select(episode, "piece", F.array_join(F.transform("_l", lambda x: x["v"]), sep).alias(out))


def episode_docs(
    cues: DataFrame | None, summaries: DataFrame, kind: str, order: list[Column] | None = None, cue_col: str = "content",
    episode: str = "episode_number",
) -> DataFrame:
    """Summaries as search documents of a kind, with the dialogue where cues are given."""
    docs = summaries.select(episode, F.col("content"), F.lit(kind).alias("type"))
    if cues is None:
        return docs.withColumn("dialogue", F.lit(None).cast("string"))
    return docs.join(episode_text(cues, episode, order or [F.col("pos")], cue_col, "-", "dialogue"), episode, "left")


def dialogue_contexts(scored: DataFrame, episode: str = "episode_number", raw: str = "output") -> tuple[DataFrame, DataFrame]:
    """One row per context of a parsed reply, tagged with its episode; bad replies apart."""
    good, bad = prompts.parse_fenced(scored, raw, CONTEXT_SCHEMA, ["context"], "_p")
    rows = good.select(episode, F.posexplode("_p").alias("context_no", "c")).select(
        episode, "context_no", "c.context", "c.character_lines"
    )
    return rows, bad
