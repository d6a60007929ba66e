"""Prompt factories, judge prompts and training mixes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import fixed, text
from corpusloom.operators import filters, joins, prompts, sampling, sets


def prompt_factory(
    passages: DataFrame, templates: Sequence[tuple[str, str, str]], id_col: str, content: str, max_words: int = 4096,
    per_passage: int = 0, seed: int = 0,
) -> DataFrame:
    """Passages x templates (name, instruction, guideline), at most `per_passage` templates each
    (0 means all), rendered. Templates are literals, so nothing is shuffled; the choice is made
    inside the row."""
    body = text.truncate_words(text.strip(content), max_words)
    arr = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("instruction"), F.lit(g).alias("guideline")) for n, i, g in templates])
    if per_passage > 0:
        keyed = F.transform(arr, lambda t: F.struct(F.md5(F.concat_ws("\u0001", F.col(id_col).cast("string"), t["name"], F.lit(str(seed)))).alias("h"), t.alias("t")))
        arr = F.transform(F.slice(F.sort_array(keyed), 1, per_passage), lambda x: x["t"])
    rows = passages.withColumn("_body", body).select(id_col, "_body", F.inline(arr))
    return rows.select(
        id_col, "name",
        prompts.render_instruction("instruction", "guideline", "_body", F.lit("")).alias("prompt"),
    )


def grouped_prompts(
    rows: DataFrame, templates: DataFrame, tag_map: DataFrame, id_col: str, title: str = "title", body: str = "text", tag: str = "tag"
) -> DataFrame:
    """Pages x templates of the groups their tag feeds; the input is title, newline, text."""
    x = joins.expand_by_group(rows, tag_map, templates, tag)
    return x.select(
        id_col, "group", "name",
        prompts.render_instruction("instruction", "guideline", F.concat(F.col(title), F.lit("\n"), F.col(body)), F.lit("")).alias("prompt"),
    )


def judge_prompts(
    answers: DataFrame, layouts: Mapping[str, str], id_col: str = "task_id", query: str = "question", reply: str = "answer",
    background: str = "background", context: str = "context",
) -> DataFrame:
    """One row per answer and metric. Each row's own documents are shown to the judge."""
    docs = F.concat(F.coalesce(background, F.lit("")), F.lit("\n"), F.coalesce(context, F.lit("")))
    one = [
        F.struct(
            F.lit(metric).alias("metric"),
            text.render(layout, query=query, reply=reply, history=F.lit(""), FullBody=docs).alias("prompt"),
        )
        for metric, layout in layouts.items()
    ]
    return answers.select(id_col, F.inline(F.array(*one)))


def training_mix(
    wiki: DataFrame, analyze: DataFrame, forum: DataFrame, system: str, forum_system: str, seed: int = 0, floors: tuple[int, int, int, int] = (3, 2, 2, 1),
) -> tuple[DataFrame, DataFrame]:
    """(text rows, visual rows) as chat messages, shuffled.

    wiki and analyze carry instruction, input, response, int_score; forum carries query,
    image, response, int_score, and is split by whether there is an image.
    """
    def asked(df: DataFrame, floor: int, kind: str) -> DataFrame:
        kept = filters.filter_score(df, "int_score", ">=", floor)
        return kept.select(text.to_query("instruction", "input").alias("query"), "response", F.lit(kind).alias("source"))

    routed = filters.route_by_null(forum, "image")
    posts = filters.filter_score(routed.where(F.col("route") == "text"), "int_score", ">=", floors[2])
    seen = filters.filter_score(routed.where(F.col("route") == "visual"), "int_score", ">=", floors[3])
    texts = sets.union_all([
        prompts.to_chat(asked(wiki, floors[0], "wiki"), system, image=None),
        prompts.to_chat(asked(analyze, floors[1], "analyze"), system, image=None),
        prompts.to_chat(posts.select("query", "response", F.lit("forum").alias("source")), forum_system, image=None),
    ])
    visual = prompts.to_chat(seen.select("query", "response", "image", F.lit("visual").alias("source")), forum_system)
    mixed = lambda df: sampling.shuffle(df.withColumn("_k", F.concat_ws("\u0001", "source", "query", "response")), seed, "_k").drop("_k")
    return mixed(texts), mixed(visual)
