"""Readers. Schemas are given, not inferred, wherever a job depends on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import fixed, text
from corpusloom.operators import skew, windows

COMMENT_SCHEMA = (
    "author_flair_text string, author_flair_css_class string, author string, subreddit_id string, body string, "
    "created_utc bigint, downs bigint, id string, name string, subreddit string, ups bigint, parent_id string, score bigint"
)
POST_SCHEMA = (
    "created bigint, subreddit string, id string, num_comments bigint, score bigint, selftext string, title string, "
    "thumbnail string, link_flair_type string, link_flair_css_class string, author_flair_css_class string, "
    "link_flair_text string, upvote_ratio double, ups bigint, over_18 boolean, is_video boolean"
)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, spread: int | None = None) -> DataFrame:
    """JSON lines, plain or `.gz`. A gzip file is one task; `spread` repartitions behind it."""
    r = spark.read.schema(schema) if schema else spark.read
    df = r.json(path)
    return df.repartition(spread) if spread else df


def read_json_arrays(spark: SparkSession, glob: str, schema: str | None = None) -> DataFrame:
    """Files that each hold one JSON array: one row per element, all files together."""
    r = spark.read.schema(schema) if schema else spark.read
    return r.option("multiLine", True).json(glob)


def read_xml_rows(spark: SparkSession, glob: str, columns: list[str]) -> DataFrame:
    """`<row A=".." B=".."/>` lines to string columns. A line that is not one whole row element
    is dropped, and no other line suffers. Lines are splittable, unlike whole XML files."""
    schema = T.StructType([T.StructField(f"_{c}", T.StringType()) for c in columns] + [T.StructField("_bad", T.StringType())])
    line = F.trim(F.regexp_replace("value", "[\r﻿]", ""))
    lines = spark.read.text(glob).where(line.rlike(r"^<row\s.*/>$"))
    # A field named for corrupt records tells a broken line from one without attributes.
    rec = F.from_xml(line, schema, {
        "columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false",
    })
    return (
        lines.select(rec.alias("r")).where(F.col("r").isNotNull() & F.col("r._bad").isNull())
        .select(*[F.col(f"r._{c}").alias(c) for c in columns])
    )


def _whole(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.text(glob, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"),
        F.regexp_replace("value", "\r\n?|^﻿", "\n").alias("value"),
    )


def read_srt(spark: SparkSession, glob: str) -> DataFrame:
    """(path, pos, start, end, content): one row per cue, markup out, inner newlines to spaces."""
    cues = _whole(spark, glob).select("path", F.posexplode(F.split(text.strip("value"), "\n[ \t]*\n")).alias("pos", "cue"))
    m = r"(?s)^\s*(?:\d+\s*\n)?\s*([0-9:,.]+)\s*-->\s*([0-9:,.]+)[^\n]*\n?(.*)$"
    return cues.where(F.col("cue").contains("-->")).select(
        "path", "pos", F.regexp_extract("cue", m, 1).alias("start"), F.regexp_extract("cue", m, 2).alias("end"),
        text.newlines_to_space(text.html_to_text(text.strip(F.regexp_extract("cue", m, 3)))).alias("content"),
    )


def read_ass(spark: SparkSession, glob: str) -> DataFrame:
    """(path, pos, Layer .. Text): Dialogue lines after `[Events]`, tags out, `\\N` to newline,
    the first nine commas split the fields. Layer keeps its "Dialogue: 0" form."""
    events = _whole(spark, glob).where(F.col("value").rlike(r"(?m)^\s*\[Events\]"))
    after = F.element_at(F.split("value", r"(?m)^\s*\[Events\][^\n]*$", 2), 2)
    lines = events.select("path", F.posexplode(F.split(after, "\n")).alias("pos", "line"))
    clean = F.replace(text.strip(text.html_to_text("line")), F.lit("\\N"), F.lit("\n"))
    parts = lines.where(F.col("line").rlike(r"^\s*Dialogue:")).select("path", "pos", F.split(clean, ",", 10).alias("f"))
    return parts.select("path", "pos", *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(fixed.ASS_COLUMNS)])


def with_episode_number(df: DataFrame, pattern: str | None = None, path: str = "path", out: str = "episode_number") -> DataFrame:
    """From the file name by a pattern's first group, or the place of the file among sorted
    paths, from 001. Ranking sees one row per file."""
    name = F.url_decode(F.element_at(F.split(path, "/"), -1)) if pattern else F.col(path)
    if pattern:
        return df.withColumn(out, F.regexp_extract(name, pattern, 1))
    files = skew.dense_ids(df.select(path).distinct(), [F.col(path)], "_at")
    # lpad would cut numbers of more than three digits.
    no = (F.col("_at") + 1).cast("string")
    padded = F.when(F.length(no) >= 3, no).otherwise(F.lpad(no, 3, "0"))
    return df.join(skew.small(files.select(path, padded.alias(out))), path)


def as_lookup(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key; the last record by `order` (given descending) wins."""
    return windows.keep_one(df, [key], order)


def read_split(spark: SparkSession, root: str, split: str) -> DataFrame:
    """One split of a dataset written by `write_splits`; only its folder is read."""
    return spark.read.parquet(root).where(F.col("split") == split)
