"""First places of dictionary titles in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.operators import skew, substrings
from corpusloom.session import stable

_HITS = "array<struct<title:string,start_word:int,end_word:int,entity_type:string>>"


def tag_dictionary(pages: DataFrame, title: str = "title", tag: str = "tag") -> DataFrame:
    """(entity_type, title), distinct; pages without a tag and empty titles are left out."""
    return (
        pages.where(F.col(tag).isNotNull() & (F.coalesce(F.col(title), F.lit("")) != ""))
        .select(F.col(tag).alias("entity_type"), F.col(title).alias("title")).distinct()
    )


def _typed_places(docs: DataFrame, dictionary: DataFrame, text_col: str, hot: int) -> DataFrame:
    """(_t, title, start_word, end_word, entity_type): a row for each different text, title and type."""
    d = dictionary.select(F.col("title").cast("string").alias("title"), F.col("entity_type").cast("string").alias("entity_type")).where("title <> ''").distinct()
    typed = substrings.first_places(docs, stable(d), text_col, "title", hot)
    return typed.select("_t", "title", F.col("at").alias("start_word"), (F.col("at") + F.length("title")).alias("end_word"), "entity_type")


def gazetteer_rows(docs: DataFrame, dictionary: DataFrame, id_col: str, text_col: str, hot: int = skew.GROUP_LIMIT) -> DataFrame:
    """(id, title, start_word, end_word, entity_type): the first case-sensitive occurrence of each title in each row's text,
    0-based character offsets, wherever it starts; one row for each type of the title.

    Dictionaries and texts of any size are joined as tables, and texts are never moved. Rows with a NULL or repeated id have their own
    texts' titles; rows without text have none.
    """
    places = _typed_places(docs, dictionary, text_col, hot)
    rows = docs.select(F.col(id_col), substrings.text_key(F.col(text_col)).alias("_t"))
    return rows.join(places, "_t").drop("_t")


def annotate_gazetteer(docs: DataFrame, dictionary: DataFrame, id_col: str, text_col: str, out: str = "annotations", hot: int = skew.GROUP_LIMIT) -> DataFrame:
    """`docs` with an array of the (title, start_word, end_word, entity_type) that `gazetteer_rows` gives, by title, then type."""
    places = _typed_places(docs, dictionary, text_col, hot)
    # At most as many as a text has different pieces.
    lists = places.groupBy("_t").agg(F.sort_array(F.collect_list(F.struct("title", "start_word", "end_word", "entity_type"))).alias(out))
    joined = docs.withColumn("_t", substrings.text_key(F.col(text_col))).join(lists, "_t", "left")
    return joined.select(*docs.columns, F.coalesce(out, F.array().cast(_HITS)).alias(out))


def annotation_rows(annotated: DataFrame, id_col: str, col: str = "annotations") -> DataFrame:
    return annotated.select(id_col, F.inline(col))


def entity_prompts(annotated: DataFrame, text_col: str, col: str = "annotations") -> DataFrame:
    """Instruction rows whose response is the JSON map title -> place and type. A title of two
    types keeps the last in name order."""
    # Equal titles follow each other.
    last = F.filter(col, lambda x, i: F.coalesce(F.get(F.col(col), i + 1)["title"] != x["title"], F.lit(True)))
    entries = F.transform(
        last, lambda x: F.struct(x["title"], F.struct(x["start_word"].alias("start_word"), x["end_word"].alias("end_word"), x["entity_type"].alias("entity_type")))
    )
    return annotated.select(
        F.lit(fixed.ENTITY_INSTRUCTION).alias("instruction"), F.col(text_col).alias("input"),
        F.to_json(F.map_from_entries(entries)).alias("response"),
    )
