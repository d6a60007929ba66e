"""A corpus from raw documents to a weighted mix: each stage works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import contamination, mixing, neardup_forest, pseudonyms, quality
from corpusloom.llm.store import written
from corpusloom.operators.skew import dense_ids, small
from corpusloom.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Ids that may be sent to every task; more of them go through a shuffled join.
BROADCAST_IDS = 1_000_000
# Secret of the pseudonyms; a real run passes its own.
KEY = "corpus-pipeline"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts, in quality and toxicity; `labels` says what is good.

    Whole rows go through the classifier and come out again, so repeated ids and NULL ids need no join.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs.select(*COLUMNS), labels).select(*COLUMNS)


def _with_rows(docs: DataFrame) -> DataFrame:
    """`docs` with `_row`, a number of its own for every row that follows doc_id: doc_id itself where every row has its own."""
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
    if shared.isEmpty():
        return docs.withColumn("_row", F.col("doc_id"))
    return dense_ids(docs, [F.asc_nulls_last("doc_id"), *COLUMNS[1:]], "_row")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the one with the smallest id.

    Rows are judged, not ids: of an id with two texts either can go alone. Of rows that repeat an id and its text one stays; a row without an
    id comes after all others, so it goes if it repeats one of them. Rows without words stay.
    """
    docs = _with_rows(docs.select(*COLUMNS))
    found = written(neardup_forest.near_duplicates(docs, width=5, percent=80, id_col="_row"), "found")
    gone = found.where("not kept").select(F.col("doc_id").alias("_row"))
    return docs.join(small(gone, BROADCAST_IDS), "_row", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (five words, four fifths of its shingles).

    Rows are judged, not ids: of an id with two texts only the one that holds an item goes. Rows without an id are judged like others; rows
    without words hold nothing and stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = _with_rows(docs.select(*COLUMNS))
    held = written(contamination.contained_items(docs, items, width=5, percent=80, id_col="_row").select("doc_id").distinct(), "held")
    return docs.join(small(held.withColumnRenamed("doc_id", "_row"), BROADCAST_IDS), "_row", "left_anti").select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by pseudonyms; n_chars follows the new text. Row by row: ids may be NULL or repeat, a NULL text stays NULL."""
    hidden = pseudonyms.pseudonymise(docs.select(*COLUMNS), key=KEY, counts=None)
    return hidden.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often, and with how many words, the mix takes each document: (doc_id, source, size, source_size, target, copies, taken).

    One row per row: rows with a NULL or repeated id are documents of their own, a NULL source is a source, a NULL text has no words.
    """
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", hide_personal_data),
    ("mix", mix_sources),
]
# A trained classifier and random rounding have no SQL equal; the tests hold the operators against plain versions and the stages against planted rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
