"""Benchmark decontamination: which documents hold which test items.

An item is in a document when 100 * |item shingles in the document| >= percent * |item shingles|.

Search. A containment threshold is no fixed similarity: an item of q shingles inside a document of u has a Jaccard
similarity of about q / u. So both sides are partitioned by size (powers of two), an item probes only the partitions
whose documents can hold enough of it, and the MinHash sketch compared is one that does not shrink with u: the
smallest hash values. An item's sketch has its floor((1 - t) * q) + 1 smallest values. A document that holds the share
t of the item lacks at most floor((1 - t) * q) of its shingles, hence has at least one value of the sketch: no item is
missed. On the document's side only values up to the largest sketch value of any item (about 1 - t of all) are looked up.

Verification. The candidates' whole texts are cut into shingles again and compared as strings.

All of it is DataFrame expressions. The items' sketch is broadcast only while it has at most BROADCAST_VALUES rows;
beyond that the same join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import sqlwords as S
from corpusloom.llm.store import written
from corpusloom.operators.skew import small

BROADCAST_VALUES = 200_000
# (document, item) candidates and items that may be sent to every task.
BROADCAST_ROWS = 200_000


def _class(n: Column) -> Column:
    """Size partition: floor(log2(n)), 0 for empty sets."""
    return F.length(F.bin(F.greatest(n, F.lit(1)))) - 1


def contained_items(
    docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for every document and item with the share `percent` or more.

    Words are runs of non-space characters, A-Z lower-cased; a text of fewer than `width` words is one shingle.
    NULL and word-free texts hold nothing and are in nothing. A NULL id is an id like any other. Rows that repeat an
    id and a text give one result row; of rows that repeat an id with other texts the fullest match counts. Empty tables give an
    empty result. Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cut = S.shingles(S.words(F.col("_t")), width)
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("_t")).select("item_id", F.array_distinct(cut).alias("item_shingles"))
    items = written(items.withColumn("n_item", F.size("item_shingles")).where("n_item > 0"), "items")

    hashes = F.array_sort(F.array_distinct(F.transform(F.col("item_shingles"), _string_hash(width))))
    spare = F.floor(F.col("n_item") * (100 - percent) / 100).cast("int") + 1
    sketch = items.select(
        "item_id", F.explode(F.slice(hashes, F.lit(1), spare)).alias("h"),
        _class(F.ceil(F.col("n_item") * percent / 100)).alias("least_class"),
    )
    sketch = written(sketch, "sketch")
    top = sketch.agg(F.max("h")).first()[0]  # one number
    probe = docs.select("doc_id", S.shingle_hashes(S.words(F.col("text")), width).alias("hs"))
    # Repeats count here, so a document is in no smaller partition than its set would be.
    probe = probe.select("doc_id", _class(F.size("hs")).alias("doc_class"), F.filter("hs", lambda x: x <= F.lit(top)).alias("hs"))
    probe = probe.select("doc_id", "doc_class", F.explode("hs").alias("h"))
    pairs = probe.join(small(sketch, BROADCAST_VALUES), "h").where("doc_class >= least_class").select("doc_id", "item_id").distinct()
    pairs = written(pairs, "candidates")

    wanted = pairs.groupBy("doc_id").agg(F.collect_set(F.struct("item_id")).alias("wanted"))
    both = docs.withColumnRenamed("doc_id", "_d").join(small(wanted, BROADCAST_ROWS), F.col("_d").eqNullSafe(F.col("doc_id"))).drop("_d")
    both = both.select("doc_id", "wanted", F.array_distinct(S.shingles(S.words(F.col("text")), width)).alias("doc_shingles"))
    both = both.select("doc_id", "doc_shingles", F.explode("wanted.item_id").alias("_i"))
    both = both.join(small(items, BROADCAST_ROWS), F.col("_i").eqNullSafe(F.col("item_id")))
    n = F.size(F.array_intersect("item_shingles", "doc_shingles"))
    both = both.select("doc_id", "item_id", "n_item", n.alias("n_shared")).where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    best = both.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_item", "n_shared")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_item", "m.n_shared", (F.col("m.n_shared") / F.col("m.n_item")).alias("containment"))


def _string_hash(width: int):
    """The hash that `sqlwords.shingle_hashes` gives a shingle, from its string."""

    def of(s: Column) -> Column:
        return F.element_at(S.shingle_hashes(F.split(s, " "), width), 1)

    return of
