"""Near-duplicate removal by MinHash bands or by an exact shared-shingle filter.

Meaning (both forms): rows are read in id order; a row is dropped when an earlier
*kept* row is a candidate and their shingle sets have Jaccard >= threshold. So in a
chain A~B~C with A and C apart, C stays: only kept rows drop others.

That greedy reading is computed in rounds. In each bucket the smallest open ids lead: one
in the first round, then 4, 16, 64 and LEADERS. All members are checked against the leaders of their buckets.
An id that leads in all its buckets and has no smaller open id like it is kept for good, and whatever is like it
is dropped. Work per round is linear in the bucket table however large a bucket is; the first
rounds drop copies of few leaders, the later ones settle rows that only share keys.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions import text as tx
from corpusloom.operators import batches, skew
from corpusloom.session import stable

# Most rows of a bucket that lead it in one round; the first rounds have fewer, while many rows are open.
LEADERS = 256
# Numbers of rows that may be sent to every executor.
SENT_IDS = 1_000_000
# Shingles that one task sorts, in memory.
KEY_ROWS = 4_000_000

_U = np.uint64


def _scramble(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (wraps by design)."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of word n-grams; a shorter text is one shingle."""
    if len(words) == 0:
        return np.empty(0, dtype=np.int64)
    w = words.astype(np.int64).view(np.uint64)
    width = min(n, len(w))
    acc = np.zeros(len(w) - width + 1, dtype=np.uint64)
    for j in range(width):
        acc = acc * _U(0x9E3779B97F4A7C15) + w[j : j + len(acc)]
    return np.unique(_scramble(acc).view(np.int64))


def _bands(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of `rows` minima."""
    if len(shingles) == 0:
        return np.empty(0, dtype=np.int64)
    x = shingles.view(np.uint64)
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(x), 2048):
        block = x[at : at + 2048, None] * a[None, :] + b[None, :]
        low = np.minimum(low, (block ^ (block >> _U(32))).min(axis=0))
    grid = low[: bands * rows].reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = _scramble(key * _U(0x9E3779B97F4A7C15) + grid[:, r])
    return key.view(np.int64)


def band_shape(num_perm: int, threshold: float) -> tuple[int, int]:
    """(bands, rows) whose curve (1/bands)^(1/rows) comes nearest the threshold."""
    shapes = [(num_perm // r, r) for r in range(1, num_perm + 1)]
    return min(shapes, key=lambda s: (abs((1 / s[0]) ** (1 / s[1]) - threshold), s[1]))


def _word_hashes(col: str):
    return F.transform(tx.tokens(F.coalesce(F.col(col), F.lit(""))), lambda w: F.xxhash64(w))


def shingle_sets(df: DataFrame, id_col: str, text_col: str, ngrams: int = 10) -> DataFrame:
    """(id, s): sorted distinct shingle hashes per row."""
    rows = df.select(F.col(id_col).alias("id"), _word_hashes(text_col).alias("_w"))
    return batches.with_result(rows, "_w", "s", "array<bigint>", lambda w: _shingles(w, ngrams), keep=False)


def band_table(sets: DataFrame, bands: int, rows: int, num_perm: int, seed: int = 1) -> DataFrame:
    """(id, n, band, bucket): the buckets of every set in `bands` bands of `rows` minima."""
    rng = np.random.RandomState(seed)
    a = rng.randint(0, 2**63, num_perm, dtype=np.int64).view(np.uint64) * _U(2) + _U(1)
    b = rng.randint(0, 2**63, num_perm, dtype=np.int64).view(np.uint64)
    sized = sets.select("id", F.size("s").alias("n"), "s")
    keyed = batches.with_result(sized, "s", "_k", "array<bigint>", lambda s: _bands(s, a, b, bands, rows), keep=False)
    return keyed.select("id", "n", F.posexplode("_k").alias("band", "bucket"))


def _prefix_keys(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, key): the rarest shingles of each set, as many as any pair at the threshold must share one of.

    Two sets with Jaccard >= t overlap in at least t|x| shingles, so they share one of the
    first |x| - ceil(t|x|) + 1 of any common order. Rarest first keeps boilerplate out.
    """
    # Narrow rows: all shingles move once, without the sizes and as 48 of their 64 bits. Shingles that fall together stand for each
    # other in the common order, which adds candidates and loses none; they are confirmed on the full sets.
    long = sets.select("id", F.explode(F.transform("s", lambda x: F.shiftrightunsigned(x, 16))).alias("key"))
    rows = sets.agg(F.sum(F.size("s"))).collect()[0][0] or 0  # one row
    long = long.repartition(max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // KEY_ROWS)), "key")
    # Counted where the rows of a key are. Shingles of one row only come first in the order and lead
    # to nobody, so only their number matters: shared ones are the only rows that go on.
    shared = long.withColumn("f", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("f > 1")
    w = Window.partitionBy("id")
    placed = shared.withColumn("at", F.row_number().over(w.orderBy("f", "key"))).withColumn("m", F.count(F.lit(1)).over(w))
    # The slack keeps ceil() from rounding an exact product up and losing a position.
    need = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    return (
        placed.join(sets.select("id", F.size("s").alias("n")), "id")
        .where(F.col("n") - F.col("m") + F.col("at") <= need)
        .select("id", "n", "key").distinct()
    )


def _by_size(keys: DataFrame, threshold: float) -> DataFrame:
    """(id, n, key) with `key` split by set size, so that sets of very different size do not meet.

    Jaccard >= t needs sizes within a factor t. Classes are a little wider than that factor, and
    each row joins its own class and the next one, so every such pair still shares a key.
    """
    if threshold <= 0:
        return keys.select("id", "key")
    width = -math.log(min(threshold, 0.99) * 0.999)
    own = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / width)
    return keys.select("id", "key", F.explode(F.array(own, own + 1)).alias("c")).select(
        "id", F.xxhash64("key", "c").alias("key")
    )


def _greedy(sets: DataFrame, keys: DataFrame, threshold: float) -> list[DataFrame]:
    """Run rounds until nothing is open; returns the dropped (id, kept_id, similarity) of each."""
    gone_all: list[DataFrame] = []
    left = stable(_shared(keys))
    # A key of one row leads to no comparison, and most rows have no other kind.
    sets = stable(_of_ids(sets, left.select("id")))
    leaders = 1
    while not left.isEmpty():
        # The filter on row_number reaches the window as a group limit: a task passes on `leaders` rows of a key.
        place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
        block = stable(left.withColumn("_rn", place).where(F.col("_rn") <= leaders).select("key", F.col("id").alias("lead")))
        pairs = left.join(block, "key").where("lead < id").select("id", "lead").distinct()
        # Only sets that are still compared move.
        leads = _of_ids(sets, block.select(F.col("lead").alias("id"))).select(F.col("id").alias("lead"), F.col("s").alias("t"))
        both = pairs.join(_of_ids(sets, left.select("id")), "id").join(leads, "lead")
        shared = F.size(F.array_intersect("s", "t"))
        scored = both.select("id", "lead", (shared / (F.size("s") + F.size("t") - shared)).alias("sim"))
        links = stable(scored.where(F.col("sim") >= threshold))
        # An id among the leaders of all its keys has met every smaller open id.
        keyed = left.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        led = block.groupBy(F.col("lead").alias("id")).agg(F.count(F.lit(1)).alias("m"))
        ready = keyed.join(led, "id").where("n = m").select("id")
        kept = stable(ready.join(links.select("id").distinct(), "id", "left_anti"))
        gone = stable(
            links.join(kept.withColumnRenamed("id", "lead"), "lead", "left_semi").groupBy("id")
            .agg(F.min(F.struct(F.col("lead").alias("kept_id"), F.col("sim").alias("similarity"))).alias("v"))
            .select("id", "v.kept_id", "v.similarity")
        )
        gone_all.append(gone)
        decided = kept.unionByName(gone.select("id"))
        left = stable(_shared(left.join(decided, "id", "left_anti")))
        leaders = min(4 * leaders, LEADERS)
    return gone_all


def _of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (texts, sets) of `ids`; sent to the rows, not the rows to them, while they are at most SENT_IDS."""
    return rows.join(skew.small(stable(ids.distinct()), SENT_IDS), "id", "left_semi")


def _shared(keys: DataFrame) -> DataFrame:
    """Rows of keys that more than one row has."""
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return keys.join(many.select("key"), "key", "left_semi").select("id", "key")


def _dropped(
    df: DataFrame, id_col: str, text_col: str, ngrams: int, threshold: float, num_perm: int | None
) -> DataFrame:
    """(id, kept_id, similarity) for every dropped row; exact copies are collapsed first."""
    keyed = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = stable(keyed.select("id", F.md5("text").alias("h")))
    firsts = stable(hashed.groupBy("h").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("c")))
    # A text id would travel with every shingle: it is replaced by its place among the ids, which keeps their order.
    named = skew.dense_ids(firsts.select("id").distinct(), ["id"], "no") if isinstance(df.schema[id_col].dataType, StringType) else None
    if named is None:
        heads = _of_ids(keyed, firsts.select("id"))
    else:
        named = stable(named.where("id IS NOT NULL"))
        heads = keyed.join(named, "id").select(F.col("no").alias("id"), "text")
    sets = stable(shingle_sets(heads, "id", "text", ngrams))
    if num_perm is None:
        keys = _prefix_keys(sets, threshold)
    else:
        keys = band_table(sets, *band_shape(num_perm, threshold), num_perm).select("id", "n", F.xxhash64("band", "bucket").alias("key"))
    parts = _greedy(sets, _by_size(keys, threshold), threshold)
    if named is not None:
        kept = named.select(F.col("id").alias("kept"), F.col("no").alias("kept_id"))
        own = named.select(F.col("id").alias("own"), F.col("no").alias("id"))
        parts = [p.join(own, "id").join(kept, "kept_id").select(F.col("own").alias("id"), F.col("kept").alias("kept_id"), "similarity") for p in parts]
    copies = (
        hashed.join(firsts.where("c > 1").select("h", F.col("id").alias("kept_id")), "h")
        .where("id <> kept_id")
        .select("id", "kept_id", F.lit(1.0).alias("similarity"))
    )
    if not parts:
        return copies
    near = parts[0]
    for p in parts[1:]:
        near = near.unionByName(p)
    # A copy of a dropped row points at the row that dropped it.
    moved = near.select(F.col("id").alias("kept_id"), F.col("kept_id").alias("k2"), F.col("similarity").alias("s2"))
    copies = copies.join(moved, "kept_id", "left").select(
        "id", F.coalesce("k2", "kept_id").alias("kept_id"), F.coalesce("s2", "similarity").alias("similarity")
    )
    return near.unionByName(copies)


def near_duplicate_pairs(
    df: DataFrame, id_col: str, text_col: str, ngrams: int = 10, threshold: float = 0.7, num_perm: int | None = 256
) -> DataFrame:
    """Each dropped row with the kept row it repeats: (id, kept_id, similarity).

    Rows with one `kept_id` are one group. `num_perm=None` finds candidates with the
    exact filter, so no pair at the threshold is missed.
    """
    return _dropped(df, id_col, text_col, ngrams, threshold, num_perm)


def dedup_near(
    df: DataFrame, id_col: str, text_col: str, ngrams: int = 10, threshold: float = 0.7, num_perm: int | None = 256
) -> DataFrame:
    """Rows that survive; see the module text for which do."""
    gone = _dropped(df, id_col, text_col, ngrams, threshold, num_perm)
    return df.join(gone.select(F.col("id").alias(id_col)), id_col, "left_anti")
