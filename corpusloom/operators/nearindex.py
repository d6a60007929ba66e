"""A kept index for near-duplicate search: later batches are matched against all rows that were added before.

The index is a folder of four Parquet tables:

- `params`: how shingles, hashes and bands are made; written last, so a folder without it is no index;
- `sets`: the distinct shingle sets (cls, n, s), `cls` being a digest of the set;
- `bands`: the buckets of every set (band, bucket, cls, n);
- `members`: which row has which set (id, cls).

Rows with equal sets are one set with many members, so copies cost one comparison however many they are. Bands only propose: every
bucket mate whose size allows the threshold is compared in full. The bands are cut so that a pair at the threshold
misses all of them with a chance of at most MISS.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import neardup
from corpusloom.session import stable

MISS = 1e-6
_PARAMS = "ngrams int, threshold double, num_perm int, bands int, rows int, seed int"


class Params(NamedTuple):
    """What rows of an index must agree in to be comparable."""

    ngrams: int = 10
    threshold: float = 0.7
    num_perm: int = 256
    seed: int = 1

    @property
    def shape(self) -> tuple[int, int]:
        """(bands, rows in a band): the longest bands that still miss a pair at the threshold by chance MISS at most."""
        fit = [(self.num_perm // r, r) for r in range(1, self.num_perm + 1) if (1 - self.threshold**r) ** (self.num_perm // r) <= MISS]
        if not fit:
            raise ValueError(f"{self.num_perm} hash functions cannot find pairs at {self.threshold}")
        return fit[-1]


def read_params(spark: SparkSession, path: str) -> Params:
    try:
        row = spark.read.schema(_PARAMS).parquet(f"{path}/params").first()  # one row
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    if row is None:
        raise ValueError(f"no index at {path}")
    p = Params(row["ngrams"], row["threshold"], row["num_perm"], row["seed"])
    if p.shape != (row["bands"], row["rows"]):
        raise ValueError(f"the index at {path} was cut into other bands: {row['bands']} of {row['rows']}")
    return p


def _check(spark: SparkSession, path: str, params: Params | None) -> Params:
    kept = read_params(spark, path)
    if params is not None and params != kept:
        raise ValueError(f"the index at {path} has {kept}, not {params}")
    return kept


def _classes(df: DataFrame, id_col: str, text_col: str, p: Params) -> tuple[DataFrame, DataFrame]:
    """(members, sets) of rows with at least one word; other rows are like nothing."""
    s = neardup.shingle_sets(df, id_col, text_col, p.ngrams).where(F.size("s") > 0)
    named = stable(s.withColumn("cls", F.unhex(F.md5(F.array_join(F.col("s").cast("array<string>"), ",")))))
    sets = named.groupBy("cls").agg(F.first("s").alias("s")).select("cls", F.size("s").alias("n"), "s")
    return named.select("id", "cls"), stable(sets)


def _bands(sets: DataFrame, p: Params) -> DataFrame:
    named = sets.select(F.col("cls").alias("id"), "s")
    return neardup.band_table(named, *p.shape, p.num_perm, p.seed).select("band", "bucket", F.col("id").alias("cls"), "n")


def build_index(df: DataFrame, path: str, id_col: str, text_col: str, params: Params | None = None) -> None:
    """A new index of `df` in the folder `path`, which must not hold one."""
    spark, p = df.sparkSession, params or Params()
    members, sets = _classes(df, id_col, text_col, p)
    sets.write.parquet(f"{path}/sets")
    _bands(sets, p).write.parquet(f"{path}/bands")
    members.write.parquet(f"{path}/members")
    row = (p.ngrams, p.threshold, p.num_perm, *p.shape, p.seed)
    spark.createDataFrame([row], _PARAMS).coalesce(1).write.parquet(f"{path}/params")


def add_to_index(df: DataFrame, path: str, id_col: str, text_col: str, params: Params | None = None) -> None:
    """Add the rows of `df`. Known sets get further members only. Adding rows twice makes them members twice, and no more matches."""
    spark = df.sparkSession
    p = _check(spark, path, params)
    members, sets = _classes(df, id_col, text_col, p)
    fresh = stable(sets.join(spark.read.parquet(f"{path}/sets").select("cls"), "cls", "left_anti"))
    # Members last: a set without members matches nothing, so a run that stops here can be repeated.
    fresh.write.mode("append").parquet(f"{path}/sets")
    _bands(fresh, p).write.mode("append").parquet(f"{path}/bands")
    members.write.mode("append").parquet(f"{path}/members")


def match_index(df: DataFrame, path: str, id_col: str, text_col: str, params: Params | None = None) -> DataFrame:
    """(id, seen_id, similarity, n_seen): the sets of the index whose Jaccard similarity with a row's is at least the threshold.

    One row for each row of `df` and indexed set: `seen_id` is the smallest id that has the set, `n_seen` the number of different ids that do. All bucket
    mates are compared; the index stays as it is. `params`, where given, must be those of the index. Rows without words match nothing,
    rows with a NULL id match like others, equal rows give equal rows.
    """
    spark = df.sparkSession
    p = _check(spark, path, params)
    members, sets = _classes(df, id_col, text_col, p)
    old_bands, old_sets = spark.read.parquet(f"{path}/bands"), spark.read.parquet(f"{path}/sets")
    # Equal sets need no comparison, and are met once although they share every band.
    old = old_bands.select("band", "bucket", F.col("cls").alias("seen"), F.col("n").alias("m"))
    near = _bands(sets, p).join(old, ["band", "bucket"]).where(
        (F.least("n", "m") >= F.greatest("n", "m") * F.lit(p.threshold * (1 - 1e-12))) & (F.col("cls") != F.col("seen"))
    )
    pairs = near.select("cls", "seen").distinct()
    both = pairs.join(sets.select("cls", "s"), "cls").join(old_sets.select(F.col("cls").alias("seen"), F.col("s").alias("t")).dropDuplicates(["seen"]), "seen")
    shared = F.size(F.array_intersect("s", "t"))
    like = both.select("cls", "seen", (shared / (F.size("s") + F.size("t") - shared)).alias("similarity")).where(F.col("similarity") >= p.threshold)
    same = sets.join(old_sets.select("cls").distinct(), "cls", "left_semi").select("cls", F.col("cls").alias("seen"), F.lit(1.0).alias("similarity"))
    known = spark.read.parquet(f"{path}/members").groupBy(F.col("cls").alias("seen")).agg(F.min("id").alias("seen_id"), F.countDistinct("id").alias("n_seen"))
    found = like.unionByName(same).join(known, "seen")
    return members.join(found, "cls").select("id", "seen_id", "similarity", "n_seen")
