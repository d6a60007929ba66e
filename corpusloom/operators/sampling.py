"""Sampling, shuffling and splitting by md5, so a run can be repeated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import skew


def _mix(seed: int, *key: str) -> Column:
    return F.md5(F.concat_ws("\u0001", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def sort_answers(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("question_id"), F.desc("score"), F.desc("is_accepted"))


def head(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_k(df: DataFrame, part: Sequence[str], order: Sequence[Column], k: int, out: str = "pos") -> DataFrame:
    """First `k` rows per group; Catalyst turns the filter into a group limit before the shuffle."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """`n` rows without replacement, fixed by key and seed."""
    return df.withColumn("_h", _mix(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def draw_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """`n` draws with replacement: draw i takes the row at a hashed place."""
    rows = skew.dense_ids(df, [F.col(key)], "_at")
    total = rows.agg(F.count(F.lit(1)).alias("_n")).scalar()
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn(
        "_at", F.pmod(text.unit_hash("draw", F.lit(seed)), F.greatest(total, F.lit(1)))
    )
    return rows.join(draws, "_at").drop("_at")


def sample_per_group(df: DataFrame, part: Sequence[str], k: int, seed: int, key: str) -> DataFrame:
    """`k` rows per group without replacement; k <= 0 keeps all."""
    if k <= 0:
        return df
    mixed = df.withColumn("_h", _mix(seed, key))
    return top_k(mixed, part, [F.col("_h"), F.col(key)], k, "_pos").drop("_h", "_pos")


def pick(df: DataFrame, choices: Sequence[str], key: str, seed: int, out: str = "choice") -> DataFrame:
    return df.withColumn(out, text.choose(choices, key, F.lit(seed)))


def shuffle(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Row order fixed by key and seed (a range sort on the hash, so evenly spread)."""
    return df.withColumn("_h", _mix(seed, key)).orderBy("_h", key).drop("_h")


def hash_split(df: DataFrame, key: str, fracs: Mapping[str, float], seed: int = 0, out: str = "split") -> DataFrame:
    """Label rows with a split by the key's place in [0, 1); shares must add up to 1."""
    u = text.unit_hash(key, F.lit(seed)) / F.lit(float(1 << 32))
    label, edge = None, 0.0
    for name, share in fracs.items():
        edge += share
        label = F.when(u < edge, F.lit(name)) if label is None else label.when(u < edge, F.lit(name))
    return df.withColumn(out, label.otherwise(F.lit(list(fracs)[-1])))


def mix(dfs: Mapping[str, DataFrame], weights: Mapping[str, float], seed: int, key: str, out: str = "dataset") -> DataFrame:
    """Union of datasets, each thinned to its declared share by a hash of its key."""
    got = None
    for name, df in dfs.items():
        u = text.unit_hash(F.lit(name), key, F.lit(seed)) / F.lit(float(1 << 32))
        part = df.where(u < F.lit(float(weights[name]))).withColumn(out, F.lit(name))
        got = part if got is None else got.unionByName(part, allowMissingColumns=True)
    return got
