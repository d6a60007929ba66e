"""Tables written between jobs, and connected components over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import scratch_path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet below the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, rows: int, per_partition: int) -> int:
    """Partitions so that each has about `per_partition` rows, and no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of one task as stars around the smallest ids: at most one edge for each id it has seen."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for b in batches:
        for x, y in zip(b["a"].tolist(), b["b"].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    out = [(x, r) for x in root if (r := find(x)) != x]
    yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from every id that has an edge, given edges (a, b).

    Every task first turns its own edges into stars. Then large-star and small-star steps alternate until every
    component is one star. A step is an aggregate with map-side combine and an equi join, so a hub with a
    third of all edges is split like any skewed join.
    """
    now = written(edges.where("a <> b").select("a", "b").mapInPandas(_forest, "a long, b long").distinct(), "edges")
    while True:
        # In stars, no centre is the outer end of an edge, and no id is the outer end of two.
        inner = now.join(now.select(F.col("b").alias("a")), "a", "left_semi")
        if inner.isEmpty() and now.groupBy("a").count().where("count > 1").isEmpty():
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(least, "a").select(F.explode(ends).alias("e"))
        now = written(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return written(now.toDF("id", "component").unionByName(roots), "components")
