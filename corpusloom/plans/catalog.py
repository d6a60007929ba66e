"""The registered queries: each operator on the shared tables, with its SQL equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Give text-heavy work one task per core when the scan has fewer splits than that.
    A table of ordinary size has more splits than cores and passes through untouched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *key)


def docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *cols), "doc_id")


def cents(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.floor(col * 100 + 0.5).cast("bigint")


def load() -> None:
    """Import the modules that register queries."""
    from corpusloom.plans import (  # noqa: F401
        catalog_corpus,
        catalog_formats,
        catalog_relational,
        catalog_text,
    )
