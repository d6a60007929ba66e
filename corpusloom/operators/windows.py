"""Ranking, context and numbering inside groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import skew


def rank_within(df: DataFrame, part: Sequence[str], score: str, tie_break: Sequence[Column], limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """Adds `rank`: by score descending, ties share a place, gaps follow."""
    return skew.place_within(df, part, score, tie_break, limit).drop("rn", "tie_end", "n")


def _blocks(df: DataFrame, part: Sequence[str], order: Sequence[Column], reach: int, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(ordinary groups, large groups cut into blocks that overlap by `reach` rows)."""
    cold, hot = skew.split_hot(df, part, limit)
    if hot is None:
        return cold, None
    size = max(limit, reach + 1)
    n = skew.number_within(hot, part, order, "_rn", limit=0)
    home = F.floor((F.col("_rn") - 1) / size)
    spill = F.floor((F.col("_rn") - 1 + reach) / size)
    n = n.withColumn("_home", home).withColumn("_b", F.explode(F.sequence(home, spill)))
    return cold, n


def trailing_context(
    df: DataFrame, part: Sequence[str], order: Sequence[Column], col: str, n: int = 6, sep: str = "-",
    out: str = "context", limit: int = skew.GROUP_LIMIT,
) -> DataFrame:
    """The last `n` values up to this row, joined by `sep`."""
    def over(d: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*by).rowsBetween(-(n - 1), 0)
        return d.withColumn(out, F.array_join(F.collect_list(col).over(w), sep))

    cold, hot = _blocks(df, part, order, n - 1, limit)
    done = over(cold, part, order)
    if hot is None:
        return done
    h = over(hot, [*part, "_b"], [F.col("_rn")]).where(F.col("_b") == F.col("_home"))
    return done.unionByName(h.drop("_rn", "_b", "_home"))


def with_previous(
    df: DataFrame, part: Sequence[str], order: Sequence[Column], col: str, out: str = "prev",
    default: str = "", limit: int = skew.GROUP_LIMIT,
) -> DataFrame:
    """The previous row's value, `default` for the first row."""
    cold, hot = _blocks(df, part, order, 1, limit)
    done = cold.withColumn(out, F.coalesce(F.lag(col).over(Window.partitionBy(*part).orderBy(*order)), F.lit(default)))
    if hot is None:
        return done
    w = Window.partitionBy(*part, "_b").orderBy("_rn")
    h = hot.withColumn(out, F.coalesce(F.lag(col).over(w), F.lit(default))).where(F.col("_b") == F.col("_home"))
    return done.unionByName(h.drop("_rn", "_b", "_home"))


def fold_series(
    df: DataFrame, part: str, order: Sequence[str], col: str, fn: Callable[[str, str], str], out: str = "result"
) -> DataFrame:
    """`result` = fn(previous result, value), in order, starting from "" in each series.

    A step needs the one before it, so a series is serial by its meaning. Rows stream
    through sorted partitions: a task holds one Arrow batch and one previous result.
    """
    sorted_ = df.repartition(F.col(part)).sortWithinPartitions(part, *order)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, prev = object(), ""
        for pdf in batches:
            res = []
            for s, v in zip(pdf[part], pdf[col]):
                if s != series:
                    series, prev = s, ""
                prev = fn(prev, v)
                res.append(prev)
            yield pdf.assign(**{out: res})

    return sorted_.mapInPandas(run, schema=", ".join([*fields, f"`{out}` string"]))


def round_robin(
    df: DataFrame, class_col: Column, order: Sequence[Column], labels: dict[object, Sequence[str]],
    out: str = "instruction", limit: int = skew.GROUP_LIMIT,
) -> DataFrame:
    """Cycle each class's labels over its rows in order."""
    n = skew.number_within(df.withColumn("_class", class_col), ["_class"], order, "_rn", limit)
    pick = None
    for value, names in labels.items():
        arr = F.array(*[F.lit(x) for x in names])
        one = F.element_at(arr, (F.pmod(F.col("_rn") - 1, F.lit(len(names))) + 1).cast("int"))
        cond = F.col("_class") == F.lit(value)
        pick = F.when(cond, one) if pick is None else pick.when(cond, one)
    return n.withColumn(out, pick).drop("_class", "_rn")


def with_batch_id(df: DataFrame, n: int, order: Sequence[Column | str], out: str = "batch") -> DataFrame:
    ids = skew.dense_ids(df, order, "_row")
    return ids.withColumn(out, F.floor(F.col("_row") / n).cast("bigint")).drop("_row")


def keep_one(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key by `order`. The filter on row_number reaches the window as a group
    limit, so each task passes on one row per key before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
