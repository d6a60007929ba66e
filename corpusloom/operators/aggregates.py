"""Grouped and global aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import fixed, text
from corpusloom.operators import skew


def group_structs(
    df: DataFrame, keys: Sequence[str], cols: Sequence[Column | str], order: Sequence[Column], out: str = "items",
    list_limit: int = skew.GROUP_LIMIT,
) -> DataFrame:
    """(keys, piece, first, total, `out`); `skew.ordered_rows` is the form with one row per row."""
    return skew.ordered_lists(df, keys, order, cols, out, list_limit)


def group_list(df: DataFrame, key: str, col: str, out: str = "items", list_limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """Values of `col` per key, sorted; rows without a key are left out."""
    got = skew.ordered_lists(df.where(F.col(key).isNotNull()), [key], [F.col(col)], [F.col(col).alias("v")], out, list_limit)
    return got.withColumn(out, F.transform(out, lambda x: x["v"]))


def with_count(df: DataFrame, list_col: str, out: str = "total") -> DataFrame:
    """Length of the list. Lists of this module come with their group's size as `total`, over all pieces."""
    return df.withColumn(out, F.coalesce(F.size(list_col), F.lit(0)).cast("bigint"))


def value_counts(df: DataFrame, col: Column | str, n: int = 30) -> DataFrame:
    c = F.col(col) if isinstance(col, str) else col
    return (
        df.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("value")).limit(n)
    )


def explode_tags(df: DataFrame, tags: str, out: str = "tag") -> DataFrame:
    """One row per tag; a row without tags stays, with NULL."""
    return df.select("*", F.explode_outer(tags).alias(out))


def map_key_counts(df: DataFrame, map_col: str) -> DataFrame:
    inner = df.select(F.explode(F.map_values(map_col)).alias("m"))
    return (
        inner.select(F.explode(F.map_keys("m")).alias("value"))
        .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    )


def length_stats(df: DataFrame, col: str, by: Sequence[str] = (), approx: int | None = None) -> DataFrame:
    """Token-length statistics with the population deviation.

    Lengths are word counts, so they are counted first and the exact percentile sees
    (length, count) pairs: its state grows with distinct lengths, not with rows.
    `approx` switches to a sketch of that accuracy.
    """
    counts = (
        df.groupBy(*by, text.word_count(col).alias("w")).agg(F.count(F.lit(1)).alias("c"))
        .withColumn("v", F.col("w") * F.lit(fixed.TOKENS_PER_WORD))
    )
    total = F.sum("c")
    mean = F.sum(F.col("v") * F.col("c")) / total
    aggs = [
        total.alias("n"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        mean.alias("mean"),
        F.sqrt(
            F.greatest(F.sum(F.col("v") * F.col("v") * F.col("c")) / total - mean * mean, F.lit(0.0))
        ).alias("std"),
    ]
    if approx:
        return df.withColumn("v", text.est_tokens(col)).groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("min"), F.max("v").alias("max"),
            F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
            *[F.percentile_approx("v", p / 100, approx).alias(f"p{p}") for p in fixed.LENGTH_PERCENTILES],
        )
    aggs += [F.percentile("v", F.lit(p / 100), F.col("c")).alias(f"p{p}") for p in fixed.LENGTH_PERCENTILES]
    return counts.groupBy(*by).agg(*aggs)


def _quantiles(counts: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of (v, c) rows, one per distinct value, as one row q0, q1, ...

    Few distinct values go through the exact aggregate. More of them are sorted over range
    partitions, where each value knows the places it covers.
    """
    if counts.count() <= skew.GROUP_LIMIT:
        return counts.agg(*[F.percentile("v", F.lit(p), F.col("c")).alias(f"q{i}") for i, p in enumerate(probs)])
    placed = skew.running_total(counts, [F.col("v")], F.col("c"), "before")
    placed = placed.withColumn("t", counts.agg(F.sum("c")).scalar())
    out = []
    for i, p in enumerate(probs):
        at = (F.col("t") - 1) * F.lit(p)
        here = lambda pos: F.max(F.when((F.col("before") <= pos) & (pos < F.col("before") + F.col("c")), F.col("v")))
        lo, hi, part = here(F.floor(at)), here(F.ceil(at)), F.max(at - F.floor(at))
        out.append((lo + (hi - lo) * part).alias(f"q{i}"))
    return placed.agg(*out)


def describe(df: DataFrame, cols: Sequence[str], approx: int | None = None) -> DataFrame:
    """count, mean, sample deviation, min, quartiles, max and nulls: one row per column.
    Quartiles are exact; `approx` (an accuracy) takes a sketch instead."""
    probs = (0.25, 0.5, 0.75)
    vals = {c: F.col(c).cast("double") for c in cols}
    # A table within the limit takes its exact quartiles in the same pass as everything else.
    inline = approx is None and df.count() <= skew.GROUP_LIMIT

    def quart(v: Column, i: int) -> Column:
        return F.percentile_approx(v, probs[i], approx) if approx else F.percentile(v, probs[i])

    def one(c: str) -> Column:
        v = vals[c]
        return F.struct(
            F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"),
            F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
            *[(quart(v, i) if approx or inline else F.lit(None).cast("double")).alias(n) for i, n in enumerate(("p25", "p50", "p75"))],
            F.max(v).alias("max"), F.sum(v.isNull().cast("bigint")).alias("nulls"),
        ).alias(f"_{c}")

    rows = df.agg(*[one(c) for c in cols]).select(F.inline(F.array(*[f"`_{c}`" for c in cols])))
    if approx or inline:
        return rows
    quarts = None
    for c in cols:
        counts = df.select(vals[c].alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
        q = _quantiles(counts, probs).withColumn("column", F.lit(c))
        quarts = q if quarts is None else quarts.unionByName(q)
    return rows.drop("p25", "p50", "p75").join(quarts, "column").select(
        "column", "type", "count", "mean", "std", "min", F.col("q0").alias("p25"), F.col("q1").alias("p50"),
        F.col("q2").alias("p75"), "max", "nulls",
    )


def prompt_length_summary(df: DataFrame, col: str = "prompt") -> DataFrame:
    w = text.word_count(col)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(w).alias("avg_words"),
        F.min(w).alias("min_words"), F.max(w).alias("max_words"),
    )


def estimate_cost(
    df: DataFrame, col: str, avg_out: int, prices: Sequence[tuple[str, float, float]] = fixed.PRICES
) -> DataFrame:
    """Money per price row. Everything is summed to one row before prices are put beside it."""
    one = df.agg(F.sum(text.word_count(col)).alias("w"), F.count(F.lit(1)).alias("n"))
    tokens_in = F.col("w") * F.lit(fixed.TOKENS_PER_WORD)
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(a).alias("pin"), F.lit(b).alias("pout")) for m, a, b in prices])
    return one.select("n", tokens_in.alias("tokens_in"), F.inline(arr)).select(
        "model", "n", "tokens_in",
        (F.col("pin") * F.col("tokens_in") / 1e6 + F.col("pout") * (F.lit(avg_out) * F.col("n")) / 1e6).alias("cost"),
    )


def distinct_values(df: DataFrame, col: Column | str) -> DataFrame:
    c = F.col(col) if isinstance(col, str) else col
    return df.select(c.alias("value")).where(F.col("value").isNotNull()).distinct()


def funnel(df: DataFrame, steps: Mapping[str, Column], first: str = "read", distinct: tuple[str, Column] | None = None) -> DataFrame:
    """(pos, step, n): rows left at first and after each named step, in the order given, in one scan.

    A step is the condition its rows must meet; one that is NULL drops the row, and no row reaches a step after the one that dropped
    it. `distinct` names a last step that keeps one row for each value of a column, NULL values left out. The counts are an aggregate, not
    accumulators, so a task that runs again after a loss is counted once.
    """
    passed = F.lit(len(steps))
    for i, keep in reversed(list(enumerate(steps.values()))):
        passed = F.when(F.coalesce(keep, F.lit(False)), passed).otherwise(F.lit(i))
    value = [F.when(F.col("passed") == len(steps), F.col("value")).alias("value")] if distinct else []
    rows = df.select(passed.alias("passed"), *([distinct[1].alias("value")] if distinct else [])).select("passed", *value)
    # Rows of one place and value are one row from here on.
    rows = rows.groupBy("passed", *(["value"] if distinct else [])).agg(F.count(F.lit(1)).alias("c"))
    names = [first, *steps]
    n = [F.coalesce(F.sum(F.when(F.col("passed") >= i, F.col("c"))), F.lit(0)) for i in range(len(names))]
    if distinct:
        names.append(distinct[0])
        n.append(F.count("value"))
    out = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(name).alias("step"), c.alias("n")) for i, (name, c) in enumerate(zip(names, n, strict=True))])
    return rows.agg(out.alias("s")).select(F.inline("s"))
