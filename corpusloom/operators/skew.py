"""Ordered work inside groups of any size.

A window puts a whole group into one task. That is the right plan while every
group is small, and fails when one key holds a large share of the rows. The
functions here look at group sizes first (one pre-aggregated pass over the key
columns), keep the plain window for ordinary groups, and spread the few large
ones over range partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import stable

# Rows of one group that a single task may sort or hold.
GROUP_LIMIT = 1_000_000
# Rows of a table that may be sent to every executor.
BROADCAST_ROWS = 100_000


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[f"_k_{k}"])
    return cond


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark `df` for broadcast only if it has at most `limit` rows.

    Counted, not limited: a limit would bring `limit` rows of every partition to one task.
    """
    return F.broadcast(df) if df.count() <= limit else df


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join that also matches NULL keys; the right side's keys are dropped."""
    r = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return left.join(r, _same(left, r, keys), how).drop(*[f"_k_{k}" for k in keys])


def join_few(left: DataFrame, right: DataFrame, keys: Sequence[str], limit: int = GROUP_LIMIT, salts: int = 64) -> DataFrame:
    """Inner equi join with a right side that has few rows for each key, NULL keys left out.

    Keys with more than `limit` rows on the left are dealt over `salts` tasks each, and the right rows of these keys, few by
    meaning, go to all of them. `left` is read twice, so it should be a table or a checkpoint.
    """
    many = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).drop("_n")
    if many.isEmpty():
        return left.join(right, list(keys))
    many = small(stable(many)).withColumn("_hot", F.lit(True))
    salted = left.join(many, list(keys), "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(F.lit(0).cast("bigint"))
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    dealt = right.join(many, list(keys), "left").withColumn("_salt", F.explode(copies))
    return salted.drop("_hot").join(dealt.drop("_hot"), [*keys, "_salt"]).drop("_salt")


def split_hot(
    df: DataFrame, keys: Sequence[str], limit: int = GROUP_LIMIT
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups up to `limit`, rows of larger groups or None).

    The check reads the key columns only, and combines their counts before it shuffles them.
    """
    hot = _hot_keys(df, keys, limit)
    # There can be at most rows/limit of them; still checked before any broadcast.
    if hot.isEmpty():
        return df, None
    hot = small(stable(hot))
    return join_keys(df, hot, keys, "left_anti"), join_keys(df, hot, keys, "left_semi")


def _hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).drop("_n")


def _split_few(df: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame | None, DataFrame | None]:
    """As `split_hot`, but where the large groups are too many to be broadcast all rows count as theirs: (None, df).

    The spread path is right for groups of any size, and costs less than the two shuffles of a split.
    """
    hot = _hot_keys(df, keys, limit)
    many = hot.count()
    if not many:
        return df, None
    if many > BROADCAST_ROWS:
        return None, df
    hot = F.broadcast(stable(hot))
    return join_keys(df, hot, keys, "left_anti"), join_keys(df, hot, keys, "left_semi")


def _range_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _spread(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Sort by `order` over range partitions; `_p` is the partition, `_i` the place in it.

    Checkpointed, because `_p` and `_i` must not change if a task runs again.
    """
    s = (
        df.repartitionByRange(_range_parts(df), *order)
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
    )
    return (
        stable(s)
        .withColumn("_p", F.shiftright("_m", 33).cast("int"))
        .withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
        .drop("_m")
    )


def dense_ids(df: DataFrame, order: Sequence[Column | str], out: str = "row_id") -> DataFrame:
    """0, 1, 2, ... over the whole table. `order` must be unique, or places among ties vary."""
    s = _spread(df, [F.col(o) if isinstance(o, str) else o for o in order])
    per = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range partition, so one task is enough.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return s.join(F.broadcast(offs), "_p").withColumn(out, F.col("_i") + F.col("_off")).drop("_p", "_i", "_off")


def running_total(df: DataFrame, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Sum of `value` over all earlier rows of the whole table, by range partitions."""
    s = _spread(df.withColumn("_v", value), order)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition.
    offs = s.groupBy("_p").agg(F.sum("_v").alias("_s")).select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_loc", F.coalesce(F.sum("_v").over(local), F.lit(0))).join(F.broadcast(offs), "_p")
    return s.withColumn(out, F.col("_loc") + F.col("_off")).drop("_p", "_i", "_v", "_loc", "_off")


def running_before(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[Column],
    value: Column,
    out: str,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Sum of `value` over the earlier rows of the group (0 for the first)."""
    earlier = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cold, hot = split_hot(df, part, limit)
    done = cold.withColumn(out, F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    if hot is None:
        return done
    s = _spread(hot.withColumn("_v", value), [*[F.col(p) for p in part], *order])
    local = Window.partitionBy("_p", *part).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition and group met in it: hot groups plus range partitions at most.
    met = s.groupBy("_p", *part).agg(F.sum("_v").alias("_s"))
    carry = met.withColumn(
        "_carry",
        F.coalesce(
            F.sum("_s").over(
                Window.partitionBy(*part).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    ).drop("_s")
    s = s.withColumn("_loc", F.coalesce(F.sum("_v").over(local), F.lit(0)))
    s = join_keys(s, small(carry), ["_p", *part])
    s = s.withColumn(out, F.col("_loc") + F.col("_carry"))
    return done.unionByName(s.drop("_p", "_i", "_v", "_loc", "_carry"))


def _whole_and_cut(s: DataFrame, part: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a `_spread` table: (of groups that lie in one range partition, of groups that go over partitions).

    Only the first and the last group of a partition can go on elsewhere, so the cut groups are fewer than the partitions.
    """
    group = F.struct(*part)
    ends = s.groupBy("_p").agg(F.min_by(group, "_i").alias("a"), F.max_by(group, "_i").alias("z"))
    ends = ends.select("_p", F.explode(F.array("a", "z")).alias("g")).distinct()
    cut = F.broadcast(stable(ends.groupBy("g").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("g.*")))
    return join_keys(s, cut, part, "left_anti").drop("_p", "_i"), join_keys(s, cut, part, "left_semi")


def _number_cut(s: DataFrame, part: Sequence[str], out: str) -> DataFrame:
    """Numbers the groups of a `_spread` table that go over its partitions, by the rows before each partition."""
    # Fewer groups than partitions, so a row for each partition and group met in it is a small table.
    met = s.groupBy("_p", *part).agg(F.min("_i").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*part).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("_carry", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    s = join_keys(s, small(met), ["_p", *part])
    return s.withColumn(out, F.col("_i") - F.col("_lo") + F.col("_carry") + 1).drop("_p", "_i", "_lo", "_carry")


def _union(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def _spread_numbers(df: DataFrame, part: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """1, 2, 3, ... inside each group over range partitions: a group that lies in one is sorted there, others are numbered by offsets."""
    whole, cut = _whole_and_cut(_spread(df, [*[F.col(p) for p in part], *order]), part)
    done = whole.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("bigint"))
    return _union(done, _number_cut(cut, part, out))


def number_within(
    df: DataFrame, part: Sequence[str], order: Sequence[Column], out: str = "rn", limit: int = GROUP_LIMIT
) -> DataFrame:
    """1, 2, 3, ... inside each group, whatever the group's size. With a limit of 0 all rows are spread without a count."""
    if limit <= 0:
        return _spread_numbers(df, part, order, out)
    cold, hot = _split_few(df, part, limit)
    done = None if cold is None else cold.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("bigint"))
    return done if hot is None else _union(done, _spread_numbers(hot, part, order, out))


def _placed(df: DataFrame, part: Sequence[str], score: str, tie_break: Sequence[Column]) -> DataFrame:
    by = Window.partitionBy(*part)
    down = by.orderBy(F.desc(score))
    return (
        df.withColumn("rn", F.row_number().over(by.orderBy(F.desc(score), *tie_break)).cast("bigint"))
        .withColumn("rank", F.rank().over(down).cast("bigint"))
        .withColumn("tie_end", F.count(F.lit(1)).over(down))
        .withColumn("n", F.count(F.lit(1)).over(by))
    )


def place_within(
    df: DataFrame,
    part: Sequence[str],
    score: str,
    tie_break: Sequence[Column],
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Places by `score` descending: `rn` (unique), `rank` (ties share, with gaps),
    `tie_end` (last place of the tie) and `n` (group size)."""
    cold, hot = _split_few(df, part, limit)
    done = None if cold is None else _placed(cold, part, score, tie_break)
    if hot is None:
        return done
    whole, cut = _whole_and_cut(_spread(hot, [*[F.col(p) for p in part], F.desc(score), *tie_break]), part)
    done = _union(done, _placed(whole, part, score, tie_break))
    numbered = stable(_number_cut(cut, part, "rn"))
    ties = numbered.groupBy(*part, score).agg(F.min("rn").alias("rank"), F.max("rn").alias("tie_end"))
    sizes = numbered.groupBy(*part).agg(F.max("rn").alias("n"))
    s = join_keys(numbered, ties, [*part, score])
    return _union(done, join_keys(s, small(sizes), part))


def ordered_rows(
    df: DataFrame, part: Sequence[str], order: Sequence[Column], cols: Sequence[Column | str], limit: int = GROUP_LIMIT, value: str = "value",
) -> DataFrame:
    """(part, place, total, value): one row per row, with its place 1, 2, ... in its group and the group's size.

    The grain is that of `df` whatever the sizes of groups; `ordered_lists` gathers these rows.
    """
    picked = F.struct(*[F.col(c) if isinstance(c, str) else c for c in cols])
    kept = df.withColumn("_v", picked)
    by = Window.partitionBy(*part)
    place, total = F.row_number().over(by.orderBy(*order)).cast("bigint"), F.count(F.lit(1)).over(by)
    placed = lambda rows: rows.select(*part, place.alias("place"), total.alias("total"), F.col("_v").alias(value))
    cold, hot = _split_few(kept, part, limit)
    done = None if cold is None else placed(cold)
    if hot is None:
        return done
    whole, cut = _whole_and_cut(_spread(hot, [*[F.col(p) for p in part], *order]), part)
    done = _union(done, placed(whole))
    n = _number_cut(cut, part, "place")
    totals = small(cut.groupBy(*part).agg(F.count(F.lit(1)).alias("total")))  # fewer groups than range partitions
    return _union(done, join_keys(n, totals, part).select(*part, "place", "total", F.col("_v").alias(value)))


def gather(rows: DataFrame, part: Sequence[str], out: str, list_limit: int = GROUP_LIMIT, value: str = "value") -> DataFrame:
    """The list form of `ordered_rows`: (part, piece, first, total, `out`).

    `total` is the group's size in every row. A group longer than `list_limit` continues in further rows, `piece` = 1, 2, ..., whose
    lists begin at place `first`; no task holds more than one piece.
    """
    cut = rows.withColumn("piece", F.floor((F.col("place") - 1) / list_limit).cast("int"))
    got = cut.groupBy(*part, "piece").agg(
        F.min("place").alias("first"), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("place", F.col(value).alias("_v")))).alias("_l")
    )
    return got.select(*part, "piece", "first", "total", F.transform("_l", lambda x: x["_v"]).alias(out))


def ordered_lists(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[Column],
    cols: Sequence[Column | str],
    out: str,
    list_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """The rows of each group as an ordered array of structs (`out`), with `piece`, `first` and `total` as `gather` gives them."""
    return gather(ordered_rows(df, part, order, cols, list_limit, "_value"), part, out, list_limit, "_value")
