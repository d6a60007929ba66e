"""Filters, predicates and projections (no Python in the data path)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import fixed, text
from corpusloom.operators import skew


def with_prefixed_key(df: DataFrame, id_col: str, prefix: str = fixed.POST_PREFIX, out: str = "post_id") -> DataFrame:
    return df.withColumn(out, F.concat(F.lit(prefix), F.col(id_col).cast("string")))


def drop_tombstones(df: DataFrame, col: str, values: Sequence[str] = fixed.TOMBSTONES) -> DataFrame:
    """NULL bodies go too: `NOT IN` over NULL is unknown."""
    return df.where(~F.col(col).isin(*values))


def min_tokens(col: str, floor: float) -> Column:
    enough = text.est_tokens(col) >= floor
    return enough if floor > 0 else enough & (text.word_count(col) > 0)


def filter_min_tokens(df: DataFrame, col: str, floor: float) -> DataFrame:
    return df.where(min_tokens(col, floor))


def count_by_length(df: DataFrame, col: str, cut: float) -> DataFrame:
    """How many rows reach a length and how many stay at or under it."""
    n = text.est_tokens(col)
    return df.agg(
        F.sum((n >= cut).cast("bigint")).alias("at_least"),
        F.sum((n <= cut).cast("bigint")).alias("at_most"),
    )


def filter_map_flag(df: DataFrame, map_col: str, key_sub: str, val_sub: str = "yes") -> DataFrame:
    """Drop rows where some inner key contains `key_sub` and its value contains `val_sub`."""
    inner = F.flatten(F.transform(F.map_values(map_col), lambda m: F.map_entries(m)))
    hit = F.exists(
        inner,
        lambda e: F.contains(F.lower(e["key"]), F.lit(key_sub.lower()))
        & F.contains(F.lower(e["value"]), F.lit(val_sub.lower())),
    )
    return df.where(~F.coalesce(hit, F.lit(False)))


def has_map_key_like(map_col: Column | str, sub: str) -> Column:
    m = F.col(map_col) if isinstance(map_col, str) else map_col
    hit = F.exists(F.map_keys(m), lambda k: F.contains(F.lower(k), F.lit(sub.lower())))
    return F.coalesce(hit, F.lit(False))


def is_denied(col: str, phrases: Sequence[str]) -> Column:
    """Whether the text holds any phrase, in any case. One alternation, one pass over the text."""
    quoted = "|".join("\\Q" + p.lower().replace("\\E", "\\E\\\\E\\Q") + "\\E" for p in phrases if p)
    return F.coalesce(F.lower(F.col(col)).rlike(quoted), F.lit(False)) if quoted else F.lit(False)


def filter_denylist(df: DataFrame, col: str, phrases: Sequence[str]) -> DataFrame:
    """Drop rows that hold any phrase, in any case."""
    return df.where(~is_denied(col, phrases))


def filter_keywords(df: DataFrame, col: str, words: Sequence[str]) -> DataFrame:
    """Keep rows with a whole whitespace token in `words`. "word?" is another token, and
    an entry of two words can never match; both follow from matching whole tokens."""
    return df.where(F.arrays_overlap(text.tokens(F.lower(F.col(col))), F.array(*[F.lit(w) for w in words])))


def matched_keywords(df: DataFrame, col: str, words: Sequence[str], mode: str = "token", out: str = "hits") -> DataFrame:
    """Which of `words` hit, sorted: whole tokens, or substrings."""
    low = F.lower(F.col(col))
    lits = F.array(*[F.lit(w) for w in sorted(set(words))])
    if mode == "token":
        hits = F.array_intersect(lits, text.tokens(low))
    else:
        hits = F.filter(lits, lambda w: F.contains(low, w))
    return df.withColumn(out, F.coalesce(hits, F.array().cast("array<string>")))


def filter_tag_like(df: DataFrame, tags: str, sub: str) -> DataFrame:
    return df.where(F.coalesce(F.exists(tags, lambda t: F.contains(t, F.lit(sub))), F.lit(False)))


_OPS = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


def filter_score(df: DataFrame, col: str, op: str, threshold: float) -> DataFrame:
    return df.where(_OPS[op](F.col(col), F.lit(threshold)))


def route_by_null(df: DataFrame, col: str, out: str = "route", null: str = "text", other: str = "visual") -> DataFrame:
    """One scan, one label column; readers filter on the label."""
    return df.withColumn(out, F.when(F.col(col).isNull(), F.lit(null)).otherwise(F.lit(other)))


def drop_sections(df: DataFrame, names: Sequence[str] = fixed.EXCLUDED_SECTIONS, col: str = "heading") -> DataFrame:
    return df.where(~F.col(col).isin(*names))


def filter_images(imgs: Column | str, bad_alts: Sequence[str] = fixed.FURNITURE_ALTS) -> Column:
    """Drop array elements whose `alt` is in the list; no alt means ""."""
    c = F.col(imgs) if isinstance(imgs, str) else imgs
    return F.filter(c, lambda i: ~F.coalesce(i["alt"], F.lit("")).isin(*bad_alts))


def shape_instruction_rows(
    df: DataFrame,
    rename: Mapping[str, str] | None = None,
    drop: Sequence[str] = (),
    casts: Mapping[str, str] | None = None,
    constants: Mapping[str, str] | None = None,
) -> DataFrame:
    out = df.withColumnsRenamed(dict(rename or {})).drop(*drop)
    cols = {c: F.col(c).cast(t) for c, t in (casts or {}).items()}
    cols.update({c: F.lit(v) for c, v in (constants or {}).items()})
    return out.withColumns(cols) if cols else out


def epoch_to_ts(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.timestamp_seconds(F.col(col)))


def with_row_id(df: DataFrame, order: Sequence[Column | str], out: str = "row_id") -> DataFrame:
    return skew.dense_ids(df, order, out)


def drop_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(skew.small(ids.select(key).distinct()), key, "left_anti")


def with_query_suffix(df: DataFrame, col: str, suffix: str = fixed.ANSWER_ONLY_SUFFIX, out: str = "query") -> DataFrame:
    return df.withColumn(out, F.concat(F.col(col), F.lit(suffix)))
