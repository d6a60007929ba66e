"""Equi, anti, semi and expansion joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.operators import skew


def ranked_comments(comments: DataFrame, limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """(parent_id, place, total, comment): comments on posts, best score first; `comment.rank` is shared by ties.

    The long form of a post's list: one row per comment, however many a post has.
    """
    # Replies to comments carry another parent prefix; the prefix test reaches the scan and spares their shuffle.
    kept = comments.where(F.startswith(F.col("parent_id"), F.lit(fixed.POST_PREFIX)))
    placed = skew.place_within(kept, ["parent_id"], "score", [F.col("id")], limit)
    value = F.struct("body", "ups", "score", "downs", F.col("rank").cast("int").alias("rank"))
    return placed.select("parent_id", F.col("rn").alias("place"), F.col("n").alias("total"), value.alias("comment"))


def post_comment_rows(posts: DataFrame, comments: DataFrame, limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """One row per post and comment, with `place` and `total`; a post without comments has one row with NULLs and a total of 0.

    A post with a large share of all comments is dealt over several tasks.
    """
    rows = ranked_comments(comments, limit)
    return posts.join(rows, posts.post_id == rows.parent_id, "left").withColumn("total", F.coalesce("total", F.lit(0)))


def denorm_posts_comments(posts: DataFrame, comments: DataFrame, list_limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """Posts with their comments as a ranked list; a post without comments keeps NULL.

    The list form of `post_comment_rows`. A post whose list exceeds `list_limit` continues in rows with `piece` 1, 2, ..., each with the
    post's number of comments as `total` and the place its list begins at as `first`.
    """
    lists = skew.gather(ranked_comments(comments, list_limit), ["parent_id"], "comments", list_limit, "comment")
    return posts.join(lists, posts.post_id == lists.parent_id, "left").withColumns({
        "piece": F.coalesce("piece", F.lit(0)), "first": F.coalesce("first", F.lit(1)), "total": F.coalesce("total", F.lit(0)),
    })


def join_suffixed(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, suffixes: tuple[str, str], how: str = "inner"
) -> DataFrame:
    """Keys compared as strings; names on both sides, in any case, get the side's suffix."""
    def renamed(df: DataFrame, other: DataFrame, suffix: str) -> dict[str, str]:
        there = {c.lower() for c in other.columns}
        return {c: c + suffix for c in df.columns if c.lower() in there}

    ln, rn = renamed(left, right, suffixes[0]), renamed(right, left, suffixes[1])
    l, r = left.withColumnsRenamed(ln), right.withColumnsRenamed(rn)
    return l.join(r, l[ln.get(left_key, left_key)].cast("string") == r[rn.get(right_key, right_key)].cast("string"), how)


def id_diff(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """Ids on one side only, as (side, id); ids compared as whole numbers."""
    x = a.select(F.col(a_key).cast("bigint").alias("id")).distinct()
    y = b.select(F.col(b_key).cast("bigint").alias("id")).distinct()
    left = x.join(y, "id", "left_anti").select(F.lit("left_only").alias("side"), "id")
    return left.unionByName(y.join(x, "id", "left_anti").select(F.lit("right_only").alias("side"), "id"))


def pending(todo: DataFrame, done: DataFrame, key: str, done_key: str | None = None) -> DataFrame:
    """Rows of `todo` whose key is not in `done` yet. A NULL key is never done."""
    d = done.select(F.col(done_key or key).alias(key)).distinct()
    return todo.join(d, key, "left_anti")


def image_key(link: Column | str) -> Column:
    c = F.col(link) if isinstance(link, str) else link
    return F.lower(F.element_at(F.split(c, "/"), -1))


def expand_by_group(rows: DataFrame, tag_map: DataFrame, templates: DataFrame, tag: str = "tag") -> DataFrame:
    """Row x group of its tag x template of the group; tags without a group drop out."""
    return rows.join(skew.small(tag_map), tag).join(skew.small(templates), "group")


def cross_templates(passages: DataFrame, templates: list[tuple[str, ...]], names: list[str]) -> DataFrame:
    """Every passage with every template: the templates are literals, so this is a
    narrow `inline`, with no join and no shuffle."""
    arr = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(t, names)]) for t in templates])
    return passages.select("*", F.inline(arr))


def zip_by_id(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pair rows by an explicit id, never by position."""
    return a.join(b, key)


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))
