"""Merkle manifest of a dataset, with nested-interval labels.

A leaf is the digest of a row. The leaves of a group are numbered by rank, and a node carries the interval of leaf ranks [lo, hi) it
covers, its level and its digest. A level is made from the one below: the children whose `lo` lies in one bucket of fan-out ** level
ranks form a node over the union of their intervals. Ancestors are attached from the top down: a node lies in the parent of
its bucket one level up whose interval contains its own, an equi join on (group, bucket), and the children left when its own
interval is taken out of the parent's are its siblings. What is attached to a node is the list of (siblings before it, siblings after it)
up to the top, so a leaf gets its whole proof by one join with its parent, and folds it inside its row.

Groups are trees, and the tops of their trees are the leaves of one more tree, of the same kind, whose top is the root. No group and no
level is gathered: ranks come from range partitions, buckets hold at most the fan-out.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.store import written
from corpusloom.operators.skew import dense_ids, small

FAN_OUT = 16
BROADCAST_GROUPS = 100_000

# Siblings before and after a node, from its own level up: digests in lower-case hex, one after another.
PATH = "array<struct<before:string,after:string>>"


class Manifest(NamedTuple):
    """`leaves`: the rows' keys, `group` number, rank, `leaf` digest. `groups`: number, key, leaf count, `subroot`.
    `nodes`: the inner nodes of all groups. `paths`: the inner nodes with their paths to the root. `upper`: the paths of the subroots. `top`: one row, the root."""

    leaves: DataFrame
    groups: DataFrame
    nodes: DataFrame
    paths: DataFrame
    upper: DataFrame
    top: DataFrame


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A field of a leaf: its length in UTF-8 bytes, a colon and its value; `-` for NULL."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(cols: Sequence[Column]) -> Column:
    return digest(*[field(c) for c in cols])


def _count(level: int) -> Column:
    """Nodes of a group at a level."""
    return F.ceil(F.col("n") / F.lit(FAN_OUT**level))


def _forest(leaves: DataFrame) -> list[DataFrame]:
    """Levels 1, 2, ... as (grp, n, lo, hi, kids, digest) of groups given by (grp, n, rank, leaf); a single leaf has none."""
    tallest = leaves.agg(F.max("n")).first()[0] or 0  # one number
    below = leaves.select("grp", "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("leaf").alias("digest"))
    levels: list[DataFrame] = []
    while -(-tallest // FAN_OUT ** len(levels)) > 1:
        size = FAN_OUT ** (len(levels) + 1)
        open_ = below.where(_count(len(levels)) > 1)
        kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))
        node = open_.groupBy("grp", "n", F.floor(F.col("lo") / size).alias("bucket")).agg(kids.alias("kids"))
        up = node.select(
            "grp", "n", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), "kids",
            F.sha2(F.array_join("kids.digest", ""), 256).alias("digest"),
        )
        below = written(up, "nodes")
        levels.append(below)
    return levels


def _attach(children: DataFrame, parents: DataFrame, level: int) -> DataFrame:
    """`path` for children (grp, lo, hi, ..) at a level below `parents` (grp, lo, hi, kids, path)."""
    size = FAN_OUT ** (level + 1)
    p = parents.select(
        F.col("grp").alias("_g"), F.floor(F.col("lo") / size).alias("_b"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("kids").alias("_kids"), F.col("path").alias("_path")
    )
    c = children.withColumn("_c", F.floor(F.col("lo") / size))
    both = c.join(p, (F.col("grp") == F.col("_g")) & (F.col("_c") == F.col("_b")) & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi")))
    # The parent's interval without the child's own is [_lo, lo) and [hi, _hi).
    side = lambda kept: F.array_join(F.transform(F.filter("_kids", kept), lambda k: k["digest"]), "")
    step = F.struct(side(lambda k: k["hi"] <= F.col("lo")).alias("before"), side(lambda k: k["lo"] >= F.col("hi")).alias("after"))
    return both.select(*children.columns, F.concat(F.array(step), "_path").alias("path"))


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(grp, lo, hi, level, kids, path) of all inner nodes; `tops` (grp, path) says how the groups' tops go on."""
    done: DataFrame | None = None
    above: DataFrame | None = None
    for level in range(len(levels), 0, -1):
        here = levels[level - 1]
        top = here.where(_count(level) == 1).join(tops, "grp").select("grp", "lo", "hi", "kids", "path")
        rest = here.where(_count(level) > 1).select("grp", "lo", "hi", "kids")
        got = top if above is None else top.unionByName(_attach(rest, above, level))
        above = written(got, "paths")
        level_rows = above.withColumn("level", F.lit(level))
        done = level_rows if done is None else done.unionByName(level_rows)
    empty = "grp long, lo long, hi long, kids array<struct<lo:long,hi:long,digest:string>>, path " + PATH + ", level int"
    return done if done is not None else tops.sparkSession.createDataFrame([], empty)


def _tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(grp, top): the digest over all leaves of a group; a lone leaf itself."""
    top = leaves.where("n = 1").select("grp", F.col("leaf").alias("top"))
    for i, level in enumerate(levels):
        top = top.unionByName(level.where(_count(i + 1) == 1).select("grp", F.col("digest").alias("top")))
    return top


def build(rows: DataFrame, group: str, order: Sequence[str], leaf: str = "leaf") -> Manifest:
    """The manifest of `rows`, which hold a `leaf` digest, a group and the columns that order a group's leaves.

    Ties of the order go by leaf digest, so equal rows are leaves of their own and their order does not matter. NULL is a group, the first one, and
    comes first in the order of leaves; groups are ordered bytewise. `rows` should hold keys and digests, not texts: it is sorted.
    """
    ranked = dense_ids(rows, [F.asc_nulls_first(group), *[F.asc_nulls_first(c) for c in order], F.asc(leaf)], "_at")
    ranked = written(ranked, "ranked")
    per = ranked.groupBy(F.col(group).alias("_key")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n"))
    per = written(dense_ids(per, [F.asc_nulls_first("_key")], "grp"), "groups")
    of = small(per, BROADCAST_GROUPS)
    leaves = ranked.join(of, ranked[group].eqNullSafe(of["_key"])).withColumn("rank", F.col("_at") - F.col("_first"))
    leaves = written(leaves.drop("_at", "_first", "_key").withColumnRenamed(leaf, "leaf"), "leaves")
    levels = _forest(leaves.select("grp", "n", "rank", "leaf"))
    tops = written(_tops(leaves, levels), "subroots")
    # The tree over the subroots: one group, ranked as the groups are.
    n_groups = per.count()
    upper_leaves = tops.select(F.lit(0).cast("bigint").alias("grp"), F.lit(n_groups).cast("bigint").alias("n"), F.col("grp").alias("rank"), F.col("top").alias("leaf"))
    upper = _forest(upper_leaves)
    top = _tops(upper_leaves, upper).select(F.col("top").alias("root"))
    end = top.select(F.lit(0).cast("bigint").alias("grp"), F.array().cast(PATH).alias("path"))
    higher = _paths(upper, end)
    subs = tops.select(F.lit(0).cast("bigint").alias("grp"), F.col("grp").alias("lo"), (F.col("grp") + 1).alias("hi"))
    if upper:
        subs = _attach(subs, higher.where("level = 1"), 0)
    else:
        subs = subs.withColumn("path", F.array().cast(PATH))
    subs = written(subs.select(F.col("lo").alias("grp"), "path"), "upper")
    nodes = None
    for i, level in enumerate(levels):
        part = level.withColumn("level", F.lit(i + 1))
        nodes = part if nodes is None else nodes.unionByName(part)
    if nodes is None:
        empty = "grp long, n long, lo long, hi long, kids array<struct<lo:long,hi:long,digest:string>>, digest string, level int"
        nodes = rows.sparkSession.createDataFrame([], empty)
    groups = per.join(tops, "grp").select("grp", F.col("_key").alias(group), "n", F.col("top").alias("subroot"))
    return Manifest(leaves, groups, nodes, _paths(levels, subs), subs, written(top, "root"))


def proofs(m: Manifest) -> DataFrame:
    """The leaves with `path`: their siblings level by level up to the root."""
    cols = m.leaves.columns
    alone = m.leaves.where("n = 1").join(m.upper, "grp").select(*cols, "path")
    many = m.leaves.where("n > 1").withColumn("lo", F.col("rank")).withColumn("hi", F.col("rank") + 1)
    return _attach(many, m.paths.where("level = 1"), 0).select(*cols, "path").unionByName(alone)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda got, s: digest(s["before"], got, s["after"]))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings of a path, in order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(docs: DataFrame, forged_text: Column | None = None, id_col: str = "doc_id", group_col: str = "source", cols: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): one row per row of `docs`.

    `cols` are the leaf's fields in order. `forged_text`, where it is not NULL, is what a copy under audit holds in place of the text: its leaf is folded with
    the siblings of the manifest, and `verified` says whether it leads to the root. NULLs are fields of their own kind, and a NULL `group_col` is
    a group. Repeated ids and rows are leaves of their own, ordered by id (NULL first), then leaf digest. Texts are
    hashed whole, and columns not named are ignored. An empty table gives an empty result.
    """
    leaf = leaf_digest([F.col(c) for c in cols])
    forged = F.lit(None).cast("string")
    if forged_text is not None:
        forged = F.when(forged_text.isNotNull(), leaf_digest([forged_text if c == text_col else F.col(c) for c in cols]))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(group_col).cast("string").alias("source"), leaf.alias("leaf"), forged.alias("forged"))
    # Texts are read and hashed once; sorting reads its input twice.
    m = build(written(rows, "digests"), "source", ["doc_id"])
    p = proofs(m).join(small(m.groups.select("grp", "subroot"), BROADCAST_GROUPS), "grp")
    top = m.top.first()  # one row, or none for an empty table
    p = p.withColumn("root", F.lit(top["root"] if top else None).cast("string"))
    folded = fold(F.coalesce("forged", "leaf"), F.col("path"))
    p = p.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return p.withColumn("verified", F.col("folded_root") == F.col("root"))
