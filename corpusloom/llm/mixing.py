"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken target / source size times. The whole part is certain; the fraction left is
a copy probability. Probabilities are rounded in pairs: words move from one document of the pair to the other, a
random one of the two directions, until one of them has probability 0 or 1. The directions are weighted so that no
probability changes in expectation, and since words move, not probabilities, the expected words of the pair
stay what they are at every step: whatever is drawn, the words taken of a source differ from its target by
rounding of less than one word. For that the last document of a source left with a fraction gives that fraction of its words.

The pairs form a reduction tree: blocks of at most BLOCK documents of a source are rounded in tasks of their own, each
leaves at most one fractional document, and these are rounded in the same way on the next level. Draws depend on the
documents and the seed alone, so reruns agree however the rows are dealt.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import words as W
from corpusloom.llm.store import written
from corpusloom.operators.skew import dense_ids, small

BLOCK = 4096
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5  # words of the mix over words of the input
MOST = 2.0  # times a source's words
BROADCAST_SOURCES = 100_000


def _size():
    return F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+"), "")).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, NULL last, have the weights in turn. A target over `most` times its source's size is
    cut to that, and the excess goes to the others by weight, until none is above.
    """
    ranked = dense_ids(sizes, [F.asc_nulls_last("source")], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = written(ranked.select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap")), "sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, last = 0.0, -1.0
    while level != last:  # the level only rises, and with every round at least one more source is cut
        last = level
        cut = F.col("cap") < F.col("w") * last
        got = s.agg(F.sum(F.when(cut, F.col("cap"))).alias("c"), F.sum(F.when(~cut, F.col("w"))).alias("w")).first()  # two numbers
        level = max(last, (share * total - (got["c"] or 0.0)) / got["w"]) if got["w"] else last
    return s.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def _pivot(seed: int):
    def run(b: pd.DataFrame) -> pd.DataFrame:
        # Large documents first, so that the one left over at the end is a small one when there are small ones.
        b = b.sort_values(["size", "draw", "p"], ascending=[False, True, True], ignore_index=True)
        p, size = b["p"].tolist(), b["size"].tolist()
        draws = W.mix(b["draw"].to_numpy().astype(np.uint64) + W.stream(seed, 1)[0])
        u = (draws >> np.uint64(11)).astype(float) / (1 << 53)
        at = None
        for j in range(len(p)):
            if not 0.0 < p[j] < 1.0:
                continue
            if at is None:
                at = j
                continue
            i, v, w = at, size[at], size[j]
            up, down = min(v * (1 - p[i]), w * p[j]), min(v * p[i], w * (1 - p[j]))
            if u[j] * (up + down) < down:  # words go from j to i
                full, empty, moved = i, j, up
            else:
                full, empty, moved = j, i, down
            a, z = size[full] * (1 - p[full]), size[empty] * p[empty]
            p[full] = 1.0 if a <= moved else p[full] + moved / size[full]
            p[empty] = 0.0 if z <= moved else p[empty] - moved / size[empty]
            left = [k for k in (i, j) if 0.0 < p[k] < 1.0]
            at = left[0] if left else None
        return b.assign(p=p)

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per row of `docs`.

    `size` counts the words of the text (NULL: 0). `taken` is the words the mix takes of the document, repeats
    counted: copies * size, but for the one document of a source that ends with a fraction and gives a part of its words more.
    It never exceeds ceil(target / source_size) * size. Rows with a NULL source form a source, the last in order. Documents
    without words are taken 0 times. Rows that repeat are rows of their own; of equal ones it does not matter which is taken.
    Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    d = written(d.select("doc_id", "source", _size().alias("size")), "sizes")
    per = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    per = written(per, "per_source")
    t = targets(per.select("source", "source_size"), weights, share, most)
    t = t.join(per.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    t = written(t, "targets")
    rows = d.withColumnRenamed("source", "_s").join(small(t, BROADCAST_SOURCES), F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("base", F.floor(times)).withColumn("p", times - F.floor(times))
    rows = rows.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "size"))
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    done = rows.where(~open_).withColumn("p", F.lit(0.0))
    left = rows.where(open_)
    most_rows = per.agg(F.max("n")).first()[0] or 0  # one number
    shape, level, parts = left.schema, 0, []
    width = most_rows
    while True:
        # As many blocks as the rows of the source need; from the second level on, n counts the blocks before.
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1))
        left = left.withColumn("n", blocks.cast("bigint")).withColumn("block", F.pmod(F.xxhash64("draw", F.lit(level)), F.col("n")))
        out = left.groupBy("source", "block").applyInPandas(_pivot(seed + level), left.select(*[c.name for c in shape], "block").schema)
        out = written(out.drop("block").select(*[c.name for c in shape]), "rounded")
        width, level = -(-width // BLOCK), level + 1
        if width <= 1:
            parts.append(out)
            break
        parts.append(out.where("p = 0 or p = 1"))
        left = out.where("p > 0 and p < 1")
    for part in parts:
        done = done.unionByName(part)
    whole = F.col("base") + F.floor("p")
    part = F.round((F.col("p") - F.floor("p")) * F.col("size"))
    return done.select(
        "doc_id", "source", "size", "source_size", "target", whole.cast("int").alias("copies"),
        (whole * F.col("size") + part).cast("bigint").alias("taken"),
    )
