"""Near-duplicate vectors by NN-descent.

Equal vectors are one entry. The first neighbour lists come from ORDERS sorted orders of the entries by random
projections: WINDOW places around an entry. Then rounds of neighbours-of-neighbours joins: all entries that have a neighbour in
common, or are each other's neighbours, are compared if one of them is new there, and whatever is closer than the last of
a full list of K goes in. Rounds end when fewer than SETTLED of all list places change.
Edges at the threshold are confirmed in double precision and joined to components.

A list of K that holds threshold edges only is saturated: its entry has more links than places. Its list is enlarged to
the whole component, compared in blocks of BLOCK, of which a task sees two. So links are counted in full.

Recall is audited entry by entry: entries drawn by a hash, AUDIT at a time, are compared with all entries, until ENOUGH
of them had links, but K at most, or DRAWS times AUDIT are drawn. If of an entry's links less than RECALL stay inside its component, in the mean
over all entries with links or over those with K at most, lists are doubled, other projections added, and the rounds go on.

The search compares 8-bit roundings of the unit vectors; every link that counts is computed in double precision.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import words as W
from corpusloom.llm.store import components, partitions_for, written

K, ORDERS, BITS, WINDOW = 12, 6, 32, 4
SETTLED, ROUNDS = 0.05, 8
BLOCK = 2048
AUDIT, ENOUGH, DRAWS, RECALL = 256, 64, 64, 0.999
SLACK = 0.03  # more than the rounding can change a cosine
ROWS = 100_000
_log = logging.getLogger(__name__)


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unit vectors in double precision, their 8-bit roundings, and a key of the vector as given."""
    for b in batches:
        unit, small, key = [], [], []
        for e in b["embedding"]:
            v = None if e is None else np.asarray(e, np.float64)
            top = np.abs(v).max() if v is not None and len(v) and np.isfinite(v).all() else 0.0
            if not top:
                unit.append(None), small.append(None), key.append(None)
                continue
            # Divided by the largest component first: the squares of very long or short vectors are no finite numbers.
            u = v / top
            u = u / np.linalg.norm(u)
            unit.append(u.tobytes())
            small.append(np.round(u * (127 / np.abs(u).max())).astype(np.int8).tobytes())
            key.append((v + 0.0).tobytes())
        yield pd.DataFrame({"vec_id": b["vec_id"].to_numpy(), "unit": unit, "q": small, "key": key})


def _matrix(col: pd.Series) -> np.ndarray:
    """Rounded vectors as unit rows; shorter ones are filled up with zeros and told apart by their length."""
    width = max(len(x) for x in col)
    m = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in col), np.int8).reshape(len(col), width).astype(np.float32)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def _lengths(col: pd.Series) -> np.ndarray:
    return np.fromiter((len(x) for x in col), np.int64, len(col))


_EDGE = "u long, v long, s float"


def _both(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"u": np.concatenate([a, b]), "v": np.concatenate([b, a]), "s": np.concatenate([s, s]).astype(np.float32)})


def _first_lists(entries: DataFrame, count: int, first: int, orders: int) -> DataFrame:
    """Edges between near places of sorted orders. The order's key is BITS signs of random projections."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = _matrix(b["q"])
            for t in range(first, first + orders):
                r = W.stream(1000 + t, m.shape[1] * BITS)
                plane = (r >> np.uint64(11)).astype(np.float64).reshape(m.shape[1], BITS) / (1 << 52) - 1
                code = np.packbits(m @ plane > 0, axis=1)
                yield pd.DataFrame({"key": [bytes([t % 256]) + c.tobytes() for c in code], "id": b["id"], "q": b["q"]})

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        b = pd.concat(parts, ignore_index=True)
        order, m, n, i = np.array([k[0] for k in b["key"]]), _matrix(b["q"]), _lengths(b["q"]), b["id"].to_numpy()
        for d in range(1, WINDOW + 1):
            ok = np.flatnonzero((order[d:] == order[:-d]) & (n[d:] == n[:-d]))
            yield _both(i[ok], i[ok + d], (m[ok] * m[ok + d]).sum(1))

    rows = entries.select("id", "q").mapInPandas(keyed, "key binary, id long, q binary")
    # The id makes the sort key unique, so equal codes of any number spread over tasks.
    rows = rows.repartitionByRange(partitions_for(entries, count * orders, ROWS), "key", "id").sortWithinPartitions("key", "id")
    return rows.mapInPandas(near, _EDGE)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k closest of every list; an edge keeps the round in which it came."""
    once = edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("came").alias("came"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    return once.withColumn("place", place).where(F.col("place") <= k)


def _join_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compare the entries that meet at `w`, in rows sorted by w."""

    rest: pd.DataFrame | None = None

    def run(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(b):
            return
        w, x, new, bar = b["w"].to_numpy(), b["x"].to_numpy(), b["fresh"].to_numpy(), b["bar"].to_numpy()
        m, n = _matrix(b["q"]), _lengths(b["q"])
        cut = np.concatenate([[0], np.flatnonzero(w[1:] != w[:-1]) + 1, [len(w)]])
        us, vs, sims = [], [], []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            f = new[lo:hi]
            if not f.any():
                continue
            g, low = m[lo:hi], bar[lo:hi]
            s = np.where((f[:, None] | f[None]) & (n[lo:hi, None] == n[None, lo:hi]), g @ g.T, -3.0)
            np.fill_diagonal(s, -3.0)
            to, of = np.nonzero(s > low[:, None])  # closer than the last of the list of `to`
            us.append(x[lo + to]), vs.append(x[lo + of]), sims.append(s[to, of])
        if us:
            got = pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs), "s": np.concatenate(sims)})
            yield got.drop_duplicates(["u", "v"])

    for b in batches:
        if not len(b):
            continue
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        last = b["w"].iloc[-1]
        yield from run(b[b["w"] != last])
        rest = b[b["w"] == last]
    if rest is not None:
        yield from run(rest)


def _round(graph: DataFrame, entries: DataFrame, k: int, now: int) -> DataFrame:
    """Candidates of one round: neighbours of neighbours that are closer than the last of a full list."""
    bars = graph.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"))
    known = entries.select("id", "q").join(bars, entries["id"] == bars["u"], "left").select(
        F.col("id").alias("x"), "q", F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(-2.0)).cast("float").alias("bar")
    )
    fresh = (F.col("came") == now - 1).alias("fresh")
    out = graph.select(F.col("u").alias("w"), F.col("v").alias("x"), fresh)
    # An entry that is in very many lists takes part with about 2 * k of them, others in every round.
    times = graph.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("u", "v", F.lit(now)), F.lit(1_000_000))
    back = graph.join(times, "v").where(draw < F.lit(2_000_000 * k) / F.col("n")).select(F.col("v").alias("w"), F.col("u").alias("x"), fresh)
    own = graph.groupBy("u").agg(F.max(F.col("came") == now - 1).alias("fresh")).select(F.col("u").alias("w"), F.col("u").alias("x"), F.lit(False).alias("fresh"))
    met = out.unionByName(back).unionByName(own).groupBy("w", "x").agg(F.max("fresh").alias("fresh")).join(known, "x")
    return met.repartition("w").sortWithinPartitions("w").mapInPandas(_join_lists, _EDGE)


def _confirm(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (lx, ly), g in b.groupby([b["x"].map(len), b["y"].map(len)]):
                if lx == ly:
                    x, y = (np.frombuffer(b"".join(g[c])).reshape(len(g), -1) for c in ("x", "y"))
                    yield g.loc[np.einsum("ij,ij->i", x, y) >= threshold, ["a", "b"]]

    return run


def _exact_edges(graph: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    near = graph.where(F.col("s") >= threshold - SLACK).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    x = entries.select(F.col("id").alias("a"), F.col("unit").alias("x"))
    y = entries.select(F.col("id").alias("b"), F.col("unit").alias("y"))
    return written(near.join(x, "a").join(y, "b").mapInPandas(_confirm(threshold), "a long, b long"), "edges")


def _recall(entries: DataFrame, named: DataFrame, threshold: float, count: int) -> tuple[float, float, int]:
    """The mean share of an audited entry's true links that stay inside its component, over the entries with links
    and over those with K links at most, and how many of the latter were seen. A share of no entries is 1."""
    rows = entries.select("id", "unit").join(named, "id", "left").select("id", "unit", F.coalesce("component", "id").alias("c"))
    buckets = max(1, count // AUDIT)
    bucket = F.pmod(F.xxhash64("id", F.lit(41)), F.lit(buckets))
    last, at, step = min(buckets, DRAWS), 0, 1
    n_all = n_few = 0
    all_ = few = 0.0
    while at < last and n_few < ENOUGH:
        to = min(at + step, last)
        drawn = rows.where((bucket >= at) & (bucket < to)).toPandas()  # about AUDIT rows for each bucket
        units = [(g["id"].to_numpy(), g["c"].to_numpy(), np.frombuffer(b"".join(g["unit"])).reshape(len(g), -1)) for _, g in drawn.groupby(drawn["unit"].map(len))]

        def run(batches: Iterator[pd.DataFrame], units: list = units) -> Iterator[pd.DataFrame]:
            for b in batches:
                for _, g in b.groupby(b["unit"].map(len)):
                    ids, names = g["id"].to_numpy(), g["c"].to_numpy()
                    m = np.frombuffer(b"".join(g["unit"])).reshape(len(g), -1)
                    for i, c, x in units:
                        if x.shape[1] != m.shape[1]:
                            continue
                        for lo in range(0, len(i), AUDIT):
                            part = slice(lo, lo + AUDIT)
                            link = (x[part] @ m.T >= threshold) & (i[part, None] != ids[None])
                            true, found = link.sum(1), (link & (c[part, None] == names[None])).sum(1)
                            yield pd.DataFrame({"id": i[part], "t": true, "f": found})[true > 0]

        each = rows.mapInPandas(run, "id long, t long, f long").groupBy("id").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
        share, small_ = F.col("f") / F.col("t"), F.col("t") <= K
        got = each.agg(F.count(F.lit(1)), F.sum(share), F.count(F.when(small_, 1)), F.sum(F.when(small_, share))).first()  # four numbers
        n_all, all_, n_few, few = n_all + got[0], all_ + (got[1] or 0.0), n_few + got[2], few + (got[3] or 0.0)
        at, step = to, min(2 * step, 8)
    return (all_ / n_all if n_all else 1.0), (few / n_few if n_few else 1.0), n_few


def _count_links(threshold: float):
    """Links of the members of one cell (a pair of blocks of a component), counted with the copies of each entry."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        i, j = g["i"].iloc[0], g["j"].iloc[0]
        a, b = g[g["block"] == i], g[g["block"] == j]
        rows = []
        for n in set(a["unit"].map(len)) & set(b["unit"].map(len)):
            x, y = a[a["unit"].map(len) == n], b[b["unit"].map(len) == n]
            s = np.frombuffer(b"".join(x["unit"])).reshape(len(x), -1) @ np.frombuffer(b"".join(y["unit"])).reshape(len(y), -1).T
            link = (s >= threshold) & (x["id"].to_numpy()[:, None] != y["id"].to_numpy()[None])
            rows.append(pd.DataFrame({"id": x["id"], "links": link @ y["copies"].to_numpy()}))
            if i != j:
                rows.append(pd.DataFrame({"id": y["id"], "links": x["copies"].to_numpy() @ link}))
        return pd.concat(rows) if rows else pd.DataFrame({"id": [], "links": []})

    return run


def _links(entries: DataFrame, named: DataFrame, threshold: float) -> DataFrame:
    """(id, links): links of every entry that has a component, over the whole component."""
    sizes = named.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    m = named.join(sizes, "component").join(entries.select("id", "unit", "copies"), "id")
    m = m.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = m.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    got = cells.groupBy("component", "i", "j").applyInPandas(_count_links(threshold), "id long, links long")
    return got.groupBy("id").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of `vectors`.

    Vectors are linked when their cosine is at least `threshold`; of a found component all links are counted.
    `component_id` is the smallest id reachable over links, `kept` is true for the row that has it. Vectors that are
    NULL, empty, zero or hold NULL or non-finite components are linked with nothing, and so are rows with a NULL id,
    whose component is NULL and who are kept. Vectors of different lengths are not linked. Equal vectors are linked with each other; rows that repeat an
    id are vectors of their own under one id. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = written(rows.mapInPandas(_clean, "vec_id long, unit binary, q binary, key binary").withColumn("digest", F.sha2("key", 256)).drop("key"), "vectors")
    usable = rows.where("unit is not null and vec_id is not null")
    entries = usable.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("unit").alias("unit"), F.max("q").alias("q"))
    owners = written(entries, "owners")
    # Different vectors under one smallest id: one of them stands for the id, all count as linked with it.
    entries = owners.dropDuplicates(["id"])
    count = entries.count()
    k, now, orders = K, 0, 0
    graph = None
    named = None
    while True:
        start = _first_lists(entries, count, orders, ORDERS).withColumn("came", F.lit(now))
        orders += ORDERS
        graph = written(_best(start if graph is None else graph.drop("place").unionByName(start), k), "graph")
        for _ in range(ROUNDS):
            now += 1
            better = _round(graph, entries, k, now).withColumn("came", F.lit(now))
            graph = written(_best(graph.drop("place").unionByName(better), k), "graph")
            if graph.where(F.col("came") == now).count() <= SETTLED * k * max(count, 1):
                break
        named = components(_exact_edges(graph, entries, threshold))
        if count <= 2 * k:
            break
        share, few, seen = _recall(entries, named, threshold, count)
        _log.info("lists of %d: mean recall %.4f, %.4f over %d entries with %d links at most", k, share, few, seen, K)
        if min(share, few) >= RECALL:
            break
        k, now = 2 * k, now + 1
    links = _links(entries, named, threshold)
    per = owners.select("digest", "id", "copies").join(named, "id", "left").join(links, "id", "left")
    per = per.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("vec_id", F.when(F.col("unit").isNotNull() & F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(per, "digest", "left")
    own = F.when(F.col("vec_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
