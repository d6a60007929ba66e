"""MinHash near-duplicates by an LSH forest.

Every text gets ORDERS * STEP MinHash values over its distinct word shingles. Tree t sorts all texts by the values
from number STEP * t on, DEPTH of them; the values that a text shares with its neighbours in that order, up to the
first difference, are their longest common prefix.

1. Neighbours in the first FIRST orders with a common prefix of LEAST values or more are candidates. They are confirmed on the
   full sets and joined to components. Nothing is paired within a group: a text has one neighbour on each side.
2. The orders are cut into regions with a common prefix. A region of more than REGION texts goes one value deeper,
   until it is small enough or the order is used up, so the depth follows the density of the region. Texts of one
   region that are still in different components are candidates, and confirmed in the same way. A region still
   larger when its order is used up has every text outside its largest component compared with all its texts.

Equal sets are one entry from the start, so groups of copies cost one entry each.

Chance of missing a pair of similarity s in a sparse region: (1 - s**LEAST)**ORDERS, 3e-8 for s = 0.8.
In a dense region a pair needs a longer prefix in common, but there its texts have many partners. The sketch
comparison in front of the confirmation (4 bits of each value, 5 standard deviations below the threshold) drops a pair of
similarity 0.8 with a chance below 1e-6. Confirmed links are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import words as W
from corpusloom.llm.store import components, partitions_for, written
from corpusloom.operators.skew import small

ORDERS, STEP, DEPTH, LEAST, REGION = 24, 4, 16, 3, 256
# Orders whose neighbours make the first links.
FIRST = 8
# Entries of a block of the confirmation (few of them have candidates), and the least number of blocks.
BLOCK, BLOCKS = 20_000, 8
VALUES = ORDERS * STEP
# Rows of the sorted orders that one task holds, about 20 MB.
ROWS = 100_000
# Pairs whose sketches are compared at once.
PAIRS = 16_384
# Ids a broadcast may hold (16 bytes each); beyond that a shuffled join is used.
BROADCAST_IDS = 1_000_000
_MULTIPLY, _ADD = W.stream(5, VALUES) | np.uint64(1), W.stream(6, VALUES)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _values(s: np.ndarray) -> np.ndarray:
    """MinHash values of a set, 8 bits each; taken in pieces so that long sets need no more memory."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        np.minimum(low, (s[None, at : at + 4096] * _MULTIPLY[:, None] + _ADD[:, None]).min(1), out=low)
    return (W.mix(low) >> np.uint64(56)).astype(np.uint8)


def _sketch(values: np.ndarray) -> bytes:
    """The low 4 bits of every value."""
    return ((values[0::2] & 15) << 4 | (values[1::2] & 15)).tobytes()


def _sets(texts, width: int) -> Iterator[np.ndarray]:
    for part in W.slices(texts):
        h, o = W.word_hashes(texts[part])
        h, o = W.shingle_hashes(h, o, width)
        for a, b in zip(o[:-1], o[1:], strict=True):
            yield np.unique(h[a:b])


def _describe(width: int, full: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["digest", "members"] if full else ["n", "digest", "vals", "sketch"]
        for b in batches:
            texts = b["text"].tolist()
            # By pieces of the batch: what is sent on does not wait for all of its rows.
            for part in W.slices(texts):
                out: list[tuple] = []
                for s in _sets(texts[part], width):
                    if full:
                        out.append((_digest(s), s.tobytes()))
                    elif len(s):
                        v = _values(s)
                        out.append((len(s), _digest(s), v.tobytes(), _sketch(v)))
                    else:
                        out.append((0, None, None, None))
                got = pd.DataFrame(out, columns=names)
                if not full:
                    got.insert(0, "doc_id", b["doc_id"].to_numpy()[part])
                yield got

    return run


_DESCRIBED = "n long, digest binary, vals binary, sketch binary"


def _pairs_in(keys: np.ndarray, sizes: np.ndarray, sk: np.ndarray, group: np.ndarray | None, percent: int) -> np.ndarray:
    """Candidate pairs (row, row) of one sorted run of rows.

    Without `group` only neighbours are compared; with it, all rows of a region that are in different groups.
    """
    n = len(keys)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    same = np.cumprod(keys[1:] == keys[:-1], axis=1, dtype=np.int8).sum(1) - 1  # the first column is the order's number
    p = percent / 100 + (1 - percent / 100) / 16  # chance of equal sketch values at the threshold
    need = VALUES * p - 5 * np.sqrt(VALUES * p * (1 - p))

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([near(a[i : i + PAIRS], b[i : i + PAIRS]) for i in range(0, max(len(a), 1), PAIRS)])

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lo, hi = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        ok = 100 * lo >= percent * hi  # sets whose sizes differ more cannot reach the threshold
        a, b = a[ok], b[ok]
        x = sk[a] ^ sk[b]
        x |= x >> np.uint64(2)
        differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x1111111111111111)).sum(1)
        ok = VALUES - differ >= need
        return np.stack([a[ok], b[ok]], 1)

    if group is None:
        at = np.flatnonzero(same >= LEAST)
        return close(at, at + 1)
    depth = np.full(n, LEAST)
    while True:
        cut = np.concatenate(([True], same < np.maximum(depth[1:], depth[:-1])))
        region = np.cumsum(cut) - 1
        count = np.bincount(region)
        deeper = (count[region] > REGION) & (depth < DEPTH)
        if not deeper.any():
            break
        depth[deeper] += 1
    out = []
    for step in range(1, min(REGION, n)):
        at = np.flatnonzero((region[step:] == region[:-step]) & (group[step:] != group[:-step]))
        if len(at):
            out.append(close(at, at + step))
    for r in np.flatnonzero(count > REGION):
        rows = np.flatnonzero(region == r)
        names, where, many = np.unique(group[rows], return_inverse=True, return_counts=True)
        for a in rows[where != np.argmax(many)] if len(names) > 1 else ():
            out.append(close(np.full(len(rows), a), rows))
    found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return found[group[found[:, 0]] != group[found[:, 1]]]


def _by_cell(d: np.ndarray, p: np.ndarray, blocks: int) -> pd.DataFrame:
    """Pairs (row, row) as one row for each cell, a pair of blocks: the pairs' digests end to end, and all of them once."""
    name = {i: d[i].tobytes() for i in np.unique(p).tolist()}
    block = {i: int.from_bytes(x[:8], "little") % blocks for i, x in name.items()}
    pairs = {(name[i], name[j]) if name[i] < name[j] else (name[j], name[i]): (block[i], block[j]) for i, j in p.tolist()}
    cells: dict[int, list[tuple[bytes, bytes]]] = {}
    for pair, (i, j) in pairs.items():
        cells.setdefault(int(min(i, j) * blocks + max(i, j)), []).append(pair)
    rows = [(c, b"".join(x for pair in v for x in pair), sorted({x for pair in v for x in pair})) for c, v in cells.items()]
    return pd.DataFrame(rows, columns=["cell", "pairs", "members"])


_CELL = "cell long, pairs binary, members array<binary>"


def _candidates(percent: int, grouped: bool, edge: bool, blocks: int):
    """Pairs of a sorted partition; its first and last rows go out too, to be compared across the cut."""

    def arrays(b: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """Keys, digests, sizes, sketches and groups: numbers, a fraction of the Python objects of a batch."""
        keys = np.frombuffer(b"".join(b["key"]), np.uint8).reshape(len(b), DEPTH + 1)
        digest = np.frombuffer(b"".join(b["digest"]), np.uint8).reshape(len(b), 16)
        sk = np.frombuffer(b"".join(b["sketch"]), np.uint64).reshape(len(b), VALUES // 16)
        return keys, digest, b["n"].to_numpy(), sk, b["grp"].to_numpy() if grouped else np.zeros(len(b), np.int64)

    def frame(rows: tuple[np.ndarray, ...], part) -> pd.DataFrame:
        keys, digest, sizes, sk, group = rows
        got = _by_cell(digest, _pairs_in(keys, sizes, sk, group if grouped else None, percent), blocks)
        if edge:
            return got
        # Only rows with the prefix of the partition's first or last row can have partners beyond the cut.
        reach = REGION if grouped else 1
        head, tail = ((keys[:, : LEAST + 1] == keys[at, : LEAST + 1]).all(1) for at in (0, -1))
        head[reach:] = False
        tail[:-reach] = False
        ends = []
        for at, cut in ((np.flatnonzero(head), part), (np.flatnonzero(tail), part + 1)):
            raw = {"key": [x.tobytes() for x in keys[at]], "digest": [x.tobytes() for x in digest[at]], "n": sizes[at], "sketch": [x.tobytes() for x in sk[at]]}
            ends.append(pd.DataFrame(raw | {"grp": group[at] if grouped else None, "cut": cut}))
        out = pd.concat([got, *ends], ignore_index=True).reindex(columns=["cell", "pairs", "members", "key", "digest", "n", "sketch", "grp", "cut"])
        return out.assign(members=out["members"].astype(object).where(out["members"].notna(), None))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [arrays(b) for b in batches if len(b)]
        if parts:
            rows = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            yield frame(rows, TaskContext.get().partitionId())

    def across(b: pd.DataFrame) -> pd.DataFrame:
        return frame(arrays(b.sort_values(["key", "digest"], ignore_index=True)), None)

    return across if edge else whole


def _sorted_pairs(entries: DataFrame, count: int, percent: int, grouped: bool, orders: int) -> DataFrame:
    """Candidate pairs of digests from the first `orders` orders, by cell."""
    t = F.explode(F.sequence(F.lit(0), F.lit(orders - 1)))
    rows = entries.withColumn("t", t).select(
        F.concat(F.unhex(F.lpad(F.hex("t"), 2, "0")), F.substring(F.concat("vals", "vals"), F.col("t") * STEP + 1, F.lit(DEPTH))).alias("key"),
        "digest", "n", "sketch", "grp",
    )
    blocks = max(BLOCKS, -(-count // BLOCK))
    # The digest makes the sort key unique, so equal prefixes of any number spread over tasks.
    spread = rows.repartitionByRange(partitions_for(entries, count * orders, ROWS), "key", "digest").sortWithinPartitions("key", "digest")
    shape = _CELL + ", key binary, digest binary, n long, sketch binary, grp long, cut int"
    got = written(spread.mapInPandas(_candidates(percent, grouped, False, blocks), shape), "forest")
    # At most 2 * REGION rows for each cut between tasks.
    ends = got.where("cut is not null").drop("cell", "pairs", "members")
    seams = written(ends.groupBy("cut").applyInPandas(_candidates(percent, grouped, True, blocks), _CELL), "seams")
    return got.where("cut is null").select("cell", "pairs", "members").unionByName(seams)


def _confirm(percent: int):
    def run(cells: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        sets = {d: np.frombuffer(m, np.uint64) for d, m in zip(members["digest"], members["members"], strict=True)}
        pairs = {(raw[i : i + 16], raw[i + 16 : i + 32]) for raw in map(bytes, cells["pairs"]) for i in range(0, len(raw), 32)}
        keep = []
        for a, b in pairs:
            x, y = sets[a], sets[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                keep.append((a, b))
        return pd.DataFrame(keep, columns=["a", "b"])

    return run


def _confirmed(cells: DataFrame, docs: DataFrame, owners: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of entry ids: the pairs whose full shingle sets reach the threshold.

    Entries are hashed to blocks; a cell is a pair of blocks and confirms the pairs between them. A set is sent once
    to every cell that has a pair with it, not once for every pair.
    """
    wants = cells.select("cell", F.explode("members").alias("digest")).distinct()
    need = written(owners.join(wants.select("digest").distinct(), "digest"), "need")
    texts = docs.join(small(need.select(F.col("id").alias("doc_id")).distinct(), BROADCAST_IDS), "doc_id", "left_semi")
    sets = texts.select("text").mapInPandas(_describe(width, True), "digest binary, members binary")
    # A doc_id that repeats with another text brings sets nobody asked for; a text that repeats comes once.
    sets = written(sets.join(small(need.select("digest"), BROADCAST_IDS), "digest", "left_semi").dropDuplicates(["digest"]), "sets")
    sent = wants.join(sets, "digest").select(F.col("cell").alias("to_cell"), "digest", "members")
    links = cells.select("cell", "pairs").groupBy("cell").cogroup(sent.groupBy("to_cell")).applyInPandas(_confirm(percent), "a binary, b binary")
    ids = small(need.select("digest", "id"), BROADCAST_IDS)
    links = links.join(ids.withColumnsRenamed({"digest": "a", "id": "ia"}), "a").join(ids.withColumnsRenamed({"digest": "b", "id": "ib"}), "b")
    return links.select(F.col("ia").alias("a"), F.col("ib").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of `docs`.

    Two rows are linked when 100 * shared shingles >= percent * shingles of both together. `component_id` is the
    smallest id reachable over links, `kept` is true for the row that has it.
    A NULL or word-free text has no shingles and is linked with nothing. Rows with a NULL id are linked with nothing,
    have a NULL component and are kept. Rows that repeat an id each have the component of their own text. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = written(docs.mapInPandas(_describe(width, False), "doc_id long, " + _DESCRIBED), "described")
    with_id = seen.where("n > 0 and doc_id is not null")
    entries = with_id.groupBy("digest").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.max("vals").alias("vals"), F.max("sketch").alias("sketch"))
    entries = written(entries, "entries")
    count, owners = entries.count(), entries.select("digest", "id")
    first = _sorted_pairs(entries.withColumn("grp", F.lit(None).cast("bigint")), count, percent, False, FIRST)
    links = written(_confirmed(first, docs, owners, width, percent), "links")
    named = components(links)
    grouped = written(entries.join(named.withColumnRenamed("component", "grp"), "id", "left").withColumn("grp", F.coalesce("grp", "id")), "grouped")
    # Second, all orders, between the components so far.
    second = _sorted_pairs(grouped, count, percent, True, ORDERS)
    more = _confirmed(second, docs, owners, width, percent)
    # Only links between the components so far are left to follow.
    own = lambda c: more.join(named.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")), c, "left")
    more = own("a").withColumn("a", F.coalesce("ca", "a"))
    more = own("b").select("a", F.coalesce("cb", "b").alias("b"))
    merged = components(more)
    of = grouped.select("digest", F.col("grp").alias("id")).join(merged, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = seen.join(of, "digest", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
