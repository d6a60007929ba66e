"""Which titles of a table stand in which texts of another, wherever they start.

Every title has two hashes: one of its first `g` characters, `g` being the greatest power of two that is not above its length, and one made from
that and the hash of its last `g` characters. A text is read once; the windows of 1, 2, 4, ... characters at all its places get the same
hashes, and a filter of a fixed greatest size says which windows can begin a title and then, for the lengths that titles
have, which stretches can be one. Only these leave the text, as strings, once for each text with their first place, and meet the titles in
an equi join. What is found is exact. A title is lost only where a different stretch before it in the same megabyte of its text has the
same 64-bit hash: less than one in 10**7 batches of texts has such a pair at all.

Neither texts nor titles pass through the driver, and no title list is sent around. Equal texts are one text until the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import skew
from corpusloom.session import stable

# Bits of the filter: so many for each title, and at least and at most these, whatever the number of titles.
BITS_PER_TITLE = 64
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
PROBES = 3
# Characters a task looks at together; a longer text is cut into overlapping parts.
PART = 1 << 19

_U = np.uint64
_WORD = 1 << 15  # bits of one bitmap of the aggregate


def text_key(text: Column) -> Column:
    """Equal for equal texts: rows are matched back by it, as ids may be NULL or repeat."""
    return F.unhex(F.sha2(text, 256))


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _windows(text: str, classes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(g, hashes of the g characters from each place on) for every wanted power of two `g`, ascending."""
    h = _stir(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U) + _U(1))
    g = 1
    while len(h) and g <= classes[-1]:
        if g in classes:
            yield g, h
        h = _stir(h[: max(len(h) - g, 0)] * _U(0x9E3779B97F4A7C15) + h[g:])
        g *= 2


def _whole(first: np.ndarray, last: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """Hashes of stretches of `n` characters from those of their first and last windows."""
    return _stir(first * _U(0xC2B2AE3D27D4EB4F) + last + np.asarray(n, _U))


def _spots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    step = (h >> _U(32)) | _U(1)
    return [((h + _U(k) * step) & _U(bits - 1)).astype(np.int64) for k in range(PROBES)]


def _known(filter_: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Indexes of the hashes that the filter may hold."""
    at = None
    for k in range(PROBES):
        x = h if at is None else h[at]
        spot = ((x + _U(k) * ((x >> _U(32)) | _U(1)) if k else x) & _U(bits - 1)).view(np.int64)
        hit = np.flatnonzero((filter_[spot >> 3] >> (spot & 7).astype(np.uint8)) & np.uint8(1))
        at = hit if at is None else at[hit]
    return at


def _class(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def _title_spots(titles: DataFrame, bits: int) -> DataFrame:
    """(spots): the places of each title in the filter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = b["title"].tolist()
            n = np.array([len(t) for t in names], np.int64)
            begin = np.cumsum(n) - n
            g_of = np.array([_class(k) for k in n.tolist()], np.int64)
            out = np.zeros((len(names), 2 * PROBES), np.int64)
            for g, h in _windows("".join(names), sorted(set(g_of.tolist()))):
                these = np.flatnonzero(g_of == g)
                first, last = h[begin[these]], h[begin[these] + n[these] - g]
                for k, spot in enumerate(_spots(first, bits) + _spots(_whole(first, last, n[these]), bits)):
                    out[these, k] = spot
            yield pd.DataFrame({"spots": list(out)})

    return titles.mapInPandas(run, "spots array<long>")


def _filter(spots: DataFrame, bits: int) -> np.ndarray:
    """The filter's bytes, from (s): the bits that are set."""
    s = spots.select((F.col("s") + 1).alias("s"))
    maps = s.groupBy(F.bitmap_bucket_number("s").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in maps.toLocalIterator():  # at most MOST_BITS / 32768 rows of 4096 bytes
        out[(r["at"] - 1) * _WORD // 8 : r["at"] * _WORD // 8] = np.frombuffer(r["m"], np.uint8)
    return out


def _parts(texts: list[str], reach: int) -> Iterator[list[tuple[int, int, int, str]]]:
    """Batches of (row, offset, own characters, characters) of about PART characters; what starts in a part's own characters ends in its characters."""
    batch, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), PART):
            own = min(PART, len(t) - at)
            batch.append((i, at, own, t[at : at + own + reach]))
            size += len(batch[-1][3])
            if size >= PART:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def _hits(bits: Broadcast, n_bits: int, lengths: list[int]):
    classes = sorted({_class(n) for n in lengths})
    of_class = {g: [n for n in lengths if _class(n) == g] for g in classes}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = bits.value
        for b in batches:
            texts, owner = b["text"].tolist(), b["_t"].tolist()
            for batch in _parts(texts, lengths[-1]):
                whole = "".join(p[3] for p in batch)
                begin = np.cumsum([0] + [len(p[3]) for p in batch])
                row, offset, own = (np.array([p[k] for p in batch]) for k in range(3))
                found: list[tuple[bytes, str, int]] = []
                for g, h in _windows(whole, classes):
                    at = _known(known, h, n_bits)
                    part = np.searchsorted(begin, at, side="right") - 1
                    mine = at < begin[part] + own[part]
                    at, part = at[mine], part[mine]
                    room = begin[part + 1] - at
                    for n in of_class[g]:
                        fits = np.flatnonzero(room >= n)
                        hashes = _whole(h[at[fits]], h[at[fits] + (n - g)], n)
                        hit = _known(known, hashes, n_bits)
                        # The first of equal stretches of a text, told by their hashes and the text.
                        same = pd.Series(_stir(hashes[hit] + row[part[fits[hit]]].astype(_U) * _U(0x9E3779B97F4A7C15))).duplicated().to_numpy()
                        for place, k in zip(at[fits[hit[~same]]].tolist(), part[fits[hit[~same]]].tolist(), strict=True):
                            found.append((owner[row[k]], whole[place : place + n], int(offset[k]) + place - int(begin[k])))
                if found:
                    yield pd.DataFrame(found, columns=["_t", "title", "at"])

    return run


def first_places(texts: DataFrame, titles: DataFrame, text_col: str = "text", title_col: str = "title", hot: int = skew.GROUP_LIMIT) -> DataFrame:
    """(_t, title, at, other columns of `titles`): for every different text (`_t` is its `text_key`) and every title that stands in it, the
    first place, 0-based, in characters, once for each row of the title.

    Case counts. NULL and empty titles and texts match nothing; a title should have few rows. Titles found in more than `hot` texts are
    dealt over several tasks. `titles` is read more than once, so it should be a table or a checkpoint.
    """
    spark = texts.sparkSession
    named = titles.withColumn(title_col, F.col(title_col).cast("string")).withColumnRenamed(title_col, "title").where("title <> ''")
    names = named.select("title").distinct()
    per_length = names.groupBy(F.length("title").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()  # as many rows as the longest title has characters, at most
    if not per_length:
        return named.withColumn("_t", F.lit(None).cast("binary")).withColumn("at", F.lit(None).cast("int")).select("_t", "title", "at", *[c for c in named.columns if c != "title"]).limit(0)
    bits = min(max(1 << (sum(r["c"] for r in per_length) * BITS_PER_TITLE).bit_length(), LEAST_BITS), MOST_BITS)
    known = _filter(_title_spots(names, bits).select(F.explode("spots").alias("s")), bits)
    t = texts.select(F.col(text_col).cast("string").alias("text")).where("text <> ''").select(text_key(F.col("text")).alias("_t"), "text")
    found = t.mapInPandas(_hits(spark.sparkContext.broadcast(known), bits, sorted(r["n"] for r in per_length)), "_t binary, title string, at int")
    firsts = stable(found.groupBy("_t", "title").agg(F.min("at").alias("at")))
    got = skew.join_few(firsts, named, ["title"], hot)
    return got.select("_t", "title", "at", *[c for c in named.columns if c != "title"])
