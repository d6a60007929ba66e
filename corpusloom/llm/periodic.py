"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. The basic factors are
the stretches of 1, 2, 4, ... words; equal ones of a text get the same name, the name of a factor following from those of its
two halves. For each length w the successor of a factor is its next occurrence. Where the factors at consecutive places all have their successor at
the same distance d, at most 2 * w, their occurrences form arithmetic progressions of difference d, and the words from
the first factor to the last successor have period d. Such a stretch is proposed, extended as far as words d apart
are equal, and kept once.

Nothing is lost: let a run have period q and at least 3 * q words, and w be the first power of two that is not below q. Two occurrences
of a factor of w words inside the run are a multiple of q apart, as its q first words are no repetition, so all factors of the run that have
room for it have their successor at distance q, and those next to the run have not: the proposal is the run. Nothing is added: were a proposal of at least
4 * d words periodic with a divisor of d, its first factor would have had a nearer successor.

Names that occur once in a text are given up, so in running prose few places are left after the first lengths.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import slices

SCHEMA = "doc_id string, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

_BREAKS = re.compile("[\x09-\x0d]")


def split_words(text: str | None) -> list[str]:
    """Runs of characters other than space and \\x09-\\x0D, as they are."""
    return [w for w in _BREAKS.sub(" ", text).split(" ") if w] if text else []


def find_runs(words: np.ndarray, least: int = 6, power: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` words and `power` (3 or more) periods, sorted, where
    `words` are numbers that are equal for equal words. Texts can follow each other if they share no number."""
    n, w = len(words), 1
    place, name = np.arange(n), words
    found: set[tuple[int, int, int]] = set()
    while len(place):
        order = np.argsort(name, kind="stable")
        sorted_name, sorted_place = name[order], place[order]
        again = sorted_name[1:] == sorted_name[:-1]
        gap = np.zeros(len(place), np.int64)
        gap[order[:-1]] = np.where(again, sorted_place[1:] - sorted_place[:-1], 0)
        # Consecutive places whose successors are equally far away.
        near = (gap > 0) & (gap <= 2 * w)
        joined = near[1:] & near[:-1] & (gap[1:] == gap[:-1]) & (place[1:] == place[:-1] + 1)
        first = np.flatnonzero(near & ~np.concatenate(([False], joined)))
        last = np.flatnonzero(near & ~np.concatenate((joined, [False])))
        start, d = place[first], gap[first]
        length = place[last] - start + w + d
        for k in np.flatnonzero(length >= np.maximum(least, power * d)):
            found.add(_extend(words, int(start[k]), int(length[k]), int(d[k])))
        # Factors of twice the length, of places where both halves occur again.
        number = np.zeros(len(place), np.int64)
        number[order[1:]] = np.cumsum(~again)
        twice = np.zeros(len(place), bool)
        twice[order[1:]] |= again
        twice[order[:-1]] |= again
        full = np.full(n + w, -1, np.int64)
        full[place[twice]] = number[twice]
        left, right = full[place], full[place + w]
        both = (left >= 0) & (right >= 0)
        place, name = place[both], left[both] * len(order) + right[both]
        w *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def _extend(words: np.ndarray, start: int, length: int, d: int) -> tuple[int, int, int]:
    while start > 0 and words[start - 1] == words[start - 1 + d]:
        start, length = start - 1, length + 1
    while start + length < len(words) and words[start + length] == words[start + length - d]:
        length += 1
    return start, length, d


def _texts(texts: Sequence[str | None], least: int, power: int) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """(number of words, runs, words without repeated periods) of each text. Texts are looked at together."""
    words = [split_words(t) for t in texts]
    flat = [w for ws in words for w in ws]
    begin = np.cumsum([0] + [len(ws) for ws in words])
    codes, known = pd.factorize(np.array(flat, dtype=object))
    # Numbers of words that no two texts share.
    codes = codes.astype(np.int64) + np.repeat(np.arange(len(words)), np.diff(begin)) * (len(known) + 1)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    gone = np.zeros(len(flat) + 1, np.int64)
    for start, length, d in find_runs(codes, least, power):
        i = int(np.searchsorted(begin, start, side="right")) - 1
        runs[i].append((start - int(begin[i]), length, d))
        gone[start + d] += 1
        gone[start + length] -= 1
    gone = np.cumsum(gone) > 0
    for i, ws in enumerate(words):
        drop = gone[begin[i] : begin[i + 1]]
        yield len(ws), runs[i], " ".join([w for w, g in zip(ws, drop.tolist(), strict=True) if not g] if runs[i] else ws)


def _task(least: int, power: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for part in slices(texts):
                n, runs, collapsed = zip(*_texts(texts[part], least, power), strict=True)
                yield pd.DataFrame({
                    "doc_id": b["doc_id"].iloc[part].tolist(), "n_words": list(n),
                    "runs": [[{"start": s, "length": m, "period": d} for s, m, d in r] for r in runs], "collapsed": list(collapsed),
                })

    return run


def periodic_runs(docs: DataFrame, least: int = 6, power: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed): one row per row of `docs`.

    `runs` are all runs (start as word number from 0, length, period) of at least `least` words and `power` (3 or more) periods, by start,
    then period. `collapsed` is the text's words, one space between, without those that a run has after its first period. Whole texts are
    taken; a task holds about a megabyte of them at a time, or one text. A NULL, empty or blank text has no words, no runs and
    the empty text. Rows with a NULL or repeated id are rows of their own. Other columns are ignored, whatever their names.
    """
    if power < 3:
        raise ValueError("power must be 3 or more")
    # The id goes through pandas as text: beside a NULL, long numbers would become inexact.
    d = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInPandas(_task(least, power), SCHEMA).withColumn("doc_id", F.col("doc_id").cast("bigint"))
