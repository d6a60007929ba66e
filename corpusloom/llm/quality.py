"""Quality classification by co-training.

Two views of a document are classified apart: its text content (which words it has, how much they repeat) and its page
metadata and layout (source, language, length, lines, shares of character kinds). Both are logistic regressions over
presence features. In every round each view labels a pool of unlabelled documents and hands the ones it is surest
of to the other view as training rows. After the rounds each view's margin is calibrated by Platt's method on labelled rows kept
apart, and a logistic regression over both calibrated views, fitted on the same rows, gives the probability.

There are two labels of that kind, `quality` (1 is good) and `toxic` (1 is toxic), each with its own pair of views.

Training reads LABELLED rows for each combination of labels and POOL unlabelled rows at most, taken by the order of a hash of
their id; these are the only bounds. Scoring covers every document, whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import words as W
from corpusloom.llm.linear import Sparse, logistic, newton, platt, sigmoid

LABELLED, POOL, ROUNDS = 1500, 3000, 3
# Presence features: hashed words and text marks, hashed metadata and layout marks.
TEXT, PAGE = 1 << 17, 1 << 12
HEADS = ("quality", "toxic")
# Bytes of a word that stand for its stem, and the least evidence (G statistic) for a feature to be used.
STEM, EVIDENCE = 4, 12.0
# Below the first and from the second on a document is rejected: rather a bad document kept than a good one lost.
LEAST_QUALITY, MOST_TOXIC = 0.3, 0.6
_U = np.uint64
# Letters and digits stay, other ASCII characters end a word.
_BARE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_KIND = np.full(256, 5, np.uint8)  # other bytes of longer characters count as letters
_KIND[:128] = 0
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[48:58] = 2
_KIND[65:91] = 3
_KIND[97:123] = 5
_KIND[ord("|")] = 4


def _mark(name: str, value: np.ndarray, size: int) -> np.ndarray:
    seed = W.word_hashes([name])[0][0]
    return (W.mix(value.astype(_U) + seed) % _U(size)).astype(np.int64)


def _levels(share: np.ndarray) -> np.ndarray:
    """Steps of a share, finer near 0."""
    return np.searchsorted([0.001, 0.003, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], share).astype(np.int64)


def views(texts: list[str | None], sources: list[str | None], langs: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The feature indices of every document in both views. NULL values are values of their own."""
    text_view: list[np.ndarray] = []
    page_view: list[np.ndarray] = []
    for part in W.slices(texts):
        some = texts[part]
        h, o = W.word_hashes(some, _BARE)
        n = np.diff(o)
        _, full = W.word_hashes(some)
        full = np.diff(full)
        sets = [np.unique(h[a:b], return_counts=True) for a, b in zip(o[:-1], o[1:], strict=True)]
        spread = np.array([len(u) for u, _ in sets]) / np.maximum(n, 1)
        top = np.array([c.max() if len(c) else 0 for _, c in sets]) / np.maximum(n, 1)
        # How much words repeat says little about a short text, so it counts together with the length.
        band = np.searchsorted([10, 30, 60, 120, 250, 500, 1000, 3000], n)
        marks = np.stack([_mark("spread", _levels(spread) + 100 * band, TEXT), _mark("top", _levels(top) + 100 * band, TEXT)], 1)
        stems, _ = W.word_hashes(some, _BARE, STEM)
        stems = (W.mix(stems + _U(1)) % _U(TEXT)).astype(np.int64)
        for (u, _), m, a, b in zip(sets, marks, o[:-1], o[1:], strict=True):
            text_view.append(np.unique(np.concatenate([(u % _U(TEXT)).astype(np.int64), stems[a:b], m])))
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in some]
        size = np.array([len(r) for r in raw])
        own = np.repeat(np.arange(len(raw)), size)
        kinds = np.bincount(own * 6 + _KIND[np.frombuffer(b"".join(raw), np.uint8)], minlength=6 * len(raw)).reshape(-1, 6)
        lines = np.array([r.count(b"\n") + 1 for r in raw])
        share = kinds / np.maximum(size, 1)[:, None]
        who = [W.word_hashes([f"s{a!r}".replace(" ", "_"), f"l{b!r}".replace(" ", "_")])[0] for a, b in zip(sources[part], langs[part], strict=True)]
        page = [
            _mark("source", np.array([w[0] for w in who], _U), PAGE), _mark("lang", np.array([w[1] for w in who], _U), PAGE),
            _mark("size", np.log2(size + 1).astype(np.int64), PAGE), _mark("lines", np.log2(lines).astype(np.int64), PAGE),
            _mark("per_line", np.log2(full / lines + 1).astype(np.int64), PAGE), _mark("word", np.minimum(size // np.maximum(full, 1), 40), PAGE),
            *[_mark(f"kind{k}", _levels(share[:, k]) + 100 * (size < 300), PAGE) for k in range(6)], _mark("null", np.array([t is None for t in some]), PAGE),
        ]
        page_view += list(np.stack(page, 1))
    return text_view, page_view


def _sample(labels: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """At most LABELLED labelled rows for each pair of labels, and POOL rows without a label."""
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit(23))
    # Conflicting labels of one id are left out.
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.when(F.min(h) == F.max(h), F.max(h)).alias(h) for h in HEADS])
    known = known.withColumn("draw", draw).where("quality is not null or toxic is not null")
    sizes = known.groupBy(*HEADS).agg(F.count(F.lit(1)).alias("n")).toDF("q", "t", "n")
    # The hash alone leaves about twice the rows wanted.
    few = known.join(F.broadcast(sizes), F.col("quality").eqNullSafe(F.col("q")) & F.col("toxic").eqNullSafe(F.col("t")))  # at most nine rows
    few = few.where(F.pmod("draw", F.lit(1_000_000)) < F.lit(2_000_000 * LABELLED) / F.col("n"))
    few = few.withColumn("k", F.row_number().over(Window.partitionBy(*HEADS).orderBy("draw"))).where(F.col("k") <= LABELLED)
    total = docs.agg(F.count("doc_id")).first()[0]
    share = min(1.0, 2.0 * POOL / max(total, 1))
    pool = docs.select("doc_id").where("doc_id is not null").withColumn("draw", F.xxhash64(F.col("doc_id").cast("string"), F.lit(29)))
    pool = pool.where(F.pmod("draw", F.lit(1_000_000)) < int(share * 1_000_000) + 1).distinct().join(known.select("doc_id"), "doc_id", "left_anti")
    return few.select("doc_id", *HEADS), pool.orderBy("draw", "doc_id").limit(POOL).select("doc_id")


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for part in W.slices(whole["text"].tolist()):
            b = whole.iloc[part]
            t, p = views(b["text"].tolist(), b["source"].tolist(), b["lang"].tolist())
            b = b.drop(columns=["text", "source", "lang"])
            yield b.assign(t=[x.astype(np.int32).tobytes() for x in t], p=[x.astype(np.int16).tobytes() for x in p])


def _telling(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Which features go with the label at all: those whose G statistic reaches EVIDENCE."""
    pos = y > 0
    a = Sparse([r for r, k in zip(rows, pos, strict=True) if k])
    have = np.bincount(Sparse(rows).index, minlength=size).astype(float)
    with_pos = np.bincount(a.index, minlength=size).astype(float)
    n, share = len(rows), max(float(pos.mean()), 1e-9)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    g = part(with_pos, have * share) + part(have - with_pos, have * (1 - share))
    g += part(pos.sum() - with_pos, (n - have) * share) + part(n - have - (pos.sum() - with_pos), (n - have) * (1 - share))
    return 2 * g >= EVIDENCE


def _fit(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Logistic regression over the telling features; all other weights are 0."""
    use = _telling(rows, y, size)
    return logistic(Sparse([r[use[r]] for r in rows]), y, size)


def co_train(y: np.ndarray, known: list[tuple[np.ndarray, np.ndarray]], pool: list[tuple[np.ndarray, np.ndarray]]) -> dict | None:
    """One head: weights of both views, their curves, and the weights that combine them. None without both classes."""
    if len(set(y)) < 2:
        return None
    apart = np.arange(len(y)) % 4 == 0
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart[:] = False
    train = np.flatnonzero(~apart)
    check = np.flatnonzero(apart) if apart.any() else train
    sizes = (TEXT, PAGE)
    rows = [[known[i][v] for i in train] for v in (0, 1)]
    given = [y[train].astype(float) for _ in (0, 1)]
    free = [np.ones(len(pool), bool) for _ in (0, 1)]
    w: list[np.ndarray] = []
    for k in range(ROUNDS + 1):
        w = [_fit(rows[v], given[v], sizes[v]) for v in (0, 1)]
        if k == ROUNDS or not pool:
            break
        for v in (0, 1):
            other = 1 - v
            mine = Sparse([known[i][v] for i in check])
            a, b = platt(mine.dot(w[v][:-1]) + w[v][-1], y[check].astype(float))
            p = sigmoid(a * (Sparse([x[v] for x in pool]).dot(w[v][:-1]) + w[v][-1]) + b)
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                best = np.argsort(-sure, kind="stable")
                best = [i for i in best if free[other][i] and sure[i] >= 0.95][: len(train) // 10]
                rows[other] = rows[other] + [pool[i][other] for i in best]
                given[other] = np.append(given[other], np.full(len(best), label))
                free[other][best] = False
    curves = []
    for v in (0, 1):
        curves.append(platt(Sparse([known[i][v] for i in check]).dot(w[v][:-1]) + w[v][-1], y[check].astype(float)))
    z = np.stack([curves[v][0] * (Sparse([known[i][v] for i in check]).dot(w[v][:-1]) + w[v][-1]) + curves[v][1] for v in (0, 1)], 1)
    z = np.clip(z, -12, 12)
    # The views' weights: a regression over both, drawn towards adding up the evidence of independent views.
    target = y[check].astype(float)
    share = min(max(float(target.mean()), 1e-3), 1 - 1e-3)
    start = np.array([1.0, 1.0, -np.log(share / (1 - share))])
    c = newton(np.column_stack([z, np.ones(len(z))]), target, start, 0.5)
    c[:2] = np.maximum(c[:2], 0.0)
    return {"w": w, "curves": curves, "mix": c}


def probability(head: dict | None, t: Sparse, p: Sparse, default: float) -> np.ndarray:
    if head is None:
        return np.full(len(t.start) - 1, default)
    z = 0.0
    for v, x in enumerate((t, p)):
        a, b = head["curves"][v]
        z = z + head["mix"][v] * np.clip(a * (x.dot(head["w"][v][:-1]) + head["w"][v][-1]) + b, -12, 12)
    return sigmoid(z + head["mix"][2])


def train(docs: DataFrame, labels: DataFrame) -> dict[str, dict | None]:
    """Fit both heads on the driver: the features of at most 9 * LABELLED + POOL documents come there."""
    few, pool = _sample(labels, docs)
    wanted = few.unionByName(pool, allowMissingColumns=True)  # bounded by the sample, so it may be broadcast
    got = docs.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", *HEADS).agg(F.min(F.struct("text", "source", "lang")).alias("r"))
    # One row for each id, however often it is repeated.
    got = got.select("doc_id", *HEADS, "r.text", "r.source", "r.lang")
    got = got.mapInPandas(_featured, "doc_id long, quality int, toxic int, t binary, p binary").toPandas()
    got = got.sort_values(["doc_id", "t", "p"], ignore_index=True).drop_duplicates("doc_id")
    pairs = [(np.frombuffer(t, np.int32), np.frombuffer(p, np.int16)) for t, p in zip(got["t"], got["p"], strict=True)]
    blank = (got["quality"].isna() & got["toxic"].isna()).to_numpy()
    free = [x for x, b in zip(pairs, blank, strict=True) if b]
    heads = {}
    for h in HEADS:
        have = got[h].notna().to_numpy()
        heads[h] = co_train(got[h][have].to_numpy(float), [x for x, k in zip(pairs, have, strict=True) if k], free)
    return heads


def _model(docs: DataFrame, labels: DataFrame) -> dict[str, dict | None]:
    """Train on the columns that training reads, cast to their types."""
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(h).cast("int").alias(h) for h in HEADS])
    return train(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")]), labels)


def _judge(heads: dict, b: pd.DataFrame, least_quality: float, most_toxic: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By pieces of the batch: the features of a piece go before those of the next are made."""
    texts, sources, langs = b["text"].tolist(), b["source"].tolist(), b["lang"].tolist()
    good, bad = np.empty(len(b)), np.empty(len(b))
    for part in W.slices(texts):
        t, p = (Sparse(v) for v in views(texts[part], sources[part], langs[part]))
        good[part], bad[part] = probability(heads["quality"], t, p, 1.0), probability(heads["toxic"], t, p, 0.0)
    return good, bad, (good >= least_quality) & (bad < most_toxic)


def score(docs: DataFrame, labels: DataFrame, least_quality: float = LEAST_QUALITY, most_toxic: float = MOST_TOXIC) -> DataFrame:
    """(doc_id, quality, toxic, keep), one row per row of `docs` (doc_id, text, source, lang).

    `quality` and `toxic` are probabilities; `keep` = quality >= least_quality and toxic < most_toxic.
    Without labels of both values a head gives 1 for quality and 0 for toxic, so everything is kept.
    NULL and empty texts are scored like others, by what is there. Repeated rows are scored alike; rows with a NULL id
    are scored but never trained on. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    heads = _model(docs, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good, bad, keep = _judge(heads, b, least_quality, most_toxic)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "quality": good, "toxic": bad, "keep": keep})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")])
    return rows.mapInPandas(run, "doc_id long, quality double, toxic double, keep boolean")


def accepted(docs: DataFrame, labels: DataFrame, least_quality: float = LEAST_QUALITY, most_toxic: float = MOST_TOXIC) -> DataFrame:
    """The rows of `docs` that `score` keeps, with all their columns (doc_id, text, source and lang among them)."""
    heads = _model(docs, labels)

    @F.pandas_udf("boolean")
    def keep(text: pd.Series, source: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series(_judge(heads, pd.DataFrame({"text": text, "source": source, "lang": lang}), least_quality, most_toxic)[2])

    return docs.where(keep(*[F.col(c).cast("string") for c in ("text", "source", "lang")]))
