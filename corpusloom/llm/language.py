"""Language identification in two steps: the family, then one-versus-one support vector machines within it.

Features are relative frequencies of hashed byte pairs and triples of the whole lower-cased text, square-rooted and
scaled to length 1; everything but letters counts as a space. A first machine per family (that family against the rest) picks the
family; within it a linear support vector machine for every pair of languages votes, which is where closely related
languages are told apart. Margins become probabilities by Platt's method; the score is the family's probability times the
mean probability of the winning language against its relatives.

Training: rows with a language, at most PER_LANGUAGE of each, taken by the order of a hash of their id; the only bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import words as W
from corpusloom.llm.linear import platt, sigmoid, svm
from corpusloom.operators.skew import small

PER_LANGUAGE = 600
BUCKETS = 4096
BROADCAST_LANGUAGES = 100_000
PIECE = 1 << 20
# Families of language codes; a code that is not listed forms a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz tt ky",
    "indic": "hi ur bn mr ne pa gu",
    "semitic": "ar he am mt",
    "austronesian": "id ms tl jv",
}
# Word characters but decimal digits: letters, and numbers like U+00B2 or U+2460, which are no letters.
_WORD = re.compile(r"[^\W\d_]")
_TABLE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


def has_letter(text: str | None) -> bool:
    """Whether a character is of a letter category; the first word character mostly tells."""
    return bool(text) and any(m.group().isalpha() for m in _WORD.finditer(text))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(one row of BUCKETS features per text, whether the text has a letter)."""
    out, letters = np.zeros((len(texts), BUCKETS), np.float32), np.zeros(len(texts), bool)
    for part in W.slices(texts):
        some = texts[part]
        raw = [(" " + t.lower() + " ").encode("utf-8", "surrogatepass").translate(_TABLE) if t else b"  " for t in some]
        letters[part] = [has_letter(t) for t in some]
        counts = np.zeros(len(some) * BUCKETS)
        whole, owner_end = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
        for at in range(0, len(whole), PIECE):
            b = whole[at : at + PIECE + 2].astype(np.uint32)
            own = np.searchsorted(owner_end, np.arange(at, at + len(b)), side="right")
            two = (b[:-1] << 8) | b[1:]
            for gram, width in (((two[:-1] << 8) | b[2:], 3), (two[: len(b) - 2] | (1 << 24), 2)):
                first = own[: len(gram)]
                ok = (own[width - 1 : width - 1 + len(gram)] == first) & (gram & 0xFFFF != 0x2020)
                h = (gram * np.uint32(0x9E3779B1)) >> np.uint32(20)
                counts += np.bincount(first[ok] * BUCKETS + h[ok], minlength=len(counts))
        got = np.sqrt(counts.reshape(len(some), BUCKETS))
        out[part] = got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-9)
    return out, letters


def _machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """A machine with the curve of its probabilities, which is fitted on every fifth row, unseen by a first machine."""
    fold = np.arange(len(y)) % 5 == 0
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        fold[:] = False
    sign = np.where(y > 0, 1.0, -1.0)
    w = svm(x, sign)
    if fold.any():
        v = svm(x[~fold], sign[~fold])
        a, b = platt(x[fold] @ v[:-1] + v[-1], y[fold])
    else:
        a, b = platt(x @ w[:-1] + w[-1], y)
    return w, max(a, 1e-3), b


def fit(x: np.ndarray, lang: list[str]) -> dict:
    """The model: families, their machines, and one machine for each pair of languages of a family."""
    lang = np.array(lang, object)
    family = np.array([family_of(v) for v in lang], object)
    names = sorted(set(family))
    model: dict = {"families": {}, "members": {f: sorted(set(lang[family == f])) for f in names}, "pairs": {}}
    if len(names) > 1:
        model["families"] = {f: _machine(x, (family == f).astype(float)) for f in names}
    for f in names:
        for a, b in combinations(model["members"][f], 2):
            rows = (lang == a) | (lang == b)
            model["pairs"][a, b] = _machine(x[rows], (lang[rows] == a).astype(float))
    return model


def _probability(machine: tuple, x: np.ndarray) -> np.ndarray:
    w, a, b = machine
    return sigmoid(a * (x @ w[:-1] + w[-1]) + b)


def predict(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names = list(model["members"])
    if not names:
        return np.full(len(x), "und", object), np.zeros(len(x))
    if model["families"]:
        p = np.stack([_probability(model["families"][f], x) for f in names], 1)
        p = p / np.maximum(p.sum(1, keepdims=True), 1e-12)
    else:
        p = np.ones((len(x), 1))
    best = p.argmax(1)
    lang, score = np.full(len(x), "und", object), p.max(1)
    for k, f in enumerate(names):
        rows, members = np.flatnonzero(best == k), model["members"][f]
        if len(members) == 1:
            lang[rows] = members[0]
            continue
        got = np.zeros((len(rows), len(members)))
        for (a, b), machine in model["pairs"].items():
            if a in members:
                q = _probability(machine, x[rows])
                got[:, members.index(a)] += q
                got[:, members.index(b)] += 1 - q
        lang[rows] = np.array(members, object)[got.argmax(1)]
        score[rows] *= got.max(1) / (len(members) - 1)
    return lang, np.clip(score, 0.0, 1.0)


def training_rows(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, text) of at most `per_language` rows of each language; `docs` has i, text, lang."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("draw", F.xxhash64(F.col("i").cast("string"), F.lit(17)))
    # One row for each language.
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # The hash alone leaves about twice the rows wanted of each language, whatever the size of the table.
    cut = F.pmod("draw", F.lit(1_000_000)) < F.lit(2_000_000 * per_language) / F.col("n")
    # The sizes go to the rows, so that only what the cut leaves is dealt by language.
    few = rows.join(small(sizes, BROADCAST_LANGUAGES), "lang").where(cut)
    by_draw = Window.partitionBy("lang").orderBy("draw", "text")
    return few.withColumn("k", F.row_number().over(by_draw)).where(F.col("k") <= per_language).select("lang", "text")


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        x, letters = features(b["text"].tolist())
        yield pd.DataFrame({"lang": b["lang"][letters], "x": [r.astype(np.float16).tobytes() for r in x[letters]]})


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """Fit on the driver: at most `per_language` feature rows of 8 kB for each language come there."""
    got = training_rows(labelled, per_language).mapInPandas(_featured, "lang string, x binary").toPandas()
    got = got.sort_values(["lang", "x"], ignore_index=True)
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(len(got), BUCKETS).astype(np.float32)
    return fit(x, got["lang"].tolist())


def identify(docs: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, lang_pred, score), one row per row of `docs`.

    `trainable` says which rows may be learned from (NULL: not). The prediction reads the text alone.
    NULL texts and texts without a letter are `und` with score 0; so is everything when there is nothing to learn
    from. One known language is always predicted, with score 1. Of equal scores the first language by name wins.
    Rows that repeat are predicted alike; NULL ids stay NULL; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), trainable.alias("ok"))
    model = train(rows.where("ok"), per_language)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for part in W.slices(texts):
                x, letters = features(texts[part])
                lang, score = predict(model, x)
                lang[~letters], score[~letters] = "und", 0.0
                yield pd.DataFrame({"doc_id": b["i"].iloc[part].to_numpy(), "lang_pred": lang, "score": score.astype(float)})

    kind = dict(rows.dtypes)["i"]
    return rows.select("i", "text").mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")
