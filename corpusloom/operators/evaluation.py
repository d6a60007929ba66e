"""Scores of answers against references."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from corpusloom.functions import text


def letter_index(c: Column | str) -> Column:
    """A..Z to 0..25; anything else is -1."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.rlike("^[A-Z]$"), F.ascii(col) - 65).otherwise(F.lit(-1))


def choice_accuracy(df: DataFrame, pred: str, ref: str, by: Sequence[str] = ()) -> DataFrame:
    hit = letter_index(text.strip(pred)) == letter_index(ref)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("int")).alias("accuracy"))


def token_overlap(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Mean share of an answer's distinct words that the reference has; an empty answer scores 0."""
    h = text.token_set(hyp)
    share = F.coalesce(
        F.try_divide(F.size(F.array_intersect(h, text.token_set(ref))), F.size(h)), F.lit(0.0)
    )
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(share).alias("overlap"))


def bleu_tokens(c: Column | str) -> Column:
    """The usual corpus-BLEU cut: punctuation apart, digits kept with their points."""
    s = F.col(c) if isinstance(c, str) else c
    s = F.replace(F.replace(s, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.concat(F.lit(" "), s, F.lit(" "))
    s = F.regexp_replace(s, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    s = F.regexp_replace(s, r"([^0-9])([\.,])", "$1 $2 ")
    s = F.regexp_replace(s, r"([\.,])([^0-9])", " $1 $2")
    s = F.regexp_replace(s, r"([0-9])(-)", "$1 $2 ")
    return text.tokens(s)


def rouge_tokens(c: Column | str) -> Column:
    s = F.col(c) if isinstance(c, str) else c
    return F.array_remove(F.split(F.lower(s), "[^a-z0-9]+"), "")


def _clips(orders: Sequence[int], hyp: Column, ref: Column) -> Column:
    """n-gram matches of each order, a hypothesis gram counted at most as often as in the reference.
    Both texts are in one row, so the grams are counted there and only the sums leave it."""

    @pandas_udf(T.ArrayType(T.IntegerType()))
    def run(h: pd.Series, f: pd.Series) -> pd.Series:
        def grams(words: list[str], n: int) -> Counter:
            return Counter(zip(*(words[i:] for i in range(n))))

        return pd.Series([[sum((grams(x, n) & grams(y, n)).values()) for n in orders] for x, y in zip((list(v) for v in h), (list(v) for v in f))])

    return run(F.coalesce(hyp, F.array().cast("array<string>")), F.coalesce(ref, F.array().cast("array<string>")))


def bleu_counts(df: DataFrame, id_col: str, ref: str, hyp: str, n: int = 4) -> DataFrame:
    """(n, matches, total, hyp_len, ref_len) over the corpus, one row per order."""
    rows = df.select(bleu_tokens(hyp).alias("h"), bleu_tokens(ref).alias("f"))
    orders = list(range(1, n + 1))
    each = rows.select(F.size("h").alias("lh"), F.size("f").alias("lf"), F.posexplode_outer(_clips(orders, F.col("h"), F.col("f"))).alias("pos", "clip"))
    return each.groupBy((F.col("pos") + 1).alias("n")).agg(
        F.coalesce(F.sum("clip"), F.lit(0)).alias("matches"), F.sum(F.greatest(F.col("lh") - F.col("pos"), F.lit(0))).alias("total"),
        F.sum("lh").alias("hyp_len"), F.sum("lf").alias("ref_len"),
    )


def corpus_bleu(df: DataFrame, id_col: str, ref: str, hyp: str, n: int = 4) -> DataFrame:
    """Geometric mean of clipped precisions times the brevity penalty; no smoothing."""
    c = bleu_counts(df, id_col, ref, hyp, n)
    one = c.agg(
        F.min("matches").alias("low"),
        F.avg(F.log(F.when((F.col("matches") > 0) & (F.col("total") > 0), F.col("matches") / F.col("total")))).alias("lg"),
        F.max("hyp_len").alias("hyp_len"), F.max("ref_len").alias("ref_len"),
    )
    bp = F.when(F.col("hyp_len") > F.col("ref_len"), F.lit(1.0)).when(
        F.col("hyp_len") > 0, F.exp(1 - F.col("ref_len") / F.col("hyp_len"))
    ).otherwise(F.lit(0.0))
    return one.select(
        F.when(F.col("low") > 0, F.exp("lg") * bp).otherwise(F.lit(0.0)).alias("bleu"),
        bp.alias("brevity_penalty"), "hyp_len", "ref_len",
    )


@pandas_udf(T.IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence lengths; the table's column is one bit vector."""
    def one(x, y) -> int:
        where: dict[str, int] = {}
        for i, w in enumerate(x):
            where[w] = where.get(w, 0) | (1 << i)
        full = (1 << len(x)) - 1
        v = full
        for w in y:
            u = v & where.get(w, 0)
            v = ((v + u) | (v - u)) & full
        return len(x) - bin(v).count("1")

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def _f1(hits: Column, nh: Column, nr: Column) -> Column:
    p = F.coalesce(F.try_divide(hits, nh), F.lit(0.0))
    r = F.coalesce(F.try_divide(hits, nr), F.lit(0.0))
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def rouge(df: DataFrame, id_col: str, ref: str, hyp: str, with_lcs: bool = True) -> DataFrame:
    """Mean F1 over rows: rouge1, rouge2 and, with `with_lcs`, rougeL."""
    rows = df.select(rouge_tokens(hyp).alias("h"), rouge_tokens(ref).alias("f"))
    j = rows.select("h", "f", F.size("h").alias("lh"), F.size("f").alias("lf"), _clips((1, 2), F.col("h"), F.col("f")).alias("c"))
    over = lambda c: F.greatest(F.col(c) - 1, F.lit(0))
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(_f1(F.get("c", 0), F.col("lh"), F.col("lf"))).alias("rouge1"),
        F.avg(_f1(F.get("c", 1), over("lh"), over("lf"))).alias("rouge2"),
    ]
    if with_lcs:
        j = j.withColumn("cl", _lcs("h", "f"))
        aggs.append(F.avg(_f1(F.col("cl"), F.col("lh"), F.col("lf"))).alias("rougeL"))
    return j.agg(*aggs)


def judge_means(df: DataFrame, metric: str = "metric", score: Column | str = "verdict.score") -> DataFrame:
    """Mean verdict score per metric, each over its own verdicts that have a score."""
    c = F.col(score) if isinstance(score, str) else score
    return df.groupBy(metric).agg(F.count(c).alias("n"), F.avg(c).alias("mean_score"))


def leaderboard(df: DataFrame, model: str = "model", step: str = "step", value: str = "accuracy") -> DataFrame:
    """Best value per model and the step that reached it (the earliest among equals)."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(step)).alias("s")))
    return df.groupBy(model).agg(F.count(F.lit(1)).alias("n"), best.alias("b")).select(
        model, "n", F.col("b.v").alias("best"), (-F.col("b.s")).alias("best_step")
    )
