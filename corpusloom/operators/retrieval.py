"""Prefix suggestion, BM25 ranking, title search and prompt assembly over hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import sampling, skew, substrings
from corpusloom.session import stable

K1 = 1.2
B = 0.75
# Scores that one task sums and sorts.
SCORES = 1_000_000


def terms(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    col = F.col(c) if isinstance(c, str) else c
    return F.array_remove(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), "")


def suggest(df: DataFrame, prefix: str, k: int = 5, title: str = "title") -> DataFrame:
    """Up to `k` different titles that start with the prefix, in any case, in name order."""
    return (
        df.where(F.startswith(F.lower(F.col(title)), F.lit(prefix.lower())))
        .select(title).distinct().orderBy(title).limit(k)
    )


def bm25(
    docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text",
    query_id: str = "query_id", query_text: str = "text",
) -> DataFrame:
    """(query_id, doc_id, score, pos): the best `k` documents per query.

    The text is cut into terms once: only query terms leave that pass, with one row per
    document under the empty term that carries its length. Term counts are combined map-side, scores are
    summed where a document's counts are, and k rows per query and task go into the last shuffle.
    """
    q = (
        queries.select(F.col(query_id).alias("query_id"), F.explode(terms(query_text)).alias("term"))
        .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    )
    q = stable(q)
    # Everything joined to documents below has at most the rows of `q`, plus one.
    few = q.count() <= skew.BROADCAST_ROWS
    mark = F.broadcast if few else (lambda x: x)
    every = docs.sparkSession.range(1).select(F.lit("").alias("term"))
    wanted = q.select("term").distinct().unionByName(every)
    words = docs.select(F.col(doc_id).alias("doc_id"), F.array_append(terms(doc_text), F.lit("")).alias("w"))
    # An inner explode would infer a filter on the array's size, and cut every text twice.
    long = words.select("doc_id", (F.size("w") - 1).alias("dl"), F.explode_outer("w").alias("term"))
    tf = stable(
        long.join(mark(wanted), "term").groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    )
    whole = tf.where("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    n, avgdl = whole.select("n").scalar(), whole.select("avgdl").scalar()
    hits = tf.where("term <> ''")
    df_ = stable(hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    weights = q.join(df_, "term").select(
        "query_id", "term", "qtf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    )
    score = (
        F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1)
        / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    )
    # Every hit meets the queries of its term: the number of tasks follows the scores to be summed, so a task's table keeps its size.
    met = weights.join(df_, "term").agg(F.sum("df")).collect()[0][0] or 0  # one row
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-met // SCORES))
    scored = (
        # By document, so that scores are summed where they are and only the best k of a task and query move on.
        hits.repartition(tasks, "doc_id").join(mark(weights), "term")
        .groupBy("query_id", "doc_id").agg(F.round(F.sum(score), 6).alias("score"))
    )
    return sampling.top_k(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def search_by_title(
    docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", title: str = "title",
    query_id: str = "query_id", query_text: str = "text",
) -> DataFrame:
    """Pages whose title stands in the query: (query_id, doc_id, title, pos), longest title first.

    Titles meet the queries' pieces of lengths that titles have, in equi joins. Of the pages that share a title only the first `k`
    by id can be among a query's best, so a title of any number of pages is a short group. Rows with a NULL or repeated query id share their hits.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(title).alias("title")).where("title <> ''")
    # Cut to `k` pages for each title in the tasks that read them.
    best = stable(sampling.top_k(d, ["title"], [F.asc("doc_id")], k, "_n").drop("_n"))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_text).alias("_q")).where("_q <> ''")
    found = substrings.first_places(q, best.select("title").distinct(), "_q", "title")
    rows = q.select("query_id", substrings.text_key(F.col("_q")).alias("_t")).distinct()
    hits = rows.join(found, "_t").join(best, "title").select("query_id", "doc_id", "title")
    return sampling.top_k(hits, ["query_id"], [F.desc(F.length("title")), F.asc("doc_id")], k)


def hit_lists(hits: DataFrame, docs: DataFrame, top: int, doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """(query_id, background): the first `top` hits' texts as a numbered list."""
    # `top` bounds each group.
    best = hits.where(F.col("pos") <= top).join(docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("body")), "doc_id")
    return (
        best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("l"))
        .select("query_id", tx.numbered_list(F.transform("l", lambda x: x["body"])).alias("background"))
    )


def build_rag_prompt(
    queries: DataFrame, background: DataFrame, layout: str, context: DataFrame | None = None,
    query_id: str = "query_id", query_text: str = "text",
) -> DataFrame:
    """Fill {query}, {background} and {context}; a query without hits gets empty lists."""
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_text).alias("query"))
    j = q.join(background.select("query_id", "background"), "query_id", "left")
    if context is None:
        j = j.withColumn("context", F.lit(""))
    else:
        j = j.join(context.select("query_id", "context"), "query_id", "left")
    return j.select(
        "query_id", tx.render(layout, query="query", background="background", context="context").alias("prompt")
    )


def eval_sample(answers: DataFrame, n: int = 20, seed: int = 4241, list_limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """`n` titles with all their answers (body and markdown kept together) and their number."""
    titles = sampling.sample_n(answers.select("title").distinct(), n, seed, "title")
    sizes = answers.groupBy("title").agg(F.count(F.lit(1)).alias("total_answers"))
    kept = answers.join(F.broadcast(titles), "title")  # n titles
    lists = skew.ordered_lists(kept, ["title"], [F.col("answer_id")], ["answer_id", "body", "body_markdown"], "answers", list_limit)
    return lists.join(sizes, "title")
