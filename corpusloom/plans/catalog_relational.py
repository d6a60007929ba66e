"""Queries over joins, aggregates, windows, sampling and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import (
    aggregates, evaluation, filters, joins, preference, sampling, sets, skew, windows,
)
from corpusloom.plans.catalog import cents, docs, query, table
from corpusloom.sources import writers

UHASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def _posts(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("selftext"))
    return filters.drop_tombstones(filters.with_prefixed_key(o, "id"), "selftext", ("F",))


@query("denorm_posts_comments", """
WITH p AS (SELECT 't3_' || o_orderkey AS post_id FROM orders WHERE o_orderstatus NOT IN ('F')),
r AS (SELECT 't3_' || l_orderkey AS parent_id, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS score,
        rank() OVER (PARTITION BY l_orderkey ORDER BY CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) DESC) AS rk FROM lineitem),
g AS (SELECT parent_id, count(*) AS n, max(score) AS best,
        string_agg(rk || ':' || score, ',' ORDER BY rk, score) AS l FROM r GROUP BY 1)
SELECT post_id, 0 AS piece, coalesce(n, 0) AS n_comments, best AS best_score, l AS ranked
FROM p LEFT JOIN g ON g.parent_id = p.post_id""")
def denorm_posts_comments(s, d):
    got = joins.denorm_posts_comments(_posts(s, d), _comments(s, d))
    return got.select("post_id", "piece", F.col("total").alias("n_comments"), F.get("comments", F.lit(0))["score"].alias("best_score"), _ranked("comments").alias("ranked"))


def _comments(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(
        F.concat(F.lit("t3_"), F.col("l_orderkey").cast("string")).alias("parent_id"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_returnflag").alias("body"), F.col("l_linenumber").alias("ups"),
        cents("l_extendedprice").alias("score"), F.lit(0).alias("downs"),
    )


def _ranked(comments: str) -> Column:
    return F.array_join(F.transform(comments, lambda x: F.concat(x["rank"].cast("string"), F.lit(":"), x["score"].cast("string"))), ",")


_PLACED_SQL = """
WITH p AS (SELECT 't3_' || o_orderkey AS post_id FROM orders WHERE o_orderstatus NOT IN ('F')),
s AS (SELECT 't3_' || l_orderkey AS parent_id, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS score FROM lineitem),
r AS (SELECT *, rank() OVER (PARTITION BY parent_id ORDER BY score DESC) AS rk, row_number() OVER (PARTITION BY parent_id ORDER BY score DESC) AS place,
  count(*) OVER (PARTITION BY parent_id) AS total FROM s)"""


@query("denorm_hot", _PLACED_SQL + """,
g AS (SELECT parent_id, (place - 1) // 2 AS piece, min(place) AS first, min(total) AS total, string_agg(rk || ':' || score, ',' ORDER BY place) AS l FROM r GROUP BY 1, 2)
SELECT post_id, coalesce(piece, 0) AS piece, coalesce(first, 1) AS first, coalesce(total, 0) AS total, l AS ranked FROM p LEFT JOIN g ON g.parent_id = p.post_id""")
def denorm_hot(s, d):
    """The list form with two comments a piece, so that most posts are hot."""
    got = joins.denorm_posts_comments(_posts(s, d), _comments(s, d), list_limit=2)
    return got.select("post_id", "piece", "first", "total", _ranked("comments").alias("ranked"))


@query("denorm_rows", _PLACED_SQL + """
SELECT post_id, place, coalesce(total, 0) AS total, rk AS rank, score FROM p LEFT JOIN r ON r.parent_id = p.post_id""")
def denorm_rows(s, d):
    """The long form: one row for each post and comment, whatever the posts' sizes; posts of more than three comments count as hot."""
    got = joins.post_comment_rows(_posts(s, d), _comments(s, d), limit=3)
    return got.select("post_id", "place", "total", F.col("comment.rank").cast("bigint").alias("rank"), "comment.score")


@query("tombstone_filter", """
SELECT 't3_' || o_orderkey AS post_id, o_orderstatus AS selftext FROM orders WHERE o_orderstatus NOT IN ('F')""")
def tombstone_filter(s, d):
    return _posts(s, d).select("post_id", "selftext")


@query("rank_within_parent", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS score,
  rank() OVER (PARTITION BY l_orderkey ORDER BY CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) DESC) AS rank
FROM lineitem""")
def rank_within_parent(s, d):
    l = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cents("l_extendedprice").alias("score"))
    return windows.rank_within(l, ["l_orderkey"], "score", [F.col("l_linenumber"), F.col("l_partkey")])


@query("suffixed_join", """
SELECT o.o_orderkey, o.o_custkey AS key_answer, c.c_custkey AS key_question,
  o.o_totalprice AS amount_answer, c.c_acctbal AS amount_question
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def suffixed_join(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("amount"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"))
    return joins.join_suffixed(o, c, "key", "key", ("_answer", "_question"))


@query("id_difference", """
SELECT 'left_only' AS side, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)
UNION ALL
SELECT DISTINCT 'right_only' AS side, user_id AS id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)""")
def id_difference(s, d):
    return joins.id_diff(table(s, d, "customer"), table(s, d, "events"), "c_custkey", "user_id")


@query("pending_work", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_work(s, d):
    return joins.pending(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels"), "doc_id")


@query("point_lookup", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 7")
def point_lookup(s, d):
    return joins.lookup(table(s, d, "orders"), "o_custkey", 7).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("tag_explode_counts", """
WITH t AS (SELECT unnest(string_split(p_type || '|' || replace(p_name, ' ', '|'), '|')) AS value FROM part)
SELECT value, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, value LIMIT 30""")
def tag_explode_counts(s, d):
    tags = F.concat(F.lit("|"), F.col("p_type"), F.lit("|"), F.replace("p_name", F.lit(" "), F.lit("|")), F.lit("|"))
    t = table(s, d, "part").select(text.split_tags(tags).alias("tags"))
    return aggregates.value_counts(aggregates.explode_tags(t, "tags"), "tag", 30)


@query("tag_like_filter", """
SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' OR p_type LIKE '%ring%'""")
def tag_like_filter(s, d):
    t = table(s, d, "part").withColumn("tags", text.split_tags(F.concat_ws("|", "p_type", F.replace("p_name", F.lit(" "), F.lit("|")))))
    return filters.filter_tag_like(t, "tags", "ring").select("p_partkey", "p_name")


@query("distinct_values", "SELECT DISTINCT p_brand AS value FROM part")
def distinct_values(s, d):
    return aggregates.distinct_values(table(s, d, "part"), "p_brand")


@query("group_list", """
SELECT o_custkey AS key, 0 AS piece, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) AS items, count(*) AS total
FROM orders GROUP BY 1""")
def group_list(s, d):
    g = aggregates.group_list(table(s, d, "orders").withColumnRenamed("o_custkey", "key"), "key", "o_orderpriority")
    return aggregates.with_count(g, "items").select("key", "piece", F.array_join("items", ",").alias("items"), "total")


@query("group_list_hot", """
WITH r AS (SELECT o_custkey AS key, o_orderpriority AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) - 1 AS rn,
  count(*) OVER (PARTITION BY o_custkey) AS total FROM orders)
SELECT key, rn // 3 AS piece, string_agg(v, ',' ORDER BY rn) AS items, min(total) AS total FROM r GROUP BY key, rn // 3""")
def group_list_hot(s, d):
    """The same with a limit of three rows a piece, so that most groups are split."""
    o = table(s, d, "orders").withColumnRenamed("o_custkey", "key")
    g = aggregates.group_list(o, "key", "o_orderpriority", list_limit=3)
    return g.select("key", "piece", F.array_join("items", ",").alias("items"), "total")


@query("group_structs", """
SELECT o_custkey, 0 AS piece, string_agg(o_orderstatus || o_orderkey, ';' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1""")
def group_structs(s, d):
    g = aggregates.group_structs(table(s, d, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderkey"], [F.col("o_orderkey")])
    show = F.transform("items", lambda x: F.concat(x["o_orderstatus"], x["o_orderkey"].cast("string")))
    return g.select("o_custkey", "piece", F.array_join(show, ";").alias("orders"))


@query("describe_scores", """
SELECT 'o_totalprice' AS "column", count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean,
  round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS p25,
  round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75,
  max(o_totalprice) AS max, sum((o_totalprice IS NULL)::INT) AS nulls, 'double' AS type FROM orders
UNION ALL
SELECT 'o_custkey', count(o_custkey), round(avg(o_custkey), 4), round(stddev_samp(o_custkey), 4), min(o_custkey)::DOUBLE,
  round(quantile_cont(o_custkey::DOUBLE, 0.25), 4), round(quantile_cont(o_custkey::DOUBLE, 0.5), 4),
  round(quantile_cont(o_custkey::DOUBLE, 0.75), 4), max(o_custkey)::DOUBLE, sum((o_custkey IS NULL)::INT), 'bigint' FROM orders""")
def describe_scores(s, d):
    got = aggregates.describe(table(s, d, "orders"), ["o_totalprice", "o_custkey"])
    return got.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


@query("leaderboard_best", """
WITH r AS (SELECT event_type AS model, event_id AS step, value AS accuracy FROM events),
b AS (SELECT model, count(*) AS n, max(accuracy) AS best FROM r GROUP BY 1)
SELECT b.model, b.n, b.best, min(r.step) AS best_step FROM b JOIN r ON r.model = b.model AND r.accuracy = b.best GROUP BY 1, 2, 3""")
def leaderboard_best(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("step"), F.col("value").alias("accuracy"))
    return evaluation.leaderboard(e)


@query("trailing_context", """
SELECT conv_id, turn, string_agg(role || ' ' || length(text), '-') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS context
FROM conversations""")
def trailing_context(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", "role", F.length("text")).alias("c"))
    return windows.trailing_context(c, ["conv_id"], [F.col("turn")], "c").drop("c")


@query("previous_turn", """
SELECT conv_id, turn, md5(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS prev FROM conversations""")
def previous_turn(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", "text")
    return windows.with_previous(c, ["conv_id"], [F.col("turn")], "text").select("conv_id", "turn", F.md5("prev").alias("prev"))


@query("fold_series", """
WITH RECURSIVE t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r AS (SELECT conv_id, turn, k, md5('' || text) AS result FROM t WHERE k = 1
  UNION ALL SELECT t.conv_id, t.turn, t.k, md5(r.result || t.text) FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1)
SELECT conv_id, turn, result FROM r""")
def fold_series(s, d):
    from hashlib import md5

    c = table(s, d, "conversations").select("conv_id", "turn", "text")
    got = windows.fold_series(c, "conv_id", ["turn"], "text", lambda prev, v: md5((prev + v).encode()).hexdigest())
    return got.select("conv_id", "turn", "result")


@query("round_robin_instruction", """
WITH t AS (SELECT conv_id, turn, regexp_matches(text, '[ABCD]\\.') AS mc FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY mc ORDER BY conv_id, turn) - 1 AS k FROM t)
SELECT conv_id, turn, CASE WHEN mc THEN ['Answer multiple-choice questions', 'Answer multiple-choice questions below',
  'Answer the following multiple-choice questions', 'Answer the multiple-choice questions'][(k % 4 + 1)::INT]
  ELSE ['Answer the question', 'Answer the following question', 'Answer the question below',
  'Provide the most relevant answer to specific question'][(k % 4 + 1)::INT] END AS instruction FROM r""")
def round_robin_instruction(s, d):
    from corpusloom.functions import fixed

    c = table(s, d, "conversations").select("conv_id", "turn", "text")
    got = windows.round_robin(
        c, text.is_multiple_choice("text"), [F.col("conv_id"), F.col("turn")],
        {True: fixed.CHOICE_INSTRUCTIONS, False: fixed.QUESTION_INSTRUCTIONS},
    )
    return got.select("conv_id", "turn", "instruction")


@query("batch_ids", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 30 AS batch FROM documents")
def batch_ids(s, d):
    return windows.with_batch_id(table(s, d, "documents").select("doc_id"), 30, ["doc_id"])


@query("row_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS row_id FROM orders")
def row_ids(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderdate")
    return filters.with_row_id(o, [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "row_id")


@query("drop_positions", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def drop_positions(s, d):
    bad = table(s, d, "labels").where("toxic = 1")
    return filters.drop_ids(table(s, d, "documents").select("doc_id", "lang"), bad, "doc_id")


@query("rotation_counts", """
SELECT (r // 100) AS file_idx, count(*) AS records, min(doc_id) AS first_id, max(doc_id) AS last_id
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) GROUP BY 1""")
def rotation_counts(s, d):
    r = writers.with_rotation(table(s, d, "documents").select("doc_id"), ["doc_id"], 100)
    return r.groupBy("file_idx").agg(
        F.count(F.lit(1)).alias("records"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )


@query("sample_n", "SELECT doc_id, lang FROM documents ORDER BY md5(doc_id || chr(1) || '42'), doc_id LIMIT 50")
def sample_n(s, d):
    return sampling.sample_n(table(s, d, "documents").select("doc_id", "lang"), 50, 42, "doc_id")


@query("sample_per_group", """
SELECT doc_id, source FROM (SELECT doc_id, source,
  row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || chr(1) || '7'), doc_id) AS k FROM documents) WHERE k <= 3""")
def sample_per_group(s, d):
    return sampling.sample_per_group(table(s, d, "documents").select("doc_id", "source"), ["source"], 3, 7, "doc_id")


@query("draw_with_replacement", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS at FROM documents),
n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT i AS draw, {UHASH.format("i || chr(1) || '5'")} % (SELECT n FROM n) AS at FROM range(200) t(i))
SELECT w.draw, r.doc_id FROM w JOIN r ON r.at = w.at""")
def draw_with_replacement(s, d):
    return sampling.draw_n(table(s, d, "documents").select("doc_id"), 200, 5, "doc_id").select("draw", "doc_id")


@query("hash_split", f"""
SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT doc_id, {UHASH.format("doc_id || chr(1) || '0'")}::DOUBLE / 4294967296 AS u FROM documents)""")
def hash_split(s, d):
    return sampling.hash_split(table(s, d, "documents").select("doc_id"), "doc_id", {"train": 0.8, "validation": 0.1, "test": 0.1})


@query("dataset_mix", f"""
SELECT 'docs' AS dataset, doc_id AS id FROM documents WHERE {UHASH.format("'docs' || chr(1) || doc_id || chr(1) || '3'")}::DOUBLE / 4294967296 < 0.7
UNION ALL
SELECT 'pages', page_id FROM pages WHERE {UHASH.format("'pages' || chr(1) || page_id || chr(1) || '3'")}::DOUBLE / 4294967296 < 0.3""")
def dataset_mix(s, d):
    parts = {
        "docs": table(s, d, "documents").select(F.col("doc_id").alias("id")),
        "pages": table(s, d, "pages").select(F.col("page_id").alias("id")),
    }
    return sampling.mix(parts, {"docs": 0.7, "pages": 0.3}, 3, "id")


@query("random_label", f"""
SELECT doc_id, ['a', 'b', 'c'][({UHASH.format("doc_id || chr(1) || '9'")} % 3 + 1)::INT] AS choice FROM documents""")
def random_label(s, d):
    return sampling.pick(table(s, d, "documents").select("doc_id"), ["a", "b", "c"], "doc_id", 9)


def _places(ordered):
    """Rows with the place they have in a sorted result: ids that rise with it, made dense."""
    return skew.dense_ids(ordered.withColumn("_at", F.monotonically_increasing_id()), ["_at"], "place").drop("_at")


@query("shuffled_rows", "SELECT doc_id, lang, row_number() OVER (ORDER BY md5(doc_id || chr(1) || '3407'), doc_id) - 1 AS place FROM documents")
def shuffled_rows(s, d):
    return _places(sampling.shuffle(table(s, d, "documents").select("doc_id", "lang"), 3407, "doc_id"))


@query("top_rows", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def top_rows(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return sampling.head(o, 20, [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("sorted_answers", """
SELECT l_orderkey AS question_id, l_quantity AS score, l_returnflag = 'R' AS is_accepted,
  row_number() OVER (ORDER BY l_orderkey DESC, l_quantity DESC, l_returnflag = 'R' DESC) - 1 AS place FROM lineitem""")
def sorted_answers(s, d):
    l = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("question_id"), F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").alias("is_accepted")
    )
    return _places(sampling.sort_answers(l))


@query("dedup_keep_one", "SELECT md5(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_keep_one(s, d):
    x = docs(s, d).select("doc_id", F.md5("text").alias("h"))
    return sets.dedup_exact(x, ["h"], [F.col("doc_id")])


@query("union_sources", """
SELECT 'doc' AS kind, doc_id AS id, lang, NULL AS url FROM documents
UNION ALL SELECT 'page', page_id, NULL, url FROM pages""")
def union_sources(s, d):
    a = table(s, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "lang")
    b = table(s, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url")
    return sets.union_all([a, b])


@query("exclude_subset", """
SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src3')""")
def exclude_subset(s, d):
    x = docs(s, d, "source").select("doc_id", "source", F.md5("text").alias("h"))
    return sets.exclude(x, x.where("source = 'src3'"), "h").select("doc_id")


_ANSWERS_SQL = """
WITH a AS (SELECT conv_id AS q, turn AS a, round(log2(length(text) % 16 + 1) + CASE WHEN turn % 3 = 0 THEN 1 ELSE -1 END, 9) AS sc
  FROM conversations WHERE role = 'assistant')"""


def _answers(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").where("role = 'assistant'")
    c = c.select(
        F.col("conv_id").alias("question_id"), F.col("turn").alias("answer_id"), F.col("text").alias("answer"),
        (F.length("text") % 16).alias("up_vote_count"), (F.col("turn") % 3 == 0).alias("is_accepted"),
    )
    return preference.with_preference_score(c).withColumn("pm_score", F.round("pm_score", 9))


@query("preference_pairs", _ANSWERS_SQL + """
SELECT x.q AS question_id, x.a AS answer_j, y.a AS answer_k FROM a x JOIN a y ON x.q = y.q AND x.sc > y.sc""")
def preference_pairs(s, d):
    return preference.preference_pairs(_answers(s, d)).select("question_id", "answer_j", "answer_k")


@query("preference_order", """
WITH a AS (SELECT l_orderkey AS question_id, l_partkey * 100 + l_linenumber AS answer_id, l_quantity AS sc FROM lineitem)
SELECT question_id, answer_id, rank() OVER (PARTITION BY question_id ORDER BY sc DESC) AS rank,
  count(*) OVER (PARTITION BY question_id) - count(*) OVER (PARTITION BY question_id ORDER BY sc DESC) AS n_worse FROM a""")
def preference_order(s, d):
    l = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("question_id"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("answer_id"),
        F.col("l_quantity").alias("pm_score"),
    )
    return preference.preference_order(l).select("question_id", "answer_id", "rank", "n_worse")


@query("preference_pairs_full", """
WITH a AS (SELECT c_nationkey AS q, c_custkey AS a, c_acctbal AS sc FROM customer)
SELECT x.q AS question_id, count(*) AS pairs, sum(hash_of(x.a, y.a)) AS h FROM a x JOIN a y ON x.q = y.q AND x.sc > y.sc GROUP BY x.q""".replace("hash_of(x.a, y.a)", "(x.a * 31 + y.a * 17) % 1009"))
def preference_pairs_full(s, d):
    """All pairs of questions with thousands of pairs, folded to one row each."""
    c = table(s, d, "customer").select(
        F.col("c_nationkey").alias("question_id"), F.col("c_custkey").alias("answer_id"), F.col("c_acctbal").alias("pm_score"), F.col("c_name").alias("answer"),
    )
    got = preference.preference_pairs(c)
    h = (F.col("answer_j") * 31 + F.col("answer_k") * 17) % 1009
    return got.groupBy("question_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(h).alias("h"))


@query("preference_pairs_capped", f"""
WITH a AS (SELECT l_orderkey AS q, l_partkey * 100000000 + l_suppkey * 1000 + l_linenumber AS a, l_quantity AS sc FROM lineitem),
p AS (SELECT q, a, sc, row_number() OVER (PARTITION BY q ORDER BY sc DESC, a) AS rn FROM a),
n AS (SELECT x.q, x.a AS j, y.a AS k, row_number() OVER (PARTITION BY x.q ORDER BY x.rn, y.rn) - 1 AS p,
        count(*) OVER (PARTITION BY x.q) AS total FROM p x JOIN p y ON x.q = y.q AND x.sc > y.sc),
m AS (SELECT *, least(total, 4) AS m FROM n),
t AS (SELECT *, ((p + 1) * m - 1) // total AS i FROM m),
w AS (SELECT *, (i * total) // m AS lo, ((i + 1) * total) // m - (i * total) // m AS width FROM t)
SELECT q AS question_id, j AS answer_j, k AS answer_k FROM w
WHERE p = lo + {UHASH.format("q || chr(1) || i")} % width""")
def preference_pairs_capped(s, d):
    l = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("question_id"),
        (F.col("l_partkey") * 100000000 + F.col("l_suppkey") * 1000 + F.col("l_linenumber")).alias("answer_id"),
        F.col("l_quantity").alias("pm_score"), F.col("l_returnflag").alias("answer"),
    )
    return preference.preference_pairs(l, max_pairs=4).select("question_id", "answer_j", "answer_k")


@query("score_filter", "SELECT doc_id, quality FROM labels WHERE quality >= 1 AND toxic < 1")
def score_filter(s, d):
    l = filters.filter_score(table(s, d, "labels"), "quality", ">=", 1)
    return filters.filter_score(l, "toxic", "<", 1).select("doc_id", "quality")


@query("null_routes", """
SELECT doc_id, CASE WHEN quality IS NULL THEN 'text' ELSE 'visual' END AS route FROM documents LEFT JOIN labels USING (doc_id)""")
def null_routes(s, d):
    j = table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left")
    return filters.route_by_null(j, "quality").select("doc_id", "route")


@query("epoch_times", "SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def epoch_times(s, d):
    e = table(s, d, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))
    return filters.epoch_to_ts(e, "ts")


@query("shaped_rows", """
SELECT p_partkey::VARCHAR AS id, p_name AS question, 'Answer the question' AS instruction, '' AS input FROM part""")
def shaped_rows(s, d):
    return filters.shape_instruction_rows(
        table(s, d, "part").select("p_partkey", "p_name", "p_brand"), {"p_partkey": "id", "p_name": "question"}, ["p_brand"],
        {"id": "string"}, {"instruction": "Answer the question", "input": ""},
    )


@query("map_key_counts", """
WITH e AS (SELECT unnest(json_keys(props)) AS value FROM events) SELECT value, count(*) AS n FROM e GROUP BY 1""")
def map_key_counts(s, d):
    e = table(s, d, "events").select(F.create_map(F.lit("props"), F.from_json("props", "map<string,string>")).alias("box"))
    return aggregates.map_key_counts(e, "box")


@query("map_flag_filter", """
SELECT event_id FROM events WHERE NOT (json_extract_string(props, '$.k') LIKE '%7%')""")
def map_flag_filter(s, d):
    e = table(s, d, "events").select(
        "event_id", F.create_map(F.lit("props"), F.from_json("props", "map<string,string>")).alias("box")
    )
    e = e.where(filters.has_map_key_like("box", "PROP"))
    return filters.filter_map_flag(e, "box", "K", "7").select("event_id")


@query("event_props", """
SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def event_props(s, d):
    e = table(s, d, "events")
    return e.select("event_id", "event_type", F.from_json("props", "k int")["k"].alias("k"))


@query("two_bounds", """
SELECT sum((w * 1.2::DOUBLE >= 90)::INT) AS at_least, sum((w * 1.2::DOUBLE <= 90)::INT) AS at_most
FROM (SELECT len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w FROM documents)""")
def two_bounds(s, d):
    return filters.count_by_length(docs(s, d), "text", 90)


@query("accepted_by_group", """
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_linenumber) AS k FROM lineitem) WHERE k = 1""")
def accepted_by_group(s, d):
    l = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return sampling.top_k(l, ["l_orderkey"], [F.desc("l_quantity"), F.col("l_partkey"), F.col("l_linenumber")], 1).select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )


@query("zip_by_id", "SELECT l.doc_id, d.lang, l.quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def zip_by_id(s, d):
    return joins.zip_by_id(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels").select("doc_id", "quality"), "doc_id")


@query("snapshot_keep_latest", """
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def snapshot_keep_latest(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return windows.keep_one(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


@query("running_positions", """
SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey,
  coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM lineitem""")
def running_positions(s, d):
    l = table(s, d, "lineitem").select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("qty")
    )
    # Three flags over the whole table: each group holds a third of all rows.
    got = skew.running_before(
        l, ["l_returnflag"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.col("qty"), "before",
        limit=10_000,
    )
    return got.drop("l_suppkey", "qty")
