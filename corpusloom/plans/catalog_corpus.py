"""Queries over near-duplicates, gazetteers, ranking and answer scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import fixed, text
from corpusloom.operators import evaluation, gazetteer, markup, neardup, nearindex, prompts, retrieval, scoring
from corpusloom.plans import packaging
from corpusloom.plans.catalog import docs, query, spread, table
from corpusloom.session import scratch_path

WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')"
TERMS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _shingles_sql(source: str, ngrams: int) -> str:
    """CTEs sh (id, s) and sz (id, n): distinct shingles of `source` (id, text), and their number."""
    return f"""src AS ({source}), wd AS (SELECT id, {WORDS.format('text')} AS w FROM src),
sh AS (SELECT DISTINCT id, s FROM (SELECT id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[]
  WHEN len(w) < {ngrams} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {ngrams - 2}), lambda i: array_to_string(w[i : i + {ngrams - 1}], ' ')) END) AS s FROM wd)),
sz AS (SELECT id, count(*) AS n FROM sh GROUP BY 1)"""


def near_dup_sql(source: str, levels: int = 5, ngrams: int = 10, threshold: float = 0.7) -> str:
    """CTEs over `source` (id, text) that end in near_gone(id, kept_id, similarity): all pairs by
    shared shingle, exact Jaccard, rows read in id order, `levels` steps of the greedy reading."""
    ctes = [
        f"src AS ({source})",
        "heads AS (SELECT text, min(id) AS id FROM src GROUP BY 1)",
        f"wd AS (SELECT id, {WORDS.format('text')} AS w FROM heads)",
        f"""sh AS (SELECT DISTINCT id, s FROM (SELECT id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[]
          WHEN len(w) < {ngrams} THEN [array_to_string(w, ' ')]
          ELSE list_transform(range(1, len(w) - {ngrams - 2}), lambda i: array_to_string(w[i : i + {ngrams - 1}], ' ')) END) AS s FROM wd))""",
        "sz AS (SELECT id, count(*) AS n FROM sh GROUP BY 1)",
        "co AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)",
        f"""ed AS MATERIALIZED (SELECT x, y, c / (p.n + q.n - c)::DOUBLE AS j FROM co JOIN sz p ON p.id = x JOIN sz q ON q.id = y
          WHERE c / (p.n + q.n - c)::DOUBLE >= {threshold})""",
        "k0 AS (SELECT id FROM heads WHERE id NOT IN (SELECT y FROM ed))",
        "g0 AS (SELECT DISTINCT y AS id FROM ed WHERE x IN (SELECT id FROM k0))",
    ]
    for i in range(1, levels):
        ctes += [
            f"""k{i} AS (SELECT id FROM k{i - 1} UNION SELECT id FROM heads WHERE id NOT IN (SELECT id FROM g{i - 1}) AND id NOT IN
              (SELECT y FROM ed WHERE x NOT IN (SELECT id FROM g{i - 1})))""",
            f"g{i} AS (SELECT id FROM g{i - 1} UNION SELECT y FROM ed WHERE x IN (SELECT id FROM k{i}))",
        ]
    last = levels - 1
    ctes += [
        f"""hit AS (SELECT y AS id, min(x) AS kept_id FROM ed WHERE x IN (SELECT id FROM k{last}) AND y IN (SELECT id FROM g{last}) GROUP BY 1)""",
        "near AS (SELECT h.id, h.kept_id, ed.j AS similarity FROM hit h JOIN ed ON ed.x = h.kept_id AND ed.y = h.id)",
        """near_gone AS (SELECT * FROM near UNION ALL
          SELECT s.id, coalesce(n.kept_id, h.id), coalesce(n.similarity, 1.0) FROM src s JOIN heads h ON h.text = s.text AND h.id <> s.id
          LEFT JOIN near n ON n.id = h.id)""",
    ]
    return ", ".join(ctes)


_DOCS = near_dup_sql("SELECT doc_id AS id, text FROM documents")


@query("near_dup_exact", f"WITH {_DOCS} SELECT id AS doc_id FROM src WHERE id NOT IN (SELECT id FROM near_gone)")
def near_dup_exact(s, d):
    return neardup.dedup_near(docs(s, d), "doc_id", "text", num_perm=None).select("doc_id")


@query("near_dup_pairs", f"WITH {_DOCS} SELECT id, kept_id, round(similarity, 6) AS similarity FROM near_gone")
def near_dup_pairs(s, d):
    got = neardup.near_duplicate_pairs(docs(s, d), "doc_id", "text", num_perm=None)
    return got.withColumn("similarity", F.round("similarity", 6))


@query("near_dup_lsh", f"WITH {_DOCS} SELECT id AS doc_id FROM src WHERE id NOT IN (SELECT id FROM near_gone)")
def near_dup_lsh(s, d):
    return neardup.dedup_near(docs(s, d), "doc_id", "text", num_perm=256).select("doc_id")


@query("minhash_index", f"""
WITH {_shingles_sql("SELECT doc_id AS id, text FROM documents", 10)},
cl AS (SELECT id, n, list(s ORDER BY s) AS cls FROM sh JOIN sz USING (id) GROUP BY id, n),
seen AS (SELECT cls, min(id) AS seen_id, count(*) AS n_seen FROM cl WHERE id IN (SELECT doc_id FROM labels) GROUP BY cls),
co AS (SELECT a.id, b.id AS seen_id, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s
  WHERE b.id IN (SELECT seen_id FROM seen) AND a.id NOT IN (SELECT doc_id FROM labels) GROUP BY 1, 2)
SELECT co.id, co.seen_id, round(c / (p.n + q.n - c)::DOUBLE, 6) AS similarity, n_seen
FROM co JOIN sz p ON p.id = co.id JOIN sz q ON q.id = co.seen_id JOIN seen ON seen.seen_id = co.seen_id WHERE c / (p.n + q.n - c)::DOUBLE >= 0.7""")
def minhash_index(s, d):
    # The index holds the labelled documents; the documents without labels come as a later batch.
    x, seen = docs(s, d), table(s, d, "labels").select("doc_id")
    path = scratch_path(s, "near-index")
    nearindex.build_index(x.join(seen, "doc_id", "left_semi"), path, "doc_id", "text")
    later = x.join(seen, "doc_id", "left_anti")
    return nearindex.match_index(later, path, "doc_id", "text").withColumn("similarity", F.round("similarity", 6))


@query("quality_gate", "WITH " + near_dup_sql("SELECT conv_id * 100 + turn AS id, text FROM conversations") + f""",
s AS (SELECT id, text, regexp_matches(text, '[ABCD]\\.') AS mc FROM src
  WHERE id NOT IN (SELECT id FROM near_gone) AND (id % 10) / 10.0::DOUBLE > 0.1::DOUBLE),
r AS (SELECT *, row_number() OVER (PARTITION BY mc ORDER BY id) - 1 AS k FROM s)
SELECT id, CASE WHEN mc THEN {list(fixed.CHOICE_INSTRUCTIONS)}[(k % 4 + 1)::INT] ELSE {list(fixed.QUESTION_INSTRUCTIONS)}[(k % 4 + 1)::INT] END AS instruction FROM r""")
def quality_gate(s, d):
    c = spread(table(s, d, "conversations"), "conv_id").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("input")
    )
    scores = c.select("id", (F.col("id") % 10 / 10.0).alias("score"))
    return scoring.quality_gate(c, scores, "id", num_perm=None).select("id", "instruction")


def _titles(s: SparkSession, d: str) -> DataFrame:
    """Navigation names of the crawled pages as titles, typed by a rule."""
    pages = spread(table(s, d, "pages"), "page_id")
    links = markup.harvest_links(pages.select("page_id", "url", "html"), container="nav")
    title = F.replace("link", F.lit("/"), F.lit(""))
    return links.select(
        F.concat_ws("-", "url", "pos").alias("doc_id"), title.alias("title"),
        F.when(F.length(title) % 2 == 0, F.lit("even")).otherwise(F.lit("odd")).alias("tag"),
    )


_TITLES = """
nav AS (SELECT url, string_split(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href="')[2:] AS parts FROM pages),
lk AS (SELECT url, generate_subscripts(parts, 1) - 1 AS pos, replace(string_split(unnest(parts), '"')[1], '/', '') AS title FROM nav),
dict AS (SELECT DISTINCT title, CASE WHEN length(title) % 2 = 0 THEN 'even' ELSE 'odd' END AS entity_type FROM lk WHERE title <> '')"""


@query("gazetteer_annotate", f"""
WITH {_TITLES}
SELECT doc_id, title, entity_type, (instr(text, title) - 1)::INT AS start_word, (instr(text, title) - 1 + length(title))::INT AS end_word
FROM documents JOIN dict ON contains(text, title)""")
def gazetteer_annotate(s, d):
    dictionary = gazetteer.tag_dictionary(_titles(s, d))
    return gazetteer.gazetteer_rows(docs(s, d), dictionary, "doc_id", "text")


@query("gazetteer_passages", """
SELECT doc_id, item_id, (instr(d.text, b.text) - 1)::INT AS start_word FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def gazetteer_passages(s, d):
    b = table(s, d, "benchmark").select(F.col("text").alias("title"), F.col("item_id").cast("string").alias("entity_type"))
    rows = gazetteer.gazetteer_rows(docs(s, d), b, "doc_id", "text")
    return rows.select("doc_id", F.col("entity_type").cast("bigint").alias("item_id"), "start_word")


@query("entity_prompts", f"""
WITH {_TITLES},
h AS (SELECT item_id, title, entity_type, instr(text, title) - 1 AS first_at FROM benchmark JOIN dict ON contains(text, title)),
e AS (SELECT item_id, '"' || title || '":' || chr(123) || '"start_word":' || first_at || ',"end_word":' || (first_at + length(title)) || ',"entity_type":"' || entity_type || '"' || chr(125) AS e, title FROM h)
SELECT md5(b.text) AS input, chr(123) || coalesce(string_agg(e, ',' ORDER BY title), '') || chr(125) AS response
FROM benchmark b LEFT JOIN e USING (item_id) GROUP BY b.item_id, b.text""")
def entity_prompts(s, d):
    got = gazetteer.annotate_gazetteer(table(s, d, "benchmark"), gazetteer.tag_dictionary(_titles(s, d)), "item_id", "text")
    return gazetteer.entity_prompts(got, "text").select(F.md5("input").alias("input"), "response")


@query("search_by_title", f"""
WITH {_TITLES}
SELECT query_id, doc_id, title, pos FROM (
  SELECT item_id AS query_id, url || '-' || pos AS doc_id, title,
    row_number() OVER (PARTITION BY item_id ORDER BY length(title) DESC, url || '-' || pos) AS pos
  FROM benchmark JOIN lk ON title <> '' AND contains(text, title)) WHERE pos <= 5""")
def search_by_title(s, d):
    q = table(s, d, "benchmark").withColumnRenamed("item_id", "query_id")
    return retrieval.search_by_title(_titles(s, d).drop("tag").where("title <> ''"), q, 5).select("query_id", "doc_id", "title", "pos")


_BM25 = f"""
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TERMS.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
w AS (SELECT doc_id, {TERMS.format('text')} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
tf AS (SELECT doc_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
    / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term), st GROUP BY 1, 2),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos FROM sc)"""


def _bm25(s: SparkSession, d: str, k: int) -> DataFrame:
    return retrieval.bm25(docs(s, d), table(s, d, "benchmark"), k, query_id="item_id")


@query("bm25_topk", f"WITH {_BM25} SELECT query_id, doc_id, round(score, 4) AS score, pos FROM hits WHERE pos <= 10")
def bm25_topk(s, d):
    return _bm25(s, d, 10).withColumn("score", F.round("score", 4))


@query("rag_prompt", f"""
WITH {_BM25},
b AS (SELECT query_id, string_agg(pos || '. ' || text, chr(10) ORDER BY pos) AS background FROM hits JOIN documents USING (doc_id) WHERE pos <= 2 GROUP BY 1)
SELECT item_id AS query_id, md5('Question: ' || text || chr(10) || 'Background:' || chr(10) || coalesce(background, '') || chr(10)) AS prompt
FROM benchmark LEFT JOIN b ON query_id = item_id""")
def rag_prompt(s, d):
    background = retrieval.hit_lists(_bm25(s, d, 2), docs(s, d), 2)
    got = retrieval.build_rag_prompt(
        table(s, d, "benchmark"), background, "Question: {query}\nBackground:\n{background}\n{context}", query_id="item_id"
    )
    return got.withColumn("prompt", F.md5("prompt"))


@query("prefix_suggest", "SELECT DISTINCT p_name AS title FROM part WHERE lower(p_name) LIKE 'sm%' ORDER BY 1 LIMIT 5")
def prefix_suggest(s, d):
    return retrieval.suggest(table(s, d, "part").select(F.col("p_name").alias("title")), "Sm", 5)


@query("eval_sample", """
WITH t AS (SELECT DISTINCT o_custkey::VARCHAR AS title FROM orders ORDER BY md5(o_custkey::VARCHAR || chr(1) || '4241'), 1 LIMIT 20)
SELECT o_custkey::VARCHAR AS title, 0 AS piece, count(*) AS total_answers,
  string_agg(o_orderkey || o_orderstatus || o_orderpriority, ';' ORDER BY o_orderkey) AS answers
FROM orders WHERE o_custkey::VARCHAR IN (SELECT title FROM t) GROUP BY 1""")
def eval_sample(s, d):
    o = table(s, d, "orders").select(
        F.col("o_custkey").cast("string").alias("title"), F.col("o_orderkey").alias("answer_id"),
        F.col("o_orderstatus").alias("body"), F.col("o_orderpriority").alias("body_markdown"),
    )
    got = retrieval.eval_sample(o)
    show = F.transform("answers", lambda a: F.concat(a["answer_id"].cast("string"), a["body"], a["body_markdown"]))
    return got.select("title", "piece", "total_answers", F.array_join(show, ";").alias("answers"))


def turn_pairs(s: SparkSession, d: str) -> DataFrame:
    """Each user turn with the assistant turn right after it."""
    c = table(s, d, "conversations")
    u = spread(c, "conv_id").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"]).withColumn("id", F.col("conv_id") * 100 + F.col("turn"))


_PAIRS = """
pr AS (SELECT u.conv_id * 100 + u.turn AS id, u.text AS question, a.text AS answer FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""


@query("choice_accuracy", """
SELECT toxic, count(*) AS n, round(avg((CASE p WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END = quality)::INT), 6) AS accuracy
FROM (SELECT toxic, quality, doc_id % 4 AS p FROM labels) GROUP BY 1""")
def choice_accuracy(s, d):
    p = F.col("doc_id") % 4
    l = table(s, d, "labels").select(
        "toxic", F.when(p == 0, F.lit("A")).when(p == 1, F.lit(" B\n")).when(p == 2, F.lit("b")).otherwise(F.lit("Answer")).alias("pred"),
        F.when(F.col("quality") == 0, F.lit("A")).otherwise(F.lit("B")).alias("ref"),
    )
    return evaluation.choice_accuracy(l, "pred", "ref", ["toxic"]).withColumn("accuracy", F.round("accuracy", 6))


@query("token_overlap", f"""
WITH {_PAIRS}, t AS (SELECT list_distinct({WORDS.format('question')}) AS r, list_distinct({WORDS.format('answer')}) AS h FROM pr)
SELECT count(*) AS n, round(avg(CASE WHEN len(h) = 0 THEN 0 ELSE len(list_intersect(h, r))::DOUBLE / len(h) END), 8) AS overlap FROM t""")
def token_overlap(s, d):
    return evaluation.token_overlap(turn_pairs(s, d), "question", "answer").withColumn("overlap", F.round("overlap", 8))


def _bleu_words(c: str) -> str:
    s = f"replace(replace({c}, '-' || chr(10), ''), chr(10), ' ')"
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = f"replace({s}, '{a}', '{b}')"
    s = f"' ' || {s} || ' '"
    for pat, to in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "),
    ):
        s = f"regexp_replace({s}, '{pat}', '{to}', 'g')"
    return WORDS.format(s)


def _gram_sql(words: str, n: int) -> str:
    return f"CASE WHEN len({words}) >= {n} THEN list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i : i + {n - 1}], ' ')) ELSE []::VARCHAR[] END"


def _clip_sql(orders) -> str:
    side = lambda w: " UNION ALL ".join(f"SELECT id, {n} AS n, unnest({_gram_sql(w, n)}) AS g FROM tk" for n in orders)
    return f"""
hc AS (SELECT id, n, g, count(*) AS c FROM ({side('h')}) GROUP BY 1, 2, 3),
rc AS (SELECT id, n, g, count(*) AS c FROM ({side('f')}) GROUP BY 1, 2, 3),
cl AS (SELECT hc.id, hc.n, sum(least(hc.c, rc.c)) AS clip FROM hc JOIN rc ON hc.id = rc.id AND hc.n = rc.n AND hc.g = rc.g GROUP BY 1, 2)"""


_BLEU = f"""
WITH {_PAIRS}, tk AS (SELECT id, {_bleu_words('answer')} AS h, {_bleu_words('question')} AS f FROM pr), {_clip_sql((1, 2, 3, 4))},
tot AS (SELECT n, sum(greatest(len(h) - n + 1, 0)) AS total, sum(len(h)) AS hyp_len, sum(len(f)) AS ref_len FROM tk, (SELECT unnest([1, 2, 3, 4]) AS n) GROUP BY 1),
bc AS (SELECT tot.n, coalesce(m, 0) AS matches, total, hyp_len, ref_len FROM tot LEFT JOIN (SELECT n, sum(clip) AS m FROM cl GROUP BY 1) x USING (n))"""


@query("corpus_bleu_counts", _BLEU + "SELECT n, matches::BIGINT AS matches, total::BIGINT AS total, hyp_len::BIGINT AS hyp_len, ref_len::BIGINT AS ref_len FROM bc")
def corpus_bleu_counts(s, d):
    return evaluation.bleu_counts(turn_pairs(s, d), "id", "question", "answer")


@query("corpus_bleu", _BLEU + """
, z AS (SELECT min(matches) AS low, avg(CASE WHEN matches > 0 THEN ln(matches / total::DOUBLE) END) AS lg, max(hyp_len) AS h, max(ref_len) AS r FROM bc)
SELECT round(CASE WHEN low > 0 THEN exp(lg) * CASE WHEN h > r THEN 1 ELSE exp(1 - r / h::DOUBLE) END ELSE 0 END, 8)::DOUBLE AS bleu,
  round(CASE WHEN h > r THEN 1 ELSE exp(1 - r / h::DOUBLE) END, 8)::DOUBLE AS brevity_penalty, h::BIGINT AS hyp_len, r::BIGINT AS ref_len FROM z""")
def corpus_bleu(s, d):
    got = evaluation.corpus_bleu(turn_pairs(s, d), "id", "question", "answer")
    return got.withColumns({"bleu": F.round("bleu", 8), "brevity_penalty": F.round("brevity_penalty", 8)})


@query("rouge_12", f"""
WITH {_PAIRS}, tk AS (SELECT id, list_filter(string_split_regex(lower(answer), '[^a-z0-9]+'), lambda x: x <> '') AS h,
  list_filter(string_split_regex(lower(question), '[^a-z0-9]+'), lambda x: x <> '') AS f FROM pr), {_clip_sql((1, 2))},
s AS (SELECT tk.id, len(h) AS lh, len(f) AS lf, coalesce((SELECT clip FROM cl WHERE cl.id = tk.id AND cl.n = 1), 0)::DOUBLE AS c1,
  coalesce((SELECT clip FROM cl WHERE cl.id = tk.id AND cl.n = 2), 0)::DOUBLE AS c2 FROM tk)
SELECT count(*) AS n, round(avg(CASE WHEN c1 = 0 THEN 0 ELSE 2 * (c1 / lh) * (c1 / lf) / (c1 / lh + c1 / lf) END), 8) AS rouge1,
  round(avg(CASE WHEN c2 = 0 THEN 0 ELSE 2 * (c2 / (lh - 1)) * (c2 / (lf - 1)) / (c2 / (lh - 1) + c2 / (lf - 1)) END), 8) AS rouge2 FROM s""")
def rouge_12(s, d):
    got = evaluation.rouge(turn_pairs(s, d), "id", "question", "answer", with_lcs=False)
    return got.withColumns({"rouge1": F.round("rouge1", 8), "rouge2": F.round("rouge2", 8)})


# Longest common subsequences row by row: of the table's row for one more word of the answer, each place is the greatest candidate up to it,
# one more than the place before in the last row where the words agree, else the same place in the last row.
@query("rouge_all", f"""
WITH RECURSIVE {_PAIRS}, tk AS (SELECT id, list_filter(string_split_regex(lower(answer), '[^a-z0-9]+'), lambda x: x <> '') AS h,
  list_filter(string_split_regex(lower(question), '[^a-z0-9]+'), lambda x: x <> '') AS f FROM pr), {_clip_sql((1, 2))},
lcs AS (SELECT id, h, f, 0 AS i, list_transform(f, lambda x: 0) AS line FROM tk
  UNION ALL SELECT id, h, f, i + 1, list_transform(range(1, len(f) + 1), lambda j: list_max(list_transform(range(1, j + 1),
    lambda k: CASE WHEN h[i + 1] = f[k] THEN 1 + CASE WHEN k > 1 THEN line[k - 1] ELSE 0 END ELSE line[k] END))) FROM lcs WHERE i < len(h)),
s AS (SELECT tk.id, len(h) AS lh, len(f) AS lf, coalesce((SELECT clip FROM cl WHERE cl.id = tk.id AND cl.n = 1), 0)::DOUBLE AS c1,
  coalesce((SELECT clip FROM cl WHERE cl.id = tk.id AND cl.n = 2), 0)::DOUBLE AS c2, coalesce((SELECT line[-1] FROM lcs WHERE lcs.id = tk.id AND lcs.i = len(tk.h)), 0)::DOUBLE AS cl FROM tk)
SELECT count(*) AS n, round(avg(CASE WHEN c1 = 0 THEN 0 ELSE 2 * (c1 / lh) * (c1 / lf) / (c1 / lh + c1 / lf) END), 8) AS rouge1,
  round(avg(CASE WHEN c2 = 0 THEN 0 ELSE 2 * (c2 / (lh - 1)) * (c2 / (lf - 1)) / (c2 / (lh - 1) + c2 / (lf - 1)) END), 8) AS rouge2,
  round(avg(CASE WHEN cl = 0 THEN 0 ELSE 2 * (cl / lh) * (cl / lf) / (cl / lh + cl / lf) END), 8) AS "rougeL" FROM s""")
def rouge_all(s, d):
    got = evaluation.rouge(turn_pairs(s, d), "id", "question", "answer")
    return got.withColumns({c: F.round(c, 8) for c in ("rouge1", "rouge2", "rougeL")})


@query("judge_prompts", f"""
WITH {_PAIRS} SELECT id, 'recall' AS metric, md5('Q ' || question || ' D ' || id || chr(10)) AS prompt FROM pr
UNION ALL SELECT id, 'precision', md5('Q ' || question || ' R ' || answer || ' H  D ' || id || chr(10)) FROM pr""")
def judge_prompts(s, d):
    p = turn_pairs(s, d).withColumns({"background": F.col("id").cast("string"), "context": F.lit("")})
    got = packaging.judge_prompts(p, {"recall": "Q {query} D {FullBody}", "precision": "Q {query} R {reply} H {history} D {FullBody}"}, "id")
    return got.withColumn("prompt", F.md5("prompt"))


@query("judge_means", """
SELECT event_type AS metric, count(k) AS n, round(avg(k), 6) AS mean_score
FROM (SELECT event_type, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INT) % 5 + 1 END AS k FROM events) GROUP BY 1""")
def judge_means(s, d):
    verdict = F.from_json("props", "k int")["k"] % 5 + 1
    e = table(s, d, "events").select(
        F.col("event_type").alias("metric"), F.struct(F.when(F.col("event_id") % 7 != 0, verdict).alias("score")).alias("verdict")
    )
    return evaluation.judge_means(e).withColumn("mean_score", F.round("mean_score", 6))


@query("format_guidelines", """
SELECT conv_id, turn, md5('Be brief' || chr(10) || ' ### Instruction Examples: ' || chr(10) || 'Do it' || chr(10) || chr(10)
  || 'Answer as {"properties": {"a": {"type": "string"}}}' || text) AS h FROM conversations""")
def format_guidelines(s, d):
    t = prompts.with_format_guideline(
        [{"name": "x", "guideline": "Be brief", "examples": ["Do it"], "schema": {"title": "T", "type": "object", "properties": {"a": {"type": "string"}}}}],
        "Answer as {schema}",
    )[0]
    c = table(s, d, "conversations")
    return c.select("conv_id", "turn", F.md5(text.render("{g}{t}", g=F.lit(t["guideline"]), t="text")).alias("h"))
