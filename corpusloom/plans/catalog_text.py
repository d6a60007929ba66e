"""Queries over text functions, chunking, prompts and chat rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import fixed, text
from corpusloom.operators import aggregates, chunking, filters, joins, prompts, scoring, windows
from corpusloom.plans import answers, packaging
from corpusloom.plans.catalog import docs, query, spread, table
from corpusloom.plans.catalog_corpus import near_dup_sql

WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')"
NW = "len(" + WORDS + ")"
KEYWORDS = ("the", "und", "les", "license", "que", "apache", "red moon")
DENY = ("apache license", "mit license", "general public license", "the, anea", "Licensed under")
UHASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


@query("token_floor", f"""
SELECT doc_id, round(w * 1.2::DOUBLE, 4) AS tokens FROM (SELECT doc_id, {NW.format('text')} AS w FROM documents)
WHERE w > 0 AND w * 1.2::DOUBLE >= 50""")
def token_floor(s, d):
    return filters.filter_min_tokens(docs(s, d), "text", 50).select("doc_id", F.round(text.est_tokens("text"), 4).alias("tokens"))


@query("truncate_words", f"""
SELECT doc_id, md5(CASE WHEN len(w) * 1.2::DOUBLE > 100 THEN array_to_string(w[1:100], ' ') ELSE text END) AS h
FROM (SELECT doc_id, text, {WORDS.format('text')} AS w FROM documents)""")
def truncate_words(s, d):
    return docs(s, d).select("doc_id", F.md5(text.truncate_words("text", 100)).alias("h"))


@query("clean_text", r"""
SELECT doc_id, md5(lower(trim(replace(regexp_replace(regexp_replace(text, '\n+', chr(10), 'g'), '#+', ' ', 'g'), chr(10), ' ')))) AS h
FROM documents""")
def clean_text(s, d):
    c = text.clean_text("text", ["newlines", "hashes", "one_line", "strip", "lower"])
    return docs(s, d).select("doc_id", F.md5(c).alias("h"))


@query("html_to_text", r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
  '<script\b[^>]*>.*?</script\s*>', '', 'gis'), '<style\b[^>]*>.*?</style\s*>', '', 'gis') AS h FROM pages)
SELECT page_id, md5(replace(replace(replace(replace(replace(replace(regexp_replace(h, '</?[A-Za-z!][^>]*>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')) AS h FROM a""")
def html_to_text(s, d):
    p = spread(table(s, d, "pages").select("page_id", "html"), "page_id")
    return p.select("page_id", F.md5(text.html_to_text("html")).alias("h"))


@query("keyword_filter", f"""
SELECT doc_id, lang FROM documents WHERE list_has_any({WORDS.format('lower(text)')}, {_sql_list(KEYWORDS)})""")
def keyword_filter(s, d):
    return filters.filter_keywords(docs(s, d, "lang"), "text", KEYWORDS).select("doc_id", "lang")


@query("matched_keywords", f"""
WITH k AS (SELECT unnest({_sql_list(sorted(set(KEYWORDS)))}) AS w),
t AS (SELECT doc_id, lower(text) AS low, {WORDS.format('lower(text)')} AS ws FROM documents)
SELECT doc_id, coalesce(string_agg(w, ',' ORDER BY w) FILTER (list_contains(ws, w)), '') AS token_hits,
  coalesce(string_agg(w, ',' ORDER BY w) FILTER (contains(low, w)), '') AS substring_hits
FROM t, k GROUP BY 1""")
def matched_keywords(s, d):
    x = filters.matched_keywords(docs(s, d), "text", KEYWORDS, "token", "t")
    x = filters.matched_keywords(x, "text", KEYWORDS, "substring", "u")
    return x.select("doc_id", F.array_join("t", ",").alias("token_hits"), F.array_join("u", ",").alias("substring_hits"))


@query("denylist_filter", f"""
SELECT doc_id FROM documents WHERE len(list_filter({_sql_list(DENY)}, lambda p: contains(lower(text), lower(p)))) = 0""")
def denylist_filter(s, d):
    return filters.filter_denylist(docs(s, d), "text", DENY).select("doc_id")


@query("length_stats", f"""
SELECT lang, count(*) AS n, round(min(v), 4) AS min, round(max(v), 4) AS max, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std,
{", ".join(f"round(quantile_cont(v, {p / 100}), 4) AS p{p}" for p in fixed.LENGTH_PERCENTILES)}
FROM (SELECT lang, {NW.format('text')} * 1.2::DOUBLE AS v FROM documents) GROUP BY 1""")
def length_stats(s, d):
    got = aggregates.length_stats(docs(s, d, "lang"), "text", ["lang"])
    return got.select("lang", "n", *[F.round(c, 4).alias(c) for c in got.columns if c not in ("lang", "n")])


@query("prompt_lengths", f"""
SELECT count(*) AS n, round(avg(w), 4) AS avg_words, min(w) AS min_words, max(w) AS max_words
FROM (SELECT {NW.format('text')} AS w FROM conversations)""")
def prompt_lengths(s, d):
    got = aggregates.prompt_length_summary(table(s, d, "conversations"), "text")
    return got.withColumn("avg_words", F.round("avg_words", 4))


@query("token_cost", f"""
WITH t AS (SELECT count(*) AS n, sum({NW.format('text')}) * 1.2::DOUBLE AS tokens_in FROM documents),
p(model, pin, pout) AS (VALUES {", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, a, b in fixed.PRICES)})
SELECT model, n, round(tokens_in, 2) AS tokens_in, round(pin * tokens_in / 1e6 + pout * 2048 * n / 1e6, 6) AS cost FROM t, p""")
def token_cost(s, d):
    got = aggregates.estimate_cost(docs(s, d), "text", 2048)
    return got.withColumns({"tokens_in": F.round("tokens_in", 2), "cost": F.round("cost", 6)})


@query("funnel_counts", f"""
WITH a AS (SELECT doc_id, text FROM documents),
b AS (SELECT * FROM a WHERE {NW.format('text')} * 1.2::DOUBLE >= 50),
c AS (SELECT * FROM b WHERE len(list_filter({_sql_list(DENY)}, lambda p: contains(lower(text), lower(p)))) = 0)
SELECT 0 AS pos, 'read' AS step, count(*) AS n FROM a UNION ALL SELECT 1, 'floor', count(*) FROM b
UNION ALL SELECT 2, 'deny', count(*) FROM c UNION ALL SELECT 3, 'distinct', count(DISTINCT text) FROM c""")
def funnel_counts(s, d):
    steps = {"floor": filters.min_tokens("text", 50), "deny": ~filters.is_denied("text", DENY)}
    return aggregates.funnel(docs(s, d), steps, distinct=("distinct", F.md5("text")))


def _sections(s, d):
    """A document's lines as its sections, its source as the title."""
    x = docs(s, d, "source")
    return x.select(
        F.col("doc_id").alias("page_id"), F.col("source").alias("title"), F.posexplode(F.split("text", "\n")).alias("pos", "content")
    ).select("page_id", "title", "pos", F.concat(F.lit("line "), F.col("pos").cast("string")).alias("heading"), "content")


_CHUNKS = """
WITH s AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS content FROM documents),
w AS (SELECT *, """ + WORDS.format("content") + """ AS ws FROM s),
c AS (SELECT doc_id, source, pos, i AS no, array_to_string(ws[i * {step} + 1 : (i + 1) * {step}], ' ') AS chunk,
        len(ws[i * {step} + 1 : (i + 1) * {step}]) AS n
      FROM w, LATERAL (SELECT unnest(range((len(ws) + {step} - 1) // {step})) AS i) WHERE len(ws) > 0)"""


@query("section_chunks", _CHUNKS.format(step=30) + f"""
SELECT doc_id AS page_id, pos, no AS chunk_no,
  CASE WHEN {UHASH.format("doc_id || chr(1) || pos || chr(1) || no || chr(1) || '0'")} % 2 = 0 THEN 'line ' || pos || ' of ' || source
    ELSE source || '''s line ' || pos END AS input,
  {_sql_list(fixed.TOPIC_INSTRUCTIONS)}[({UHASH.format("doc_id || chr(1) || pos || chr(1) || no || chr(1) || '1'")} % 4 + 1)::INT] AS instruction,
  md5(regexp_replace(chunk, '#+', ' ', 'g')) AS response
FROM c WHERE n * 1.2::DOUBLE >= 12""")
def section_chunks(s, d):
    return chunking.section_chunks(_sections(s, d), 40, 10, 12).withColumn("response", F.md5("response"))


@query("section_windows_overlapping", f"""
WITH s AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents)
SELECT doc_id AS page_id, i AS chunk_no, md5(regexp_replace(array_to_string(ws[i * 300 + 1 : i * 300 + 400], ' '), '#+', ' ', 'g')) AS response
FROM s, LATERAL (SELECT unnest(range((len(ws) + 299) // 300)) AS i) WHERE len(ws[i * 300 + 1 : i * 300 + 400]) * 1.2::DOUBLE >= 30""")
def section_windows_overlapping(s, d):
    x = docs(s, d, "source").select(
        F.col("doc_id").alias("page_id"), F.col("source").alias("title"), F.lit(0).alias("pos"), F.lit("x").alias("heading"),
        F.col("text").alias("content"),
    )
    return chunking.section_chunks(x, 400, 100, 30, true_overlap=True).select("page_id", "chunk_no", F.md5("response").alias("response"))


@query("packed_chunks", f"""
WITH RECURSIVE d AS (SELECT doc_id, source AS title, string_split(text, chr(10)) AS secs, text FROM documents),
f AS (SELECT doc_id, title, secs, title || ', ' || secs[1] || ', ' || text AS whole, secs[1] AS summary FROM d),
big AS (SELECT * FROM f WHERE {NW.format('whole')} * 1.2::DOUBLE >= 300),
s AS (SELECT doc_id, generate_subscripts(secs, 1) AS i, unnest(secs) AS content FROM big),
t AS (SELECT doc_id, i, content, {NW.format('content')} * 1.2::DOUBLE AS t FROM s),
h AS (SELECT doc_id, title, summary, len(secs) AS last, secs FROM big),
-- one row per (document, section): the pack it lands in and the running estimate
st AS (
  SELECT doc_id, 0 AS i, 0::BIGINT AS pack,
    {NW.format(f"(CASE WHEN {UHASH.format("doc_id || chr(1) || '0' || chr(1) || '0'")} % 2 = 0 THEN title || '.' || summary ELSE title END)")} * 1.2::DOUBLE AS tok
  FROM h
  UNION ALL
  SELECT st.doc_id, t.i,
    CASE WHEN st.tok + t.t > 300 THEN st.pack + 1 ELSE st.pack END,
    CASE WHEN st.tok + t.t > 300 THEN {NW.format(f"(CASE WHEN {UHASH.format("st.doc_id || chr(1) || (st.pack + 1) || chr(1) || '0'")} % 2 = 0 THEN h.title || '.' || h.summary ELSE h.title END)")} * 1.2::DOUBLE + t.t
      ELSE st.tok + t.t END
  FROM st JOIN t ON t.doc_id = st.doc_id AND t.i = st.i + 1 JOIN h ON h.doc_id = st.doc_id),
p AS (SELECT h.doc_id, h.title, p.pack,
    (CASE WHEN {UHASH.format("h.doc_id || chr(1) || p.pack || chr(1) || '0'")} % 2 = 0 THEN h.title || '.' || h.summary ELSE h.title END)
    || ' ' || coalesce(p.body, '') AS body
  FROM h JOIN (SELECT st.doc_id, st.pack, string_agg(t.content, ' ' ORDER BY t.i) AS body
    FROM st LEFT JOIN t ON t.doc_id = st.doc_id AND t.i = st.i GROUP BY 1, 2) p ON p.doc_id = h.doc_id),
allp AS (SELECT doc_id, title, pack, body FROM p UNION ALL
  SELECT doc_id, title, 0, whole FROM f WHERE {NW.format('whole')} * 1.2::DOUBLE < 300),
w AS (SELECT *, {WORDS.format('body')} AS ws FROM allp),
c AS (SELECT doc_id, pack, no, title || ', ' || array_to_string(ws[no * 200 + 1 : (no + 1) * 200], ' ') AS input
  FROM w, LATERAL (SELECT unnest(range((len(ws) + 199) // 200)) AS no))
SELECT doc_id AS page_id, pack, no AS chunk_no, md5(input) AS input FROM c WHERE {NW.format('input')} * 1.2::DOUBLE >= 5""")
def packed_chunks(s, d):
    x = docs(s, d, "source").select(
        F.col("doc_id").alias("page_id"), F.col("source").alias("title"), F.split("text", "\n").alias("_l"), "text"
    ).select(
        "page_id", "title", F.get("_l", F.lit(0)).alias("summary"), "text",
        F.transform("_l", lambda l, i: F.struct(i.cast("string").alias("heading"), l.alias("content"))).alias("sections"),
        F.lit("").alias("infobox_text"),
    )
    return chunking.packed_chunks(x, 300, 100, 5).select("page_id", "pack", "chunk_no", F.md5("input").alias("input"))


def _sweep_rows_sql(length: int, overlap: int) -> str:
    return f"""SELECT {length} AS context_length, {overlap} AS overlap, doc_id, pos, no, n, input, instruction, response,
  {NW.format('input || instruction || response')} * 1.2::DOUBLE > {length} AS over_length FROM (
  SELECT doc_id, pos, no, n, CASE WHEN {UHASH.format("doc_id || chr(1) || pos || chr(1) || no || chr(1) || '0'")} % 2 = 0 THEN 'line ' || pos || ' of ' || source
    ELSE source || '''s line ' || pos END AS input,
  {_sql_list(fixed.TOPIC_INSTRUCTIONS)}[({UHASH.format("doc_id || chr(1) || pos || chr(1) || no || chr(1) || '1'")} % 4 + 1)::INT] AS instruction,
  regexp_replace(chunk, '#+', ' ', 'g') AS response
  FROM ({_CHUNKS.format(step=max(length - overlap, 1))} SELECT * FROM c WHERE n * 1.2::DOUBLE >= 12))"""


_SWEEP = " UNION ALL ".join(_sweep_rows_sql(n, o) for n in (30, 80) for o in (10, 20, 30, 40, 50, 60, 70, 80) if o - 10 < n)
# Rows of the overlap taken for each length: the first without a row over it, or the last there is.
_SWEPT = f"""tried AS MATERIALIZED ({_SWEEP}),
taken AS (SELECT context_length, coalesce(min(overlap) FILTER (NOT over), max(overlap)) AS overlap FROM (
  SELECT t.context_length, t.overlap, coalesce(bool_or(over_length), FALSE) AS over FROM
    (VALUES {", ".join(f"({n}, {o})" for n in (30, 80) for o in (10, 20, 30, 40, 50, 60, 70, 80) if o - 10 < n)}) t(context_length, overlap)
    LEFT JOIN tried USING (context_length, overlap) GROUP BY 1, 2) GROUP BY 1),
rows AS (SELECT tried.* FROM tried JOIN taken USING (context_length, overlap)
  WHERE n >= 12 AND len(list_filter({_sql_list(('line 7 of', "3's line 9"))}, lambda q: contains(lower(input), lower(q)))) = 0)"""
_SWEEP_ID = "lpad(context_length::VARCHAR, 10, '0') || '-' || doc_id || '-' || lpad(pos::VARCHAR, 10, '0') || '-' || lpad(no::VARCHAR, 10, '0')"


@query("chunk_sweep", f"WITH {_SWEPT}, " + near_dup_sql(f"""SELECT {_SWEEP_ID} AS id,
  array_to_string(list_transform({WORDS.format('response')}, lambda w: context_length || ':' || w), ' ') AS text FROM rows""") + f"""
SELECT context_length, overlap, over_length, doc_id AS page_id, pos, no AS chunk_no, md5(response) AS response FROM rows
WHERE {_SWEEP_ID} NOT IN (SELECT id FROM near_gone)""")
def chunk_sweep(s, d):
    """Two lengths, one that a cut fits and one so short that its rows stay over it; near-duplicate responses out."""
    got = chunking.chunk_sweep(_sections(s, d), (30, 80), 12, ("line 7 of", "3's line 9"), first_overlap=10, grow=10, num_perm=None)
    return got.select("context_length", "overlap", "over_length", "page_id", "pos", "chunk_no", F.md5("response").alias("response"))


_TEMPLATES = (
    ("summary", "Summarize the passage", "Be concise"),
    ("question", "Write a question about the passage", "One line"),
    ("title", "Write a title", "Be brief"),
)
_BODY = f"(CASE WHEN len(w) * 1.2::DOUBLE > 200 THEN array_to_string(w[1:200], ' ') ELSE trim(text, ' ' || chr(10) || chr(9) || chr(13)) END)"
_RENDER = "md5(chr(10) || '### Instruction' || chr(10) || {i} || chr(10) || '### Guideline' || chr(10) || {g} || chr(10) || '### Input' || chr(10) || {b} || chr(10) || '### Response' || chr(10) || chr(10))"


@query("prompt_factory", f"""
WITH t(name, i, g) AS (VALUES {", ".join(str(t) for t in _TEMPLATES)}),
d AS (SELECT doc_id, text, {WORDS.format('text')} AS w FROM documents),
x AS (SELECT doc_id, name, {_RENDER.format(i="i", g="g", b=_BODY)} AS prompt,
  row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || chr(1) || name || chr(1) || '0')) AS k FROM d, t)
SELECT doc_id, name, prompt FROM x WHERE k <= 2""")
def prompt_factory(s, d):
    got = packaging.prompt_factory(docs(s, d), _TEMPLATES, "doc_id", "text", 200, 2)
    return got.withColumn("prompt", F.md5("prompt"))


@query("cross_templates", f"""
SELECT conv_id, turn, name FROM conversations, (VALUES {", ".join(str(t) for t in _TEMPLATES)}) t(name, i, g)""")
def cross_templates(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn")
    return joins.cross_templates(c, list(_TEMPLATES), ["name", "i", "g"]).select("conv_id", "turn", "name")


@query("expand_by_group", f"""
WITH m(tag, grp) AS (VALUES ('en', 'a'), ('en', 'b'), ('fr', 'b'), ('de', 'c')),
t(grp, name) AS (VALUES ('a', 'x'), ('b', 'y'), ('b', 'z'))
SELECT doc_id, grp AS "group", name, {_RENDER.format(i="'do ' || name", g="''", b="source || chr(10) || lang")} AS prompt
FROM documents JOIN m ON m.tag = lang JOIN t USING (grp)""")
def expand_by_group(s, d):
    tags = s.createDataFrame([("en", "a"), ("en", "b"), ("fr", "b"), ("de", "c")], "tag string, `group` string")
    tmpl = s.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "`group` string, name string")
    tmpl = tmpl.select("group", "name", F.concat(F.lit("do "), "name").alias("instruction"), F.lit("").alias("guideline"))
    x = table(s, d, "documents").select("doc_id", "source", "lang", F.col("lang").alias("tag"))
    got = packaging.grouped_prompts(x, tmpl, tags, "doc_id", "source", "lang")
    return got.withColumn("prompt", F.md5("prompt"))


@query("training_text", """
SELECT conv_id, turn, md5('Answer the question ' || text || ' ' || '{"role":"' || role || '"}' || '</s>') AS text FROM conversations""")
def training_text(s, d):
    c = table(s, d, "conversations").select(
        "conv_id", "turn", F.lit(fixed.ANSWER_INSTRUCTION).alias("instruction"), F.col("text").alias("input"), F.struct("role").alias("response")
    )
    return prompts.to_training_text(c, "</s>").select("conv_id", "turn", F.md5("text").alias("text"))


@query("chat_messages", """
SELECT conv_id, turn, 'system/text:be brief|user/' || CASE WHEN turn % 3 = 0 THEN 'image:img' || turn || ',text:' ELSE 'text:' END || md5(text)
  || '|assistant/text:' || role AS messages FROM conversations""")
def chat_messages(s, d):
    c = table(s, d, "conversations").select(
        "conv_id", "turn", F.md5("text").alias("query"), F.col("role").alias("response"),
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("img"), F.col("turn").cast("string"))).alias("image"),
    )
    flat = F.array_join(
        F.transform(
            "messages",
            lambda m: F.concat(m["role"], F.lit("/"), F.array_join(F.transform(m["content"], lambda p: F.concat(p["type"], F.lit(":"), F.coalesce(p["text"], p["image"]))), ",")),
        ),
        "|",
    )
    return prompts.to_chat(c, "be brief").select("conv_id", "turn", flat.alias("messages"))


_MIX = """
WITH j AS (SELECT d.doc_id, lang, source, md5(text) AS h, quality * 2 + (d.doc_id % 3) AS sc FROM documents d JOIN labels USING (doc_id))"""


@query("training_mix", _MIX + """
SELECT 'wiki' AS source, 'system:expert|user:about ' || h || '|assistant:' || doc_id AS messages FROM j WHERE lang = 'en' AND sc >= 3
UNION ALL SELECT 'analyze', 'system:expert|user:about ' || h || '|assistant:' || doc_id FROM j WHERE lang = 'fr' AND sc >= 2
UNION ALL SELECT 'forum', 'system:forum|user:' || h || '|assistant:' || doc_id FROM j WHERE lang NOT IN ('en', 'fr') AND source < 'src2' AND sc >= 2
UNION ALL SELECT 'visual', 'system:forum|user:' || source || ',' || h || '|assistant:' || doc_id FROM j WHERE lang NOT IN ('en', 'fr') AND NOT source < 'src2' AND sc >= 1""")
def training_mix(s, d):
    j = docs(s, d, "lang", "source").join(table(s, d, "labels"), "doc_id").select(
        "lang", "source", F.lit("about").alias("instruction"), F.md5("text").alias("input"), F.md5("text").alias("query"),
        F.col("doc_id").cast("string").alias("response"), (F.col("quality") * 2 + F.col("doc_id") % 3).cast("int").alias("int_score"),
    )
    forum = j.where(~F.col("lang").isin("en", "fr")).withColumn("image", F.when(~(F.col("source") < "src2"), F.col("source")))
    a, b = packaging.training_mix(j.where("lang = 'en'"), j.where("lang = 'fr'"), forum, "expert", "forum")
    flat = F.array_join(
        F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.array_join(F.transform(m["content"], lambda p: F.coalesce(p["text"], p["image"])), ","))), "|"
    )
    return a.select("source", flat.alias("messages")).unionByName(b.select("source", flat.alias("messages")))


@query("choice_prompts", """
SELECT p_partkey, md5('Pick one' || chr(10) || 'Question: What is ' || p_name || '?' || chr(10) || 'A) ' || p_type || chr(10) || 'B) ' || p_brand
  || chr(10) || chr(10) || 'Answer:' || chr(10)) AS prompt FROM part""")
def choice_prompts(s, d):
    p = table(s, d, "part").select(
        "p_partkey", F.concat(F.lit("What is "), "p_name", F.lit("?")).alias("q"),
        F.array(
            F.struct(F.lit("A").alias("choice"), F.col("p_type").alias("answer")),
            F.struct(F.lit("B").alias("choice"), F.col("p_brand").alias("answer")),
        ).alias("choices"),
    )
    return p.select("p_partkey", F.md5(prompts.render_choices("q", "choices", "Pick one")).alias("prompt"))


@query("numbered_lists", """
SELECT o_custkey, string_agg(k || '. ' || o_orderstatus, chr(10) ORDER BY k) AS numbered,
  string_agg('Episode ' || o_orderkey || ' - ' || o_orderstatus, chr(10) ORDER BY k) AS episodes
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) GROUP BY 1""")
def numbered_lists(s, d):
    o = table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("episode_number"), F.col("o_orderstatus").alias("content"))
    g = aggregates.group_structs(o, ["o_custkey"], ["episode_number", "content"], [F.col("episode_number")])
    return g.select(
        "o_custkey", text.numbered_list(F.transform("items", lambda x: x["content"])).alias("numbered"), text.episode_list("items").alias("episodes")
    )


@query("query_suffix", """
SELECT conv_id, turn, md5(text || chr(10) || ' Give an answer only, no furthur explanation') AS query FROM conversations WHERE role = 'user'""")
def query_suffix(s, d):
    c = table(s, d, "conversations").where("role = 'user'")
    return filters.with_query_suffix(c, "text").select("conv_id", "turn", F.md5("query").alias("query"))


@query("multiple_choice_flag", "SELECT conv_id, turn, regexp_matches(text, '[ABCD]\\.') AS mc FROM conversations")
def multiple_choice_flag(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", text.is_multiple_choice("text").alias("mc"))


@query("url_parts", """
SELECT page_id, string_split(url, '/')[-1] AS last, lower(string_split(url, '/')[-1]) AS image_key, md5(url || string_split(url, '/')[-1]) AS id FROM pages""")
def url_parts(s, d):
    return table(s, d, "pages").select(
        "page_id", text.last_segment("url").alias("last"), joins.image_key("url").alias("image_key"),
        text.doc_id("url", text.last_segment("url")).alias("id"),
    )


@query("qa_instructions", f"""
WITH q AS (SELECT u.conv_id, u.text AS question, a.text AS answer FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')
SELECT 'Answer the question' AS instruction, question || '?' AS input, answer AS response FROM q
WHERE list_has_any({WORDS.format('lower(question)')}, {_sql_list(KEYWORDS)})""")
def qa_instructions(s, d):
    from corpusloom.plans.catalog_corpus import turn_pairs

    q = turn_pairs(s, d)
    halves = [q.where("conv_id % 2 = 0"), q.where("conv_id % 2 = 1")]
    return answers.qa_to_instructions(halves, KEYWORDS, "question", "answer", "?")


_JSON_SQL = """
WITH j AS (SELECT conv_id, turn, md5(text) AS h, role FROM conversations)"""


def _replies(s, d):
    """Turns as model replies: fenced JSON, one in five cut short."""
    c = table(s, d, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("h"))
    body = F.to_json(F.array(F.struct(
        F.concat(F.lit(" "), F.col("h"), F.lit(" ")).alias("question"),
        F.when(F.col("turn") % 2 == 0, F.lit("A. x\nB. y")).alias("choices"), F.concat(F.col("role"), F.lit(" ")).alias("answer"),
    )))
    raw = F.when(F.col("turn") % 5 == 4, F.substring(body, 1, 20)).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    return c.select("conv_id", "turn", raw.alias("response"))


@query("flatten_qa", _JSON_SQL + """
SELECT conv_id, turn, 0 AS qa_no, 'Answer the question' AS instruction, '' AS guideline,
  h || chr(10) || CASE WHEN turn % 2 = 0 THEN 'A. x' || chr(10) || 'B. y' ELSE '' END AS input, role AS response
FROM j WHERE turn % 5 <> 4""")
def flatten_qa(s, d):
    return prompts.flatten_qa(_replies(s, d))[0]


@query("rejected_replies", _JSON_SQL + "SELECT conv_id, turn, 'not the expected JSON' AS reason FROM j WHERE turn % 5 = 4")
def rejected_replies(s, d):
    return prompts.flatten_qa(_replies(s, d))[1].select("conv_id", "turn", "reason")


@query("flatten_instructions", _JSON_SQL + """
SELECT 'do ' || h AS instruction, 'Return in JSON format' AS guideline, CASE WHEN turn % 2 = 0 THEN role ELSE 'passage ' || turn END AS input,
  CASE WHEN turn % 3 = 0 THEN '{"entity_name":"' || role || '","entity_value":"' || turn || '"}' ELSE h END AS response FROM j""")
def flatten_instructions(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("h"))
    plain = F.to_json(F.struct(
        F.concat(F.lit("do "), "h").alias("instruction"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("input"), F.col("h").alias("output")))
    nested = F.to_json(F.struct(
        F.concat(F.lit("do "), "h").alias("instruction"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("input"),
        F.struct(F.col("role").alias("entity_name"), F.col("turn").cast("string").alias("entity_value")).alias("output")))
    raw = F.when(F.col("turn") % 3 == 0, nested).otherwise(plain)
    c = c.select(raw.alias("response"), F.concat(F.lit("passage "), F.col("turn").cast("string")).alias("input"))
    return prompts.flatten_instructions(c)[0]


@query("flat_yaml", """
SELECT conv_id, turn, role AS reason, (turn % 5)::INT AS score FROM conversations""")
def flat_yaml(s, d):
    c = table(s, d, "conversations").withColumn(
        "raw", F.concat(F.lit("```yaml\nreason: "), "role", F.lit("\nscore:  "), (F.col("turn") % 5).cast("string"), F.lit("\n```"))
    )
    y = prompts.parse_flat_yaml("raw")
    return c.select("conv_id", "turn", y["reason"].alias("reason"), y["score"].cast("int").alias("score"))


@query("scored_prompts", """
WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 5 <> 4 THEN text END AS text FROM conversations)
SELECT conv_id, turn, s::INT AS sample_no, CASE WHEN length(text) % 7 <> 0 THEN md5(text) END AS output,
  CASE WHEN text IS NULL THEN 'no prompt' WHEN length(text) % 7 = 0 THEN 'ValueError: refused' END AS error FROM p, range(2) t(s)""")
def scored_prompts(s, d):
    from hashlib import md5

    def reply(prompt: str) -> str:
        if len(prompt) % 7 == 0:
            raise ValueError("refused")
        return md5(prompt.encode()).hexdigest()

    prompt = F.when(F.col("turn") % 5 != 4, F.col("text")).alias("prompt")
    c = table(s, d, "conversations").select("conv_id", "turn", prompt)
    return scoring.score_prompts(c, reply, samples=2, wait=0.0).drop("prompt")


@query("chained_steps", "SELECT conv_id, turn, md5(md5(text) || '!') AS output FROM conversations")
def chained_steps(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("content"))
    steps = [
        lambda x: scoring.map_rows(x, output=F.md5("content")),
        lambda x: scoring.map_rows(x, output=F.md5(F.concat("content", F.lit("!")))),
    ]
    return scoring.chain(c, steps).select("conv_id", "turn", "output")


@query("batched_rows", """
SELECT conv_id, unnest(string_split(text, chr(10))) AS line FROM conversations""")
def batched_rows(s, d):
    c = table(s, d, "conversations").select("conv_id", "text")

    def lines(pdf):
        return pdf.assign(line=pdf["text"].str.split("\n")).explode("line")[["conv_id", "line"]]

    return scoring.flat_map_batches(c, lines, "conv_id bigint, line string")


@query("per_group", """
SELECT conv_id, count(*) AS turns, max(length(text)) AS longest, sum(CASE WHEN length(text) > before THEN 1 ELSE 0 END)::BIGINT AS rises
FROM (SELECT *, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY 1""")
def per_group(s, d):
    import pandas as pd

    c = table(s, d, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))

    def one(key, batches):
        turns, longest, rises, before = 0, 0, 0, None
        for b in batches:
            for n in b["n"].tolist():
                turns, longest, rises = turns + 1, max(longest, n), rises + (before is not None and n > before)
                before = n
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [turns], "longest": [longest], "rises": [rises]})

    return scoring.apply_groups(c, ["conv_id"], one, "conv_id bigint, turns bigint, longest bigint, rises bigint", [F.col("turn")])


@query("filtered_rows", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(text) > 100")
def filtered_rows(s, d):
    return scoring.filter_rows(table(s, d, "conversations"), (F.col("role") == "user") & (F.length("text") > 100)).select("conv_id", "turn")
