"""Queries over markup, readers, writers and incremental runs. Files are written from the shared
tables into the session's shared folder, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import fixed, text
from corpusloom.operators import chunking, filters, markup, windows
from corpusloom.plans import answers, episodes
from corpusloom.plans.catalog import docs, query, spread, table
from corpusloom.plans.catalog_corpus import WORDS
from corpusloom.plans.catalog_relational import UHASH
from corpusloom.session import scratch_path, stable
from corpusloom.sources import readers, writers
from corpusloom.streaming import incremental


def _pages(s, d):
    return spread(table(s, d, "pages"), "page_id")


_UN = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query("link_harvest", """
WITH nav AS (SELECT url, string_split(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href="')[2:] AS parts FROM pages)
SELECT url, string_split(url, '/')[-1] AS tag, generate_subscripts(parts, 1) - 1 AS pos, string_split(unnest(parts), '"')[1] AS link FROM nav""")
def link_harvest(s, d):
    return markup.harvest_links(_pages(s, d), container="nav")


@query("page_extract", f"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS art FROM pages),
p AS (SELECT page_id, url, trim({_UN.format("regexp_replace(regexp_extract(art, '<h1>(.*?)</h1>', 1, 's'), '<[^>]*>', '', 'g')")}) AS title,
  list_filter(list_transform(string_split(art, '<p>')[2:], lambda x: trim({_UN.format("regexp_replace(regexp_replace(x, '</p>.*$', '', 's'), '<[^>]*>', '', 'g')")}, ' ' || chr(10))), lambda x: x <> '') AS ps FROM a)
SELECT page_id, url, title, md5(array_to_string(ps, '.')) AS text FROM p WHERE len(ps) > 0""")
def page_extract(s, d):
    good, _ = markup.extract_pages(_pages(s, d), container="article", heading_in=None)
    return good.select("page_id", "url", "title", F.md5("text").alias("text"))


# Markup put before lines, and what a reader sees of it.
_MARKED = "'''bold''' [[Page a#part|shown]] [[plain]] {{box|name=x|y={{inner}}}}<ref name=\"r\">gone</ref><!-- gone --> [https://x.example/y label] &amp; "
_SEEN = "bold shown plain  label & "
# Sections name a link's target, and show what references hold.
_SEEN_IN_SECTIONS = " bold Page a#part plain  gone   "


def _wikitext(s, d):
    """Documents as wiki pages: every third line opens a section, its name from its place, and every other line has markup."""
    x = docs(s, d, "source")

    def line(l, i):
        name = F.when(i % 12 == 0, F.lit("References")).otherwise(F.concat(F.lit("part "), i.cast("string")))
        bars = F.when(i % 6 == 0, F.lit("==")).otherwise(F.lit("==="))
        head = F.when((i > 0) & (i % 3 == 0), F.concat(bars, F.lit(" "), name, F.lit(" "), bars, F.lit("\n"))).otherwise(F.lit(""))
        return F.concat(head, F.when(i % 2 == 1, F.lit(_MARKED)).otherwise(F.lit("")), l)

    # Marks of the grammar that the text holds by chance are taken out.
    plain = F.translate(F.col("text"), "[]{}<>'&=*#:;|", "")
    return x.select(
        F.col("doc_id").alias("page_id"), F.col("source").alias("title"),
        F.array_join(F.transform(F.split(plain, "\n"), line), "\n").alias("wikitext"),
    )


def _wiki_sql(step: int) -> str:
    """Lines of the pages as `c`: their place, what is seen of them, and the place of the last heading at every `step` lines."""
    return f"""
WITH l AS (SELECT doc_id AS page_id, source AS title, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS i, unnest(string_split(t, chr(10))) AS line
  FROM (SELECT doc_id, source, translate(text, '[]{{}}<>''&=*#:;|', '') AS t FROM documents)),
c AS (SELECT page_id, title, i, CASE WHEN i % 2 = 1 THEN '{_SEEN_IN_SECTIONS}' ELSE '' END || line AS line,
  max(CASE WHEN i = 0 OR i % {step} = 0 THEN i END) OVER (PARTITION BY page_id ORDER BY i) AS top,
  max(i) OVER (PARTITION BY page_id) AS last_line, lead(i) OVER (PARTITION BY page_id ORDER BY i) IS NULL AS final FROM l)"""


_WIKI_TEXT = "string_agg(CASE WHEN i > 0 AND i % 3 = 0 THEN chr(10) ELSE '' END || line || CASE WHEN final THEN '' ELSE chr(10) END, '' ORDER BY i)"


@query("wiki_sections", _wiki_sql(6) + f"""
SELECT page_id, min(title) AS title, CASE WHEN top = 0 THEN 'Summary' ELSE 'part ' || top END AS heading, md5({_WIKI_TEXT}) AS content
FROM c WHERE top = 0 OR top % 12 <> 0 GROUP BY page_id, top""")
def wiki_sections(s, d):
    got = markup.wiki_sections(_wikitext(s, d))
    return got.select("page_id", "title", "heading", F.md5("content").alias("content"))


@query("wiki_leaf_sections", _wiki_sql(3) + f"""
SELECT page_id, min(title) AS title, CASE WHEN top = 0 THEN 'Summary' ELSE 'part ' || top END AS heading,
  CASE WHEN top = 0 THEN '' WHEN top = 3 OR top % 6 = 0 THEN 'part ' || top
    WHEN (top - 3) % 12 = 0 THEN 'References/part ' || top ELSE 'part ' || (top - 3) || '/part ' || top END AS path, md5({_WIKI_TEXT}) AS content
FROM c WHERE top % 6 <> 0 OR top = 0 OR (top % 12 <> 0 AND top + 3 > last_line) GROUP BY page_id, top HAVING {_WIKI_TEXT} <> ''""")
def wiki_leaf_sections(s, d):
    """A section that is left out takes no section below it along: leaves go by their own name."""
    got = markup.wiki_leaf_sections(_wikitext(s, d))
    return got.select("page_id", "title", "heading", F.array_join("path", "/").alias("path"), F.md5("content").alias("content"))


@query("wiki_chunks", _wiki_sql(6) + f""",
sections AS (SELECT page_id, min(title) AS title, top // 3 AS pos, CASE WHEN top = 0 THEN 'Summary' ELSE 'part ' || top END AS heading, {_WIKI_TEXT} AS content
  FROM c WHERE top = 0 OR top % 12 <> 0 GROUP BY page_id, top),
s AS (SELECT page_id, title, CASE WHEN pos = 0 THEN 2147483647 ELSE pos END AS pos, heading, content FROM sections
  UNION ALL SELECT page_id, min(title), 2147483646, '{fixed.INFOBOX_HEADING}', ' kanji: k' || page_id || '; users: u' || page_id FROM sections GROUP BY page_id),
w AS (SELECT *, {WORDS.format("content")} AS ws FROM s),
k AS (SELECT page_id, title, pos, heading, no, array_to_string(ws[no * 200 + 1 : (no + 1) * 200], ' ') AS chunk, len(ws[no * 200 + 1 : (no + 1) * 200]) AS n
  FROM w, LATERAL (SELECT unnest(range((len(ws) + 199) // 200)) AS no) WHERE len(ws) > 0)
SELECT page_id, pos, no AS chunk_no,
  CASE WHEN {UHASH.format("page_id || chr(1) || pos || chr(1) || no || chr(1) || '0'")} % 2 = 0 THEN heading || ' of ' || title ELSE title || '''s ' || heading END AS input,
  {list(fixed.TOPIC_INSTRUCTIONS)}[({UHASH.format("page_id || chr(1) || pos || chr(1) || no || chr(1) || '1'")} % 4 + 1)::INT] AS instruction,
  md5(regexp_replace(chunk, '#+', ' ', 'g')) AS response
FROM k WHERE n * 1.2::DOUBLE >= 3""")
def wiki_chunks(s, d):
    """Pages with an infobox in the lead: sections, the box's text and the summary as chunks."""
    # Only a template named as an infobox is a box, and its text must have the words the floor asks for.
    own = F.col("page_id").cast("string")
    box = F.concat(F.lit("{{Infobox page|kanji=k"), own, F.lit("|other=x|users=u"), own, F.lit("}}"))
    sections = stable(markup.wiki_sections(_wikitext(s, d).withColumn("wikitext", F.concat(box, "wikitext"))))
    pages = markup.wiki_pages(sections)
    body = sections.where("pos > 0").select("page_id", "title", "pos", "heading", "content")
    return chunking.section_chunks(chunking.with_extra_sections(body, pages), 300, 100, 3).withColumn("response", F.md5("response"))


@query("wiki_plain_text", f"SELECT doc_id AS page_id, md5(trim('{_SEEN}' || translate(text, '[]{{}}<>''&=*#:;|', ''), ' ' || chr(10))) AS content FROM documents")
def wiki_plain_text(s, d):
    plain = F.translate("text", "[]{}<>'&=*#:;|", "")
    x = docs(s, d).select(F.col("doc_id").alias("page_id"), F.concat(F.lit(_MARKED), plain).alias("wikitext"))
    return markup.strip_wikitext(x).select("page_id", F.md5("content").alias("content"))


@query("section_filter", """
SELECT doc_id, i AS pos FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE i % 2 = 1""")
def section_filter(s, d):
    x = docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    x = x.withColumn("heading", F.when(F.col("pos") % 2 == 0, F.lit("References")).otherwise(F.lit("Body")))
    return filters.drop_sections(x).select("doc_id", "pos")


@query("index_docs", """
WITH p AS (SELECT url, lang, lower(lang) AS content FROM (SELECT url, regexp_extract(html, 'lang="(..)"', 1) AS lang FROM pages))
SELECT md5(url || lang) AS id, lower(url) AS title, lower(lang) AS heading, CASE WHEN md5(url || lang) < '8' THEN content ELSE 'old' END AS content, lower(lang) AS entities FROM p""")
def index_docs(s, d):
    lang = F.regexp_extract("html", 'lang="(..)"', 1)
    p = _pages(s, d).select(F.col("url").alias("title"), lang.alias("heading"), lang.alias("content"), F.array(lang).alias("links"))
    path = scratch_path(s, "index")
    got = writers.to_index_docs(p)
    # An old version of most rows arrives, then half of them new, some for the first time.
    old = got.withColumn("content", F.lit("old")).where(F.substring("id", 1, 1) > "3")
    writers.upsert_parquet(old, path, "id", [F.col("title")], 8)
    writers.upsert_parquet(got.where(F.substring("id", 1, 1) < "8"), path, "id", [F.col("title")], 8)
    return s.read.parquet(path).select("id", "title", "heading", "content", F.array_join("entities", ",").alias("entities"))


@query("episode_docs", """
SELECT conv_id AS episode_number, md5(string_agg(text, '-' ORDER BY turn)) AS dialogue, 'small' AS type, count(*)::VARCHAR AS content FROM conversations GROUP BY 1""")
def episode_docs(s, d):
    c = table(s, d, "conversations").select(F.col("conv_id").alias("episode_number"), F.col("turn").alias("pos"), F.col("text").alias("content"))
    summaries = c.groupBy("episode_number").agg(F.count(F.lit(1)).cast("string").alias("content"))
    got = episodes.episode_docs(c, summaries, "small")
    return got.select("episode_number", F.md5("dialogue").alias("dialogue"), "type", "content")


@query("dialogue_contexts", """
SELECT conv_id AS episode_number, 0 AS context_no, md5(text) AS context, role || '=' || turn AS lines FROM conversations WHERE turn % 4 <> 3""")
def dialogue_contexts(s, d):
    c = table(s, d, "conversations")
    body = F.to_json(F.array(F.struct(
        F.md5("text").alias("context"),
        F.array(F.struct(F.col("role").alias("character"), F.col("turn").cast("string").alias("line"))).alias("character_lines"),
    )))
    raw = F.when(F.col("turn") % 4 == 3, F.lit("sorry")).otherwise(F.concat(F.lit("```"), body, F.lit("```")))
    rows, _ = episodes.dialogue_contexts(c.select(F.col("conv_id").alias("episode_number"), raw.alias("output")))
    show = F.array_join(F.transform("character_lines", lambda x: F.concat(x["character"], F.lit("="), x["line"])), ",")
    return rows.select("episode_number", "context_no", "context", show.alias("lines"))


@query("subtitle_cues", """
SELECT conv_id AS episode, string_agg(replace(text, chr(10), ' '), '|' ORDER BY turn) AS cues FROM (SELECT conv_id, turn, md5(text) || chr(10) || role AS text FROM conversations) GROUP BY 1""")
def subtitle_cues(s, d):
    """Turns written as subtitle cues, at most 10,000 per file, then read and joined per conversation."""
    c = table(s, d, "conversations")
    cue = F.concat(
        F.lit("1\n00:00:01,000 --> 00:00:02,000\n"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"),
        F.lit("/<i>"), F.md5("text"), F.lit("</i>\n"), F.col("role"), F.lit("\n"),
    )
    path = scratch_path(s, "srt")
    c.select(cue.alias("value")).write.option("maxRecordsPerFile", 10_000).text(path)
    part = F.split("content", "/", 3)
    cues = readers.read_srt(s, f"{path}/*.txt").select(
        F.get(part, F.lit(0)).cast("bigint").alias("episode"), F.get(part, F.lit(1)).cast("int").alias("pos"), F.get(part, F.lit(2)).alias("content")
    )
    return episodes.episode_text(cues, "episode", [F.col("pos")], "content", "|", "cues").select("episode", "cues")


@query("xml_rows", "SELECT o_orderkey::VARCHAR AS Id, o_orderpriority AS Title, CASE WHEN o_orderkey % 3 <> 0 THEN '<' || o_orderstatus || '>' END AS Tags FROM orders WHERE o_orderkey % 10 <> 0")
def xml_rows(s, d):
    """Orders written as a row dump with every tenth line broken, then read."""
    o = table(s, d, "orders")
    tags = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit(' Tags="&lt;'), "o_orderstatus", F.lit('&gt;"'))).otherwise(F.lit(""))
    line = F.concat(F.lit('  <row Id="'), F.col("o_orderkey").cast("string"), F.lit('" Title="'), "o_orderpriority", F.lit('"'), tags,
                    F.when(F.col("o_orderkey") % 10 == 0, F.lit(" <broken />")).otherwise(F.lit(" />")))
    path = scratch_path(s, "xml")
    o.select(line.alias("value")).write.text(path)
    return readers.read_xml_rows(s, path, ["Id", "Title", "Tags"])


@query("preference_set", f"""
WITH q AS (SELECT doc_id FROM documents WHERE contains(lang, 'e')),
a AS (SELECT o_custkey AS q, o_orderkey AS a, o_orderpriority || ' & ' || o_orderkey AS body,
  log2(o_orderkey % 7 + 1) + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS sc FROM orders JOIN q ON doc_id = o_custkey)
SELECT x.q AS question_id, 'title ' || x.q AS question, x.a AS answer_j, x.body AS response_j, y.a AS answer_k, y.body AS response_k,
  CASE WHEN {UHASH.format("x.q || chr(1) || '0'")}::DOUBLE / 4294967296 < 0.9 THEN 'train' ELSE 'test' END AS split
FROM a x JOIN a y ON x.q = y.q AND x.sc > y.sc""")
def preference_set(s, d):
    """Documents written as two snapshots of a question dump, orders as their answers, some twice; then the whole job."""
    x = table(s, d, "documents").select("doc_id", "lang")
    tags = F.concat(F.lit("|"), "lang", F.lit("|misc|"))
    row = lambda title, date: F.concat(
        F.lit('<row Id="'), F.col("doc_id").cast("string"), F.lit('" PostTypeId="1" Title="'), F.lit(title), F.lit('" Body="&lt;p&gt;x&lt;/p&gt;" Tags="'),
        tags, F.lit(f'" LastActivityDate="{date}" />'),
    )
    dumps = scratch_path(s, "dumps")
    x.select(row("old", "2020-01-01T00:00:00.000").alias("value")).write.text(f"{dumps}/a")
    x.where("doc_id % 3 = 0").select(row("new", "2021-01-01T00:00:00.000").alias("value")).write.text(f"{dumps}/b")
    o = table(s, d, "orders")
    given = o.select(
        F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("answer_id"), F.concat(F.lit("title "), F.col("o_custkey").cast("string")).alias("title"),
        F.concat(F.lit("<p>"), "o_orderpriority", F.lit(" &amp; "), F.col("o_orderkey").cast("string"), F.lit("</p>")).alias("body"),
        (F.col("o_orderkey") % 7).alias("up_vote_count"), (F.col("o_orderstatus") == "F").alias("is_accepted"), F.lit(1_600_000_000).alias("creation_date"),
    )
    replies = scratch_path(s, "replies")
    writers.write_jsonl(given, replies)
    writers.write_jsonl(given.where("answer_id % 5 = 0"), replies, "append")
    got = answers.preference_set(s, f"{dumps}/*", replies, scratch_path(s, "preference-set"), "e")
    return got.select("question_id", "question", "answer_j", "response_j", "answer_k", "response_k", F.col("split").cast("string").alias("split"))


@query("gzip_rows", "SELECT event_id, event_type, value FROM events")
def gzip_rows(s, d):
    """Events written as gzip files of JSON lines and read back."""
    path = scratch_path(s, "gzip")
    table(s, d, "events").select("event_id", "event_type", "value").write.option("compression", "gzip").json(path)
    return readers.read_jsonl(s, f"{path}/*.gz", "event_id bigint, event_type string, value double")


@query("ass_lines", """
SELECT conv_id AS episode, turn, 'Dialogue: 0' AS layer, role AS name, md5(text) || chr(10) || 'a,b' AS content FROM conversations""")
def ass_lines(s, d):
    """Turns as lines of advanced subtitle scripts, a section for each conversation, with comments and style tags."""
    c = table(s, d, "conversations")
    line = F.concat(
        F.lit("Dialogue: 0,0:00:01.00,0:00:02.00,Default,"), "role", F.lit(",0,0,0,"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"),
        F.lit(",<i>"), F.md5("text"), F.lit("</i>\\Na,b\nComment: 0,skipped"),
    )
    lines = F.concat_ws("\n", F.lit("[Script Info]\nTitle: x\n[Events]\nFormat: Layer"), F.array_sort(F.collect_list(line)))
    path = scratch_path(s, "ass")
    c.groupBy("conv_id").agg(lines.alias("value")).select("value").write.option("maxRecordsPerFile", 10_000).text(path)
    got = readers.read_ass(s, f"{path}/*.txt")
    place = F.split("Effect", "/")
    return got.select(F.get(place, 0).cast("bigint").alias("episode"), F.get(place, 1).cast("int").alias("turn"), F.col("Layer").alias("layer"), F.col("Name").alias("name"), F.col("Text").alias("content"))


@query("episode_numbers", """
SELECT url, CASE WHEN place < 1000 THEN lpad(place::VARCHAR, 3, '0') ELSE place::VARCHAR END AS place, regexp_extract(string_split(url, '/')[-1], '([0-9]+)', 1) AS number
FROM (SELECT url, dense_rank() OVER (ORDER BY url) AS place FROM pages)""")
def episode_numbers(s, d):
    """Pages as episode files: their place among the sorted paths, and the number in the name."""
    p = table(s, d, "pages").select("url")
    by_place = readers.with_episode_number(p, path="url", out="place")
    return readers.with_episode_number(by_place, "([0-9]+)", "url", "number").select("url", "place", "number")


@query("jsonl_roundtrip", "SELECT event_id, event_type, value FROM events")
def jsonl_roundtrip(s, d):
    e = table(s, d, "events").select("event_id", "event_type", "value")
    path = scratch_path(s, "jsonl")
    writers.write_jsonl(e.where("event_id % 2 = 0"), path)
    writers.write_jsonl(e.where("event_id % 2 = 1"), path, "append")
    return readers.read_jsonl(s, path, "event_id bigint, event_type string, value double")


@query("rotated_files", "SELECT doc_id, lang, (row_number() OVER (ORDER BY doc_id) - 1) // 70 AS file_idx FROM documents")
def rotated_files(s, d):
    path = scratch_path(s, "rotated")
    writers.write_rotating_json(table(s, d, "documents").select("doc_id", "lang"), path, ["doc_id"], 70)
    got = readers.read_json_arrays(s, f"{path}/*/*.txt", "doc_id bigint, lang string")
    return got.select("doc_id", "lang", F.regexp_extract(F.col("_metadata.file_path"), r"file_idx=(\d+)", 1).cast("bigint").alias("file_idx"))


@query("split_roundtrip", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def split_roundtrip(s, d):
    x, l = table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels").select("doc_id")
    path = scratch_path(s, "splits")
    writers.write_splits({"labelled": x.join(l, "doc_id", "left_semi"), "open": x.join(l, "doc_id", "left_anti")}, path)
    return readers.read_split(s, path, "open").select("doc_id", "lang")


@query("partitioned_table", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def partitioned_table(s, d):
    path = scratch_path(s, "partitioned")
    writers.write_partitioned(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), path, "o_orderstatus")
    return readers.read_table(s, path).where("o_orderstatus = 'O'").select("o_orderkey", F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


@query("checkpointed_table", "SELECT doc_id, md5(text) AS h FROM documents")
def checkpointed_table(s, d):
    return writers.checkpoint_table(docs(s, d).select("doc_id", F.md5("text").alias("h")), scratch_path(s, "table"))


@query("keyed_lookup", """
SELECT o_orderkey, o_custkey, last_status FROM orders JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY 1) USING (o_custkey)""")
def keyed_lookup(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    last = readers.as_lookup(o, "o_custkey", [F.desc("o_orderkey")]).select("o_custkey", F.col("o_orderstatus").alias("last_status"))
    return o.drop("o_orderstatus").join(last, "o_custkey").select("o_orderkey", "o_custkey", "last_status")


@query("event_ingest", "SELECT DISTINCT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def event_ingest(s, d):
    """Events land as files in two drops that overlap; each run takes what is new, then stops."""
    e = table(s, d, "events").select("event_id", "event_type", "props")
    src, out, ckpt = (scratch_path(s, n) for n in ("landing", "ingested", "progress"))
    schema = "event_id bigint, event_type string, props string"
    work = lambda x: incremental.dedup_stream(x.select("event_id", "event_type", F.from_json("props", "k int")["k"].alias("k")), "event_id")
    for part in (F.col("event_id") % 3 < 2, F.col("event_id") % 3 > 0):
        writers.write_jsonl(e.where(part), src, "append")
        incremental.ingest_stream(s, src, schema, out, ckpt, work).awaitTermination()
    return s.read.schema("event_id bigint, event_type string, k int").parquet(out)


@query("event_append_new", "SELECT event_id, event_type FROM events")
def event_append_new(s, d):
    """The same two drops through the table-backed form, which keeps no state in memory."""
    e = table(s, d, "events").select("event_id", "event_type")
    src, out, ckpt = (scratch_path(s, n) for n in ("landing", "appended", "progress"))
    sink = incremental.append_new(out, "event_id", [F.col("event_type")])
    for part in (F.col("event_id") % 3 < 2, F.col("event_id") % 3 > 0):
        writers.write_jsonl(e.where(part), src, "append")
        q = s.readStream.schema("event_id bigint, event_type string").json(src).writeStream.foreachBatch(sink)
        q.option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).select("event_id", "event_type")


@query("event_upsert", """
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""")
def event_upsert(s, d):
    e = table(s, d, "events").select("user_id", "event_id")
    path = scratch_path(s, "latest")
    sink = incremental.upsert_batches(path, "user_id", [F.desc("event_id")], 8)
    early = F.col("event_id") % 2 == 0
    # Late and repeated rows: the last batches hold older rows than the table for most users.
    sink(e, 0)
    sink(e.where(early), 1)
    sink(e.where(early), 1)
    return s.read.parquet(path).select("user_id", "event_id")


@query("resumed_work", "SELECT doc_id, md5(text) AS h FROM documents")
def resumed_work(s, d):
    out = scratch_path(s, "resumed")
    work = lambda x: x.select("doc_id", F.md5("text").alias("h"))
    todo = docs(s, d)
    incremental.resume_batch(s, todo.where("doc_id % 2 = 0"), out, "doc_id", work)
    incremental.resume_batch(s, todo, out, "doc_id", work)
    return s.read.parquet(out)


@query("image_filter", "SELECT page_id, 'src' || page_id % 2 || ',src' || page_id AS kept FROM pages")
def image_filter(s, d):
    alt = lambda a: F.lit(a).cast("string")
    img = lambda src, a: F.struct(src.alias("src"), alt(a).alias("alt"))
    p = table(s, d, "pages").select("page_id", F.array(
        img(F.concat(F.lit("src"), (F.col("page_id") % 2).cast("string")), None), img(F.lit("x"), "Edit icon"),
        img(F.concat(F.lit("src"), F.col("page_id").cast("string")), "photo"), img(F.lit("y"), "youtube-cover"),
    ).alias("imgs"))
    return p.select("page_id", F.array_join(F.transform(filters.filter_images("imgs"), lambda i: i["src"]), ",").alias("kept"))


@query("infobox_text", """
SELECT p_partkey, ' kanji: ' || p_name || '; teams: ' || p_brand AS box FROM part""")
def infobox_text(s, d):
    p = table(s, d, "part").select("p_partkey", F.create_map(F.lit("jutsu"), F.create_map(
        F.lit("kanji"), F.col("p_name"), F.lit("other"), F.col("p_type"), F.lit("teams"), F.col("p_brand"))).alias("infobox"))
    return p.select("p_partkey", chunking.infobox_text("infobox").alias("box"))


@query("doc_ids", "SELECT page_id, md5(url || page_id) AS id FROM pages")
def doc_ids(s, d):
    return table(s, d, "pages").select("page_id", text.doc_id("url", F.col("page_id").cast("string")).alias("id"))
