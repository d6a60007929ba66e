"""Golden pages for HTML and wikitext."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.operators import batches, chunking, filters, markup
from corpusloom.plans import catalog_formats

HTML = """<html><head><title>t</title><script>var x = "<p>no</p>";</script></head><body>
<div class="wiki-header-title"><h1> Title &amp; more </h1></div><h1>Other</h1>
<div id="wiki-tag-pages"><div><ul><li><a href=" /a ">A</a></li><li><b><a href="/b">B</a></b></li></ul></div><a href="/no">x</a></div>
<div class="x wiki-content"><div><p>One <b>bold<p> Two &lt;2&gt; <br> more</p><p>  </p></div><img src="i1" alt="Edit icon"><img src="i2">
<img src="i3" alt="photo"></div><p>outside</p><ul><li><a href="/out">o</a></li></ul></body></html>"""


def test_html_page(spark):
    df = spark.createDataFrame([("u/seed", HTML), ("u/none", "<h1>x</h1><p>y</p>"), ("u/null", None)], "url string, html string")
    good, bad = markup.extract_pages(df)
    (r,) = good.collect()
    assert r.text == "One bold.Two <2>  more" and r.title == "Title & more" and r.img_links == ["i2", "i3"]
    assert {(b.url, b.reason) for b in bad.collect()} == {("u/none", "no text"), ("u/null", "no text")}
    links = markup.harvest_links(df).orderBy("pos").collect()
    assert [(l.url, l.tag, l.link) for l in links] == [("u/seed", "seed", "/a"), ("u/seed", "seed", "/b")]


WIKI = """{{Infobox Person
| name = [[Bob|Bobby]]
| age = {{nowrap|3}}
| odd
}}
Lead about [[Target page|label]] and '''bold''' text.{{translation|ni|hao}}
[[File:x.png|thumb|cap]]
<gallery>a.png</gallery>
== History ==
He was [[born]].
=== Early ===
Young.
==== Deep ====
Deep text.
=== Late ===
Old.<ref>src</ref>
== References ==
none
=== Sub ===
gone
== Empty ==
== History ==
Again.
{{infobox tool|kanji = k}}
Unclosed [[link and {{brace
"""


def test_sections(spark):
    df = spark.createDataFrame([(1, "T", WIKI), (2, "N", None), (3, "E", "")], "page_id int, title string, wikitext string")
    rows = markup.wiki_sections(df).where("page_id = 1").orderBy("pos").collect()
    assert [r.heading for r in rows] == ["Summary", "History", "Empty", "History"]
    lead, hist = rows[0], rows[1]
    assert "Lead about Target page and  bold text.ni hao" in lead.content
    assert "a.png" not in lead.content and "cap" not in lead.content
    assert lead.links == ["Target page", "File:x.png"] and lead.images == ["File:x.png"]
    assert [(b["name"], {p["key"]: p["value"] for p in b["params"]}) for b in lead.boxes] == [
        ("person", {"name": "[[Bob|Bobby]]", "age": "{{nowrap|3}}"})]
    assert "He was born." in hist.content and "Deep text." in hist.content and "Old. src" in hist.content
    assert [(h["level"], h["text"]) for h in hist.headings] == [(2, "History"), (3, "Early"), (4, "Deep"), (3, "Late")]
    assert "Unclosed [[link and {{brace" in rows[3].content
    page = {p.page_id: p for p in markup.wiki_pages(markup.wiki_sections(df)).collect()}
    assert set(page) == {1, 3}
    assert set(page[1].infobox) == {"person", "tool"} and "\n\n" not in page[1].text and page[1].summary == lead.content


def test_leaf_sections(spark):
    df = spark.createDataFrame([(1, "T", WIKI)], "page_id int, title string, wikitext string")
    got = {"/".join(r.path) or r.heading: r.content.strip() for r in markup.wiki_leaf_sections(df).collect()}
    # "History" has children, so its second, childless occurrence is no leaf either.
    assert set(got) == {"Summary", "History/Early/Deep", "History/Late", "References/Sub", "Empty"}
    assert got["History/Early/Deep"] == "Deep text." and got["History/Late"] == "Old. src"
    heads = markup.wiki_headings(df).where("level > 0").orderBy("pos").collect()
    assert [(h.heading, h.is_leaf) for h in heads] == [
        ("History", False), ("Early", False), ("Deep", True), ("Late", True), ("References", False), ("Sub", True),
        ("Empty", True), ("History", True)]


def test_infobox_predicates_and_text(spark):
    df = spark.createDataFrame(
        [(1, {"character": {"Appears in Sequel": "Yes, indeed", "kanji": "k"}}), (2, {"videogame x": {"sequel": "no", "teams": "t", "other": "o"}, "b": {"users": "u"}}), (3, {})],
        "id int, infobox map<string,map<string,string>>",
    )
    assert [r.id for r in filters.filter_map_flag(df, "infobox", "sequel").orderBy("id").collect()] == [2, 3]
    assert [r.id for r in df.where(filters.has_map_key_like("infobox", "VideoGame")).collect()] == [2]
    assert [r.t for r in df.orderBy("id").select(chunking.infobox_text("infobox").alias("t")).collect()] == [" kanji: k", " teams: t; users: u", ""]


def test_chunks_rebuild_the_words(spark):
    words = " ".join(f"w{i}" for i in range(23))
    df = spark.createDataFrame(
        [(1, "T", 0, "A", words), (1, "T", 1, "B", "x ### y"), (1, "T", 2, "C", ""), (1, "T", 3, "Summary", "old one")],
        "page_id int, title string, pos int, heading string, content string")
    pages = spark.createDataFrame([(1, "T", "the new summary", {"b": {"kanji": "k"}})], "page_id int, title string, summary string, infobox map<string,map<string,string>>")
    full = chunking.with_extra_sections(df, pages)
    assert {(r.heading, r.content) for r in full.collect()} == {
        ("A", words), ("B", "x ### y"), ("C", ""), ("Summary", "the new summary"), ("Info Box", " kanji: k")}
    c = chunking.section_chunks(full, 8, 3, 0).orderBy("pos", "chunk_no").collect()
    a = [r.response for r in c if r.pos == 0]
    assert " ".join(a) == words and all(len(x.split()) <= 5 for x in a)
    assert [r.response for r in c if r.pos == 1] == ["x   y"]
    assert {r.input for r in c if r.pos == 0} <= {"A of T", "T's A"}
    o = [r.response.split() for r in chunking.section_chunks(df, 8, 3, 0, true_overlap=True).where("pos = 0").orderBy("chunk_no").collect()]
    assert o[0][5:] == o[1][:3] and len(o[0]) == 8


def test_packs(spark):
    sec = [("h%d" % i, " ".join(f"s{i}_{j}" for j in range(10))) for i in range(7)]
    df = spark.createDataFrame(
        [(1, "T", "sum", " ".join(s for _, s in sec), sec, "box here"), (2, "T", "s", "short text", [("h", "short text")], "bx")],
        "page_id int, title string, summary string, text string, sections array<struct<heading:string,content:string>>, infobox_text string")
    got = chunking.packed_chunks(df, 40, 4, 0).orderBy("page_id", "pack", "chunk_no").collect()
    small = [r.input for r in got if r.page_id == 2]
    assert small == ["T, T, s, short text Info Box: bx"]
    packs = {}
    for r in got:
        if r.page_id == 1:
            packs.setdefault(r.pack, []).extend(r.input[3:].split())
    allwords = [w for p in sorted(packs) for w in packs[p] if w.startswith("s") and "_" in w]
    assert allwords == " ".join(s for _, s in sec).split()
    assert all(len(p) * 1.2 <= 40 for p in packs.values())


def test_sweep_grows_overlap(spark):
    df = spark.createDataFrame([(i, "T", 0, "H", " ".join(f"a{i}_{j}" for j in range(120))) for i in range(3)] + [(9, "T", 0, "H", " ".join(f"a0_{j}" for j in range(120)))],
                               "page_id int, title string, pos int, heading string, content string")
    rows = chunking.chunk_sweep(df, (50, 12, 50), 5, ("nothing",), first_overlap=5, grow=5, num_perm=None).collect()
    got = [r for r in rows if r.context_length == 50]
    assert {r.overlap for r in got} == {min(r.overlap for r in got)} and got[0].overlap >= 10 and {r.page_id for r in got} == {0, 1, 2}
    assert max(len((r.input + r.instruction + r.response).split()) * 1.2 for r in got) <= 50 and not any(r.over_length for r in got)
    # Windows short enough are under the floor. Where no window is, the last one is taken and its rows are marked.
    assert not [r for r in rows if r.context_length == 12]
    short = chunking.chunk_sweep(df, (4,), 0, first_overlap=1, grow=1, dedup=False)
    assert {(r.overlap, r.over_length) for r in short.collect()} == {(3, True)}


@pytest.mark.parametrize("mark", ["{{", "[[", "{|", "<ref>", "[http://x ", "''", "<!--", "{{a|", "[[a|"])
def test_unclosed_marks_take_linear_time(mark):
    t0 = time.time()
    w = markup._Wikitext(mark * 100_000)
    w.tokens()
    assert time.time() - t0 < 3


def test_deep_nesting_does_not_recurse():
    n = 5_000
    for opening, closing in (("<div>", "</div>"), ("[[a|", "]]"), ("{{a|", "}}"), ("<b><i>", "</i></b>")):
        got = markup._plain(opening * n + "x" + closing * n)
        assert got in ("x", "")


def test_nested_tags_of_one_name():
    assert markup._plain("<div><div>x</div>y</div>z") == "xyz"
    kinds = [(k, n, t) for k, n, t, _ in markup._Wikitext("a {{Infobox [[b|c]]|k=[[d|e]]|f}} [[File:g|h]] <gallery>i</gallery>").tokens()]
    assert kinds[1][:2] == ("template", "Infobox [[b|c]]") and ("link", "File:g", "") in kinds


def test_plain_text_shows_entities_and_labels(spark):
    cases = {
        "a &amp; b&nbsp;c &#65;": "a & b\xa0c A", "see [https://x.example/y the ''label'' here] now": "see the label here now", "[https://x.example] end": "end",
        "&unknown; &amp": "&unknown; &amp", "[not a link] x": "[not a link] x",
    }
    df = spark.createDataFrame([(k,) for k in cases], "wikitext string")
    assert {r.wikitext: r.content for r in markup.strip_wikitext(df).collect()} == cases


def test_pieces_bound_what_a_worker_holds():
    """A batch of any size is answered piece by piece; a row above the bound is a piece alone, and no row is lost."""
    sizes = np.array([5, 5, 50, 0, 0, 9, 9, 9, 1])
    got = list(batches._pieces(sizes, 20))
    assert [i for at, n in got for i in range(at, at + n)] == list(range(len(sizes)))
    assert all(n == 1 or (sizes[at : at + n] + 1).sum() <= 20 for at, n in got)
    assert list(batches._pieces(np.array([], dtype=np.int64), 20)) == []


def test_results_by_pieces_are_whole(spark):
    df = spark.range(40).coalesce(1).selectExpr("id", "CASE WHEN id % 9 = 0 THEN NULL ELSE repeat('x', 200000) || id END AS t")
    got = batches.with_result(df, "t", "n", "string", lambda t: str(len(t or "")), keep=False)
    rows = sorted(got.collect())
    assert [r.n for r in rows] == ["0" if i % 9 == 0 else str(200000 + len(str(i))) for i in range(40)]
    arrays = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "id int, a array<bigint>")
    total = batches.with_result(arrays, "a", "s", "array<bigint>", lambda a: [] if a is None else a[::-1])
    assert sorted(map(tuple, total.collect())) == [(1, [1, 2], [2, 1]), (2, [], []), (3, None, [])]


def test_wiki_chunks_have_the_box(spark, tmp_path):
    """The parameters that sections keep of a box reach the chunks, under the box's heading."""
    rows = [(7, "one two three four\nfive six seven", "s"), (8, "a b c d e", "t"), (9, None, "u")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog_formats.wiki_chunks(spark, str(tmp_path)).where(F.col("input").contains(fixed.INFOBOX_HEADING)).collect()
    want = {(i, hashlib.md5(f"kanji: k{i}; users: u{i}".encode()).hexdigest()) for i in (7, 8)}
    assert {(r.page_id, r.response) for r in got} == want and len(got) == 2
