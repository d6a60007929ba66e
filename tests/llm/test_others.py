"""Operators over vectors and pages, the pipeline, and the registered queries."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from corpusloom.llm import contamination, maintext, mincut, nndescent
from corpusloom.llm.queries import SQL
from tests import oracle
from tests.llm import common

SF = "/root/testdata/sf0.001"


def _brute_vectors(rows, threshold=0.9):
    unit = {}
    for i, v in rows:
        v = None if v is None or any(x is None for x in v) else np.array(v, float)
        if v is not None and len(v) and np.isfinite(v).all() and np.linalg.norm(v) > 0:
            unit[i] = v / np.linalg.norm(v)
    links = {i: [j for j in unit if j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= threshold] for i in unit}
    comp = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, near in links.items():
            low = min([comp[i], *[comp[j] for j in near]])
            changed, comp[i] = changed or low != comp[i], low
    return {i: (len(links.get(i, [])), comp[i]) for i, _ in rows}


def test_vectors_against_brute_force(spark, monkeypatch):
    """Clusters larger than the lists, lonely vectors, and blocks smaller than a cluster."""
    monkeypatch.setattr(nndescent, "BLOCK", 16)
    r = np.random.default_rng(1)
    rows = []
    for size in (60, 20, 5, 2):
        centre = r.normal(size=24)
        rows += [(len(rows) + k, (centre + 0.18 * r.normal(size=24)).tolist()) for k in range(size)]
    rows += [(len(rows) + k, r.normal(size=24).tolist()) for k in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {x.vec_id: (x.n_links, x.component_id) for x in nndescent.near_vectors(df).collect()}
    assert got == _brute_vectors(rows)


def test_audit_sees_lost_pairs_beside_a_large_cluster(spark, monkeypatch):
    """All links of 400 alike entries are found, those of 30 pairs are not."""
    monkeypatch.setattr(nndescent, "AUDIT", 64)
    r = np.random.default_rng(5)

    def near(centre):
        v = centre + 0.02 * r.normal(size=24)
        return (v / np.linalg.norm(v)).tobytes()

    hot = r.normal(size=24)
    units = [near(hot) for _ in range(400)] + [near(c) for c in r.normal(size=(30, 24)) for _ in range(2)]
    entries = spark.createDataFrame([(i, bytearray(u)) for i, u in enumerate(units)], "id long, unit binary").repartition(3)
    cluster = [(i, 0) for i in range(400)]
    pairs = [(i, i - i % 2) for i in range(400, 460)]
    share, few, seen = nndescent._recall(entries, spark.createDataFrame(cluster, "id long, component long"), 0.9, 460)
    assert 0.8 < share < 0.95 and few == 0.0 and seen == 60
    assert nndescent._recall(entries, spark.createDataFrame(cluster + pairs, "id long, component long"), 0.9, 460) == (1.0, 1.0, 60)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.0]), (10, [-1.0, 0.0]), (11, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*x, "a", 1.0) for x in [*rows, (None, [1.0, 0.0])]], "vec_id long, embedding array<double>, id string, s double")
    got = nndescent.near_vectors(df)
    assert {x.vec_id: (x.n_links, x.component_id) for x in got.where("vec_id is not null").collect()} == _brute_vectors(rows)
    none = got.where("vec_id is null").first()
    assert none.n_links == 0 and none.component_id is None and none.kept
    assert nndescent.near_vectors(df.limit(0)).count() == 0
    twice = nndescent.near_vectors(df.where("vec_id = 1").unionByName(df.where("vec_id = 1"))).collect()
    assert [(x.n_links, x.component_id) for x in twice] == [(1, 1), (1, 1)]


def _brute_cut(scores, edges):
    n, best = len(scores), None
    for bits in range(1 << n):
        kept = [bits >> i & 1 for i in range(n)]
        price = sum(-s if k == 0 and s < 0 else 0 for s, k in zip(scores, kept, strict=True)) * 0
        price = sum(s for s, k in zip(scores, kept, strict=True) if s > 0 and not k) + sum(-s for s, k in zip(scores, kept, strict=True) if s < 0 and k)
        price += sum(w for a, b, w in edges if kept[a] != kept[b])
        best = price if best is None else min(best, price)
    return best


def test_minimum_cut_against_all_labellings():
    r = random.Random(2)
    for _ in range(150):
        n = r.randint(1, 8)
        scores = [r.choice([-2.0, -0.7, 0.0, 0.4, 1.0, 3.0]) for _ in range(n)]
        edges = [(a, b, r.choice([0.3, 1.0, 2.0])) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5]
        kept = mincut.label(scores, edges)
        price = sum(s for s, k in zip(scores, kept, strict=True) if s > 0 and not k) + sum(-s for s, k in zip(scores, kept, strict=True) if s < 0 and k)
        price += sum(w for a, b, w in edges if kept[a] != kept[b])
        assert price == pytest.approx(_brute_cut(scores, edges))


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>No</p>";</script></head><body class="has-sidebar">
<header><h2>Site name, not the text.</h2></header><nav><ul><li><a href=x>Home</a></li></ul></nav><!-- <p>No</p> --><div class="cookie-notice"><p>We use cookies to make this site better for all of you.</p></div>
<div id="content"><h1>Title of it</h1><p>First   paragraph of some
length, with a <a href=y>link</a><br>and more.</p><div class="ad-box"><p>Buy this now, it is a good thing to have.</p></div><p>Short.</p><ul><li>item one<li>item two</ul>
<form><p>Leave your mail here please, we will write.</p><input></form><p>Last &eacute;t&eacute; &#8212; x &amp; y.</p>
<section class="comments"><h3>Comments</h3><article><p>I think this is a wonderful page with a long comment text here.</p></article></section></div>
<aside><p>Something aside, which is long enough to look like text of the page.</p></aside><div class="sidebar"><p>More things that are long enough to look like text of it.</p></div><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    want = "Title of it\nFirst paragraph of some length, with a link and more.\nShort.\nitem one\nitem two\nLast été — x & y."
    assert maintext.main_text(PAGE) == want


@pytest.mark.parametrize("part", [
    '<ol class="commentlist"><li><p>Nice page, I liked to read it a lot.</p></li></ol>', '<div class="newsletter-box"><p>Give us your mail and we will write to you.</p></div>',
    '<div id="gdpr"><p>This site stores small files on your disk.</p></div>', '<div hidden><p>Nobody sees this text of the page.</p></div>',
    '<section class="related-posts"><article><p>Another story that you may want to read.</p></article></section>', '<aside><p>By the way, this is not the text.</p></aside>',
])
def test_parts_that_are_no_article(part):
    body = "".join(f"<p>Paragraph {i} of the text, with a few words.</p>" for i in range(4))
    want = "\n".join(f"Paragraph {i} of the text, with a few words." for i in range(4))
    for article in (f'<article class="post-1 post tag-share category-x">{body}{part}</article>', f'<div class="post-content">{body}{part}</div>', f'<main>{body}</main>{part}', f"{part}<div>{body}</div>"):
        assert maintext.main_text(f"<html><body>{article}</body></html>") == want


@pytest.mark.parametrize("page", ["", None, "<", "<p", "plain text only, no tags at all.", "<p>a", "&amp", "<script>x", "<!--", "<a \"", "</div></p>", "<p class='x>y</p>"])
def test_broken_pages_do_not_raise(page):
    assert isinstance(maintext.main_text(page), str)


def test_long_pages_take_linear_time():
    t0 = time.time()
    for part in ("<div>", "<", "<a \"", "<p>x y</p><div>", "<!--", "<script>", "&", "<ul><li>x"):
        maintext.main_text(part * 50_000)
    assert time.time() - t0 < 40


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, None), (2, "v", "", 0)], "page_id long, url string, html string, text int")
    got = maintext.extract(df).collect()
    assert sorted(x.n_chars for x in got)[:2] == [0, 0] and all(len(x.text) == x.n_chars for x in got) and len(got) == 4
    assert maintext.extract(df.limit(0)).count() == 0
    real = maintext.extract(spark.read.parquet(f"{SF}/pages.parquet"))
    assert real.where("text = '' or text like '%©%' or text like '%track(%'").count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_with_sql(spark, name):
    got = oracle.compare(spark, SF, name, entry.queries()[name], SQL[name], oracle.connect(SF))
    assert got["ok"], got["why"]


@pytest.mark.parametrize("name", ["op2_containment", "op3_pseudonyms"])
def test_native_queries_have_no_python(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_every_operator_is_registered_once():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_pipeline_stages(spark):
    """Every stage on the rows its predecessor kept, held against what it promises."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd, _ = common.odd_documents(spark)
    docs = docs.unionByName(odd.where("doc_id is null or doc_id in (2, 3)").select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars")))
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "near_dedup", "decontaminate", "pii", "mix"]
    kept = docs
    for name in list(steps)[:-1]:
        before, kept = kept, corpus_pipeline.written(steps[name](spark, kept, SF), f"test-{name}")
        assert kept.columns == list(corpus_pipeline.COLUMNS), name
        if name != "pii":
            assert kept.exceptAll(before).count() == 0 and 0 < kept.count() <= before.count(), name
        if name == "near_dedup":
            texts = [r.text for r in kept.where("doc_id is not null").collect()]
            assert len({frozenset(common.shingles(t, 5)) for t in texts if common.words(t)}) == len([t for t in texts if common.words(t)])
        if name == "decontaminate":
            assert contamination.contained_items(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        if name == "pii":
            assert kept.count() == before.count() and kept.where("text like '%@mail%.example.com%'").count() == 0
            assert kept.where("n_chars <> char_length(text)").count() == 0
    mixed = steps["mix"](spark, kept, SF)
    assert mixed.count() == kept.count()
    per = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert per.where("abs(taken - target) > 1").count() == 0


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "empty")
        assert docs.count() == 0


_PARAGRAPHS = [f"This is paragraph number {i} of the article, and it says something of some length about the matter." for i in range(5)]
_BODY = "".join(f"<p>{p}</p>" for p in _PARAGRAPHS)
_TEXT = "\n".join(_PARAGRAPHS)
_TEASER = "<p>Some teaser text that is fairly long to look like prose, really, as teasers on pages do.</p>"


@pytest.mark.parametrize("body, want", [
    (f"<div class='content-sidebar-wrap'><main><article>{_BODY}</article></main></div>", _TEXT),
    (f"<div class='layout has-sidebar'><article>{_BODY}</article><div class=sidebar>{_TEASER}</div></div>", _TEXT),
    (f"<div id=search-results-page><article>{_BODY}</article></div>", _TEXT),
    (f"<article>{_BODY}<button>Share<p>After the button, this paragraph is still a part of the article.</p></article>", _TEXT + "\nShare\nAfter the button, this paragraph is still a part of the article."),
    (f"<article>{_BODY}<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be a number of the kind that we need here.</p></article>", _TEXT + "\nLet x=2 be a number of the kind that we need here."),
    (f"<article>{_BODY}<p class='notice-of-award'>The award was given to the best of all authors in the year.</p></article>", _TEXT + "\nThe award was given to the best of all authors in the year."),
    (f"<article>{_BODY}<p>Before the script <script>var x = '<p>no</p>';</script> and after it, the sentence goes on.</p></article>", _TEXT + "\nBefore the script and after it, the sentence goes on."),
    (f"<article>{_BODY}</article><div id=comments><article>{_TEASER}</article></div>", _TEXT),
    (f"<div class=comments><article>{_TEASER}</article></div>", ""),
    (f"<div class=sidebar>{_TEASER}</div>", ""),
])
def test_names_of_a_layout_condemn_no_article(body, want):
    page = f"<html><head><title>t</title><script>1</script></head><body><nav><a href=/>Home</a> <a href=/x>About us</a></nav>{body}<footer>All rights reserved, some company 2020.</footer></body></html>"
    assert maintext.main_text(page) == want


def test_bad_markup_takes_linear_time():
    t0 = time.time()
    maintext.main_text("<div>" * 30_000 + "x</b></i></section>" * 30_000 + "</div>" * 30_000)
    maintext.main_text("<button>x" * 30_000)
    maintext.main_text("<head>" + "<div><script>1</script>" * 20_000)
    assert time.time() - t0 < 6


def test_vectors_of_any_finite_length(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [5e-324, 5e-324]), (5, [-1e308, 1e308]), (6, [1.0, 1.0]), (7, [0.0, 0.0])]
    got = nndescent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {x.vec_id: (x.n_links, x.component_id) for x in got.collect()} == {**{i: (4, 1) for i in (1, 2, 3, 4, 6)}, 5: (0, 5), 7: (0, 7)}


def test_pipeline_judges_rows_not_ids(spark, tmp_path):
    """An id with two texts, one of them a copy, one with a benchmark item: the other text stays, whatever happens to the first."""
    item = common.prose(70, 30)
    a, b, c, d = (common.prose(i, 90) for i in range(71, 75))
    rows = [(1, a), (5, a), (5, b), (6, c), (6, c), (7, c + " x"), (8, f"{d} {item} {d}"), (8, d), (None, a), (None, common.prose(80, 90))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    clean = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, a), (5, b), (6, c), (8, f"{d} {item} {d}"), (8, d), (0, common.prose(80, 90))])
    assert sorted((r.doc_id or 0, r.text) for r in clean.collect()) == sorted((i or 0, t) for i, t in rows if item not in t)
    assert set(kept.columns) == set(clean.columns) == set(corpus_pipeline.COLUMNS)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.decontaminate(spark, docs.limit(0), str(tmp_path)).count() == 0
