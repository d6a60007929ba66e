"""Ranking, gazetteers, answer scores and function runs against plain Python."""

import math
import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusloom.operators import evaluation, gazetteer, retrieval, scoring, substrings
from corpusloom.plans import packaging


def _pairs():
    r = random.Random(3)
    w = lambda n: " ".join(r.choice("a b c d e f g h".split()) for _ in range(n))
    return [(i, w(r.randrange(1, 30)), w(r.randrange(1, 30))) for i in range(40)] + [(90, "x y z", ""), (91, "same text here now", "same text here now")]


def test_bleu(spark):
    rows = _pairs()
    df = spark.createDataFrame(rows, "id int, ref string, hyp string").repartition(4)
    num, den, hl, rl = Counter(), Counter(), 0, 0
    for _, ref, hyp in rows:
        r, h = ref.split(), hyp.split()
        hl, rl = hl + len(h), rl + len(r)
        for n in range(1, 5):
            g = lambda t: Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))
            num[n] += sum((g(h) & g(r)).values())
            den[n] += max(len(h) - n + 1, 0)
    want = math.exp(sum(math.log(num[n] / den[n]) for n in range(1, 5)) / 4) * (1 if hl > rl else math.exp(1 - rl / hl))
    assert abs(evaluation.corpus_bleu(df, "id", "ref", "hyp").first().bleu - want) < 1e-9
    assert evaluation.corpus_bleu(df.where("id = 91"), "id", "ref", "hyp").first().bleu == pytest.approx(1.0)
    assert evaluation.corpus_bleu(df.where("id = 90"), "id", "ref", "hyp").first().bleu == 0.0


def test_bleu_tokens(spark):
    df = spark.createDataFrame([('Hi, "you" 3.5-4 &amp; a.b',)], "c string")
    assert df.select(evaluation.bleu_tokens("c").alias("t")).first().t == ["Hi", ",", '"', "you", '"', "3.5", "-", "4", "&", "a", ".", "b"]


def test_rouge(spark):
    rows = _pairs()
    df = spark.createDataFrame(rows, "id int, ref string, hyp string").repartition(4)

    def lcs(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    f1 = lambda c, h, r: 0.0 if not c else 2 * (c / h) * (c / r) / (c / h + c / r)
    s1 = s2 = sl = 0.0
    for _, ref, hyp in rows:
        r, h = ref.split(), hyp.split()
        g = lambda t, n: Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))
        s1 += f1(sum((g(h, 1) & g(r, 1)).values()), len(h), len(r))
        s2 += f1(sum((g(h, 2) & g(r, 2)).values()), len(h) - 1, len(r) - 1)
        sl += f1(lcs(h, r), len(h), len(r))
    got = evaluation.rouge(df, "id", "ref", "hyp").first()
    n = len(rows)
    assert got.n == n
    assert (got.rouge1, got.rouge2, got.rougeL) == pytest.approx((s1 / n, s2 / n, sl / n))


def test_accuracy_overlap_means(spark):
    df = spark.createDataFrame([("A", "A"), (" B", "B"), ("b", "B"), ("Because", "C"), (None, "A")], "p string, r string")
    assert evaluation.choice_accuracy(df, "p", "r").first().accuracy == pytest.approx(0.4)
    o = spark.createDataFrame([("a b c", "a a x"), ("a", "")], "r string, h string")
    assert evaluation.token_overlap(o, "r", "h").first().overlap == pytest.approx(0.25)
    v = spark.createDataFrame([("recall", 4), ("recall", None), ("precision", 1), ("precision", 2)], "metric string, s int")
    got = {r.metric: (r.n, r.mean_score) for r in evaluation.judge_means(v, score="s").collect()}
    assert got == {"recall": (1, 4.0), "precision": (2, 1.5)}
    # Published accuracies of one fine-tuning run, by step.
    steps = spark.createDataFrame([("m", 50, 0.6852), ("m", 350, 0.7469), ("m", 400, 0.7407), ("n", 1, 0.5), ("n", 2, 0.5)], "model string, step int, accuracy double")
    assert {r.model: (r.best, r.best_step) for r in evaluation.leaderboard(steps).collect()} == {"m": (0.7469, 350), "n": (0.5, 1)}


def test_bm25_tasks_follow_the_scores(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c") for i in range(60)], "doc_id long, text string")
    q = spark.createDataFrame([(i, "a b") for i in range(10)], "query_id long, text string")
    want = retrieval.bm25(docs, q, 3).collect()
    monkeypatch.setattr(retrieval, "SCORES", 100)  # 60 documents, 2 terms, 10 queries: 1,200 scores
    got = retrieval.bm25(docs, q, 3)
    assert "doc_id" in (plan := got._jdf.queryExecution().analyzed().toString()) and re.search(r"RepartitionByExpression \[doc_id#\d+L\], 12\b", plan)
    assert sorted(got.collect()) == sorted(want)


def test_bm25(spark):
    docs = [(1, "The cat sat on the mat."), (2, "Dogs and cats"), (3, "the the the"), (4, ""), (5, "A cat, a CAT!")]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    q = spark.createDataFrame([(7, "cat The"), (8, "zebra")], "query_id int, text string")
    import re
    toks = {i: [w for w in re.split(r"[^a-z0-9]+", t.lower()) if w] for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)

    def score(i):
        s = 0.0
        for w in ("cat", "the"):
            d = sum(w in t for t in toks.values())
            tf = toks[i].count(w)
            s += math.log(1 + (n - d + .5) / (d + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(toks[i]) / avg))
        return s

    want = sorted(((-round(score(i), 6), i) for i in toks if score(i) > 0))
    got = retrieval.bm25(df, q, 3).orderBy("pos").collect()
    assert [(r.doc_id, r.pos) for r in got] == [(i, k + 1) for k, (_, i) in enumerate(want[:3])]
    assert [r.score for r in got] == pytest.approx([-s for s, _ in want[:3]], abs=1e-6)


@pytest.mark.parametrize("hot", [1_000_000, 0])
def test_gazetteer(spark, hot):
    pages = spark.createDataFrame([("Fire", "jutsu"), ("Fire", "clan"), ("Fire Ball", "jutsu"), ("", "x"), ("none", None), ("ß日", "clan")], "title string, tag string")
    d = gazetteer.tag_dictionary(pages)
    docs = spark.createDataFrame([(1, "Campfire Fire Ball Fire"), (2, "fire"), (3, None), (4, "aaß日本"), (None, "aFire"), (None, "Fire"), (1, "Fire"), (1, "Fire")], "id int, text string")
    got = gazetteer.annotate_gazetteer(docs, d, "id", "text", hot=hot)
    want = [
        (1, "Fire", "clan", 0, 4), (1, "Fire", "clan", 0, 4), (1, "Fire", "clan", 9, 13), (1, "Fire", "jutsu", 0, 4), (1, "Fire", "jutsu", 0, 4), (1, "Fire", "jutsu", 9, 13),
        (1, "Fire Ball", "jutsu", 9, 18), (4, "ß日", "clan", 2, 4),
        (None, "Fire", "clan", 0, 4), (None, "Fire", "clan", 1, 5), (None, "Fire", "jutsu", 0, 4), (None, "Fire", "jutsu", 1, 5),
    ]
    for rows in (gazetteer.annotation_rows(got, "id"), gazetteer.gazetteer_rows(docs, d, "id", "text", hot)):
        assert sorted(map(repr, want)) == sorted(repr((r.id, r.title, r.entity_type, r.start_word, r.end_word)) for r in rows.collect())
    assert got.count() == 8
    p = {r.input: r.response for r in gazetteer.entity_prompts(got, "text").collect()}
    assert p["Campfire Fire Ball Fire"] == '{"Fire":{"start_word":9,"end_word":13,"entity_type":"jutsu"},"Fire Ball":{"start_word":9,"end_word":18,"entity_type":"jutsu"}}'
    assert p["fire"] == "{}"
    assert gazetteer.gazetteer_rows(docs, d.limit(0), "id", "text").count() == 0
    assert gazetteer.gazetteer_rows(docs.limit(0), d, "id", "text").count() == 0


@pytest.mark.parametrize("part", [1 << 19, 40])
def test_titles_of_all_lengths(spark, monkeypatch, part):
    """Random titles of 1 to 90 characters that overlap, against str.find; texts longer than a part, and a filter too small to help."""
    monkeypatch.setattr(substrings, "PART", part)
    monkeypatch.setattr(substrings, "LEAST_BITS", 1 << 15)
    r = random.Random(part)
    texts = ["".join(r.choice("ab é𝒳\n") for _ in range(r.choice([0, 1, 5, 60, 300]))) for _ in range(40)] + [None]
    titles = set()
    for t in texts:
        for _ in range(8 if t else 0):
            i = r.randrange(len(t))
            titles |= {t[i : i + r.choice([1, 2, 3, 7, 8, 9, 31, 90])]}
    titles |= {t[:-1] + "q" for t in titles} | {"zz", ""}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3)
    d = spark.createDataFrame([(t,) for t in sorted(titles)] + [(None,)], "title string")
    got = gazetteer.gazetteer_rows(docs, d.withColumn("entity_type", F.lit("x")), "id", "text")
    want = sorted((i, t, x.find(t)) for i, x in enumerate(texts) if x for t in titles if t and t in x)
    assert sorted((x.id, x.title, x.start_word) for x in got.collect()) == want


def test_dictionary_of_200_000_titles(spark):
    """Titles that share their beginnings, joined without being collected."""
    titles = spark.range(200_000).select(F.concat(F.lit("List of things numbered "), F.col("id").cast("string")).alias("title"), F.lit("list").alias("entity_type"))
    docs = spark.range(3000).select("id", F.concat(F.lit("see List of things numbered "), (F.col("id") * 61).cast("string"), F.lit(" and List of things numbered 7.")).alias("text"))
    got = gazetteer.gazetteer_rows(docs, titles, "id", "text").groupBy("id").agg(F.collect_set("title").alias("t"))
    rows = {x.id: x.t for x in got.collect()}
    assert len(rows) == 3000
    for i in (0, 1, 17, 2999):
        said = str(i * 61)
        assert set(rows[i]) == {f"List of things numbered {said[:k]}" for k in range(1, len(said) + 1)} | {"List of things numbered 7"}


def test_suggest_and_title_search(spark):
    t = spark.createDataFrame([(1, "Satu"), (2, "saturn x"), (3, "Mercury"), (4, "Satu")], "doc_id int, title string")
    assert [r.title for r in retrieval.suggest(t, "SA", 5).collect()] == ["Satu", "saturn x"]
    q = spark.createDataFrame([(1, "who is Mercury or Satu?")], "query_id int, text string")
    assert [(r.doc_id, r.pos) for r in retrieval.search_by_title(t, q, 2).orderBy("pos").collect()] == [(3, 1), (1, 2)]


def test_scoring_retries_memo_and_errors(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "bad")], "id int, prompt string")
    log = str(tmp_path)

    def fn(p):
        import os
        import uuid
        open(os.path.join(log, f"{p}-{uuid.uuid4().hex}"), "w").close()
        if p == "bad":
            raise RuntimeError("no")
        return p.upper()

    got = {(r.id, r.sample_no): (r.output, r.error) for r in scoring.score_prompts(df, fn, samples=2, retries=3).collect()}
    assert got[(1, 0)] == got[(2, 1)] == ("OK", None) and got[(3, 0)] == (None, "RuntimeError: no")
    import os
    calls = Counter(f.split("-")[0] for f in os.listdir(log))
    assert calls == {"ok": 2, "bad": 6}


def test_groups_stream(spark):
    df = spark.createDataFrame([(k, i) for i in range(300) for k in (None, "a", "b") if k != "b" or i < 3], "k string, i int").repartition(4)

    def fn(key, batches):
        rows = [i for b in batches for i in b["i"].tolist()]
        yield pd.DataFrame({"k": [key[0]], "n": [len(rows)], "in_order": [rows == sorted(rows, reverse=True)]})
        if key[0] == "b":
            yield pd.DataFrame({"k": ["b, again"], "n": [0], "in_order": [True]})

    got = scoring.apply_groups(df, ["k"], fn, "k string, n int, in_order boolean", [F.desc("i")])
    assert len(re.findall(r"Exchange hashpartitioning", got._jdf.queryExecution().executedPlan().toString())) == 1
    assert sorted(map(repr, got.collect())) == sorted(map(repr, [Row(k=None, n=300, in_order=True), Row(k="a", n=300, in_order=True), Row(k="b", n=3, in_order=True), Row(k="b, again", n=0, in_order=True)]))
    assert scoring.apply_groups(df.limit(0), ["k"], fn, "k string, n int, in_order boolean").count() == 0


def test_a_group_of_two_million_rows_takes_little_memory(spark):
    """A group whose rows are 1 GB together, in a worker that never holds more than some batches."""
    df = spark.range(2_000_000).select(F.lit(1).alias("k"), "id", F.repeat(F.md5(F.col("id").cast("string")), 16).alias("t"))

    def fn(key, batches):
        import resource

        n = size = 0
        for b in batches:
            n, size = n + len(b), size + int(b["t"].str.len().sum())
        yield pd.DataFrame({"n": [n], "size": [size], "mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024]})

    got = scoring.apply_groups(df, ["k"], fn, "n long, size long, mb double").first()
    assert got.n == 2_000_000 and got.size == 512 * 2_000_000 and got.mb < 1024


def test_judge_prompts_show_their_own_documents(spark):
    df = spark.createDataFrame([(1, "q1", "a1", "b1", "c1"), (2, "q2", "a2", None, "c2")], "task_id int, question string, answer string, background string, context string")
    got = {(r.task_id, r.metric): r.prompt for r in packaging.judge_prompts(df, {"recall": "{query}|{history}|{FullBody}", "precision": "{query}|{reply}|{FullBody}"}).collect()}
    assert got == {(1, "recall"): "q1||b1\nc1", (1, "precision"): "q1|a1|b1\nc1", (2, "recall"): "q2||\nc2", (2, "precision"): "q2|a2|\nc2"}


def test_rag_prompt_without_hits(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "beta"), (2, "zzz")], "query_id int, text string")
    bg = retrieval.hit_lists(retrieval.bm25(docs, q, 5), docs, 1)
    got = {r.query_id: r.prompt for r in retrieval.build_rag_prompt(q, bg, "{query}>{background}>{context}").collect()}
    assert got == {1: "beta>1. alpha beta>", 2: "zzz>>"}


def test_quality_gate(spark):
    rows = [(i, f"question {i} about things A. one B. two" if i % 2 else f"plain question {i} over here") for i in range(10)]
    df = spark.createDataFrame(rows + [(99, rows[0][1])], "id int, input string")
    scores = df.select("id", F.when(F.col("id") == 4, 0.1).otherwise(0.5).alias("score"))
    got = {r.id: r.instruction for r in scoring.quality_gate(df, scores, "id", num_perm=None).collect()}
    assert set(got) == set(range(10)) - {4}
    assert [got[i] for i in (1, 3, 5, 7, 9)][0] == got[9] and got[0] == "Answer the question" and got[2] == "Answer the following question"
