"""Text functions, filters, prompts and replies on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import fixed, text
from corpusloom.operators import aggregates, chunking, filters, joins, prompts, sampling, sets, windows
from corpusloom.plans import answers, episodes, packaging


def _one(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn("c").alias("v")).first().v


def test_tokens_match_python_split(spark):
    cases = ["", "  ", "a", " a b ", "a b", "a b\x1cc\x85d", "x\ty\n\nz\r", "ünï cödé", "　a"]
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", text.tokens("c").alias("t"), text.word_count("c").alias("n"))
    for r in df.collect():
        assert r.t == r.c.split() and r.n == len(r.c.split())
    assert _one(spark, None, text.word_count) == 0


def test_truncate_keeps_the_word_limit(spark):
    cut = lambda s, n: _one(spark, s, lambda c: text.truncate_words(c, n))
    assert cut("a  b c", 10) == "a  b c"
    assert cut("a  b c d", 4) == "a b c d"  # 4.8 estimated tokens, so cut to 4 words
    assert cut("a  b c d e", 4) == "a b c d"
    assert _one(spark, None, lambda c: text.truncate_words(c, 4)) is None


def test_small_text_functions(spark):
    assert _one(spark, "a\n\n\nb", text.collapse_newlines) == "a\nb"
    assert _one(spark, "x###y#z", text.hashes_to_space) == "x y z"
    assert _one(spark, "<p>a &lt;b&gt; &amp;lt;</p><!-- n --><script>q()</script>", text.html_to_text) == "a <b> &lt;"
    coded = "&eacute;&#233;&#xE9;&#x1F600; &amp;lt; &#38;lt; &bogus; a&b; &nbsp;|&apos; &#0; &#xD800; &&amp;"
    assert _one(spark, coded, text.unescape) == "ééé\U0001f600 &lt; &lt; &bogus; a&b; \u00a0|' &#0; &#xD800; &&"
    assert _one(spark, "1 < 2 and 3 > 2", text.html_to_text) == "1 < 2 and 3 > 2"
    assert _one(spark, "|a-b|c|", text.split_tags) == ["a-b", "c"]
    assert _one(spark, "<a-b><c>", text.split_tags) == ["a-b", "c"]
    assert _one(spark, "http://x/y/", text.last_segment) == ""
    assert _one(spark, "Plan A. or", text.is_multiple_choice) is True
    assert _one(spark, None, text.is_multiple_choice) is False
    assert _one(spark, "v", lambda c: text.render("{a}-{b}{a}", a=c, b=F.lit(None))) == "v-v"
    got = spark.range(1).select(text.preference_score(F.lit(3), F.lit(True)).alias("a"), text.preference_score(F.lit(0), F.lit(None).cast("boolean")).alias("b")).first()
    assert (got.a, got.b) == (3.0, -1.0)


def test_filters(spark):
    df = spark.createDataFrame([(1, "Who is Red Moon"), (2, "Is saturn?"), (3, "SATURN wins"), (4, None)], "id int, q string")
    ids = lambda d: sorted(r.id for r in d.collect())
    words = ["saturn", "red moon"]
    assert ids(filters.filter_keywords(df, "q", words)) == [3]
    hits = {r.id: r.hits for r in filters.matched_keywords(df, "q", words, "substring").collect()}
    assert hits == {1: ["red moon"], 2: ["saturn"], 3: ["saturn"], 4: []}
    assert ids(filters.filter_denylist(df, "q", ["IS SATURN?", "a.c", "x\\Ey"])) == [1, 3, 4]
    t = spark.createDataFrame([(1, "[deleted]"), (2, "x"), (3, None)], "id int, selftext string")
    assert ids(filters.drop_tombstones(t, "selftext")) == [2]
    g = spark.createDataFrame([(1, ["a", "bc"]), (2, None), (3, [])], "id int, tags array<string>")
    assert ids(filters.filter_tag_like(g, "tags", "b")) == [1]
    s = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id int, score double")
    assert ids(filters.filter_score(s, "score", ">", 0.1)) == [2] and ids(filters.filter_score(s, "score", "<", 0.1)) == []
    assert filters.epoch_to_ts(spark.createDataFrame([(0,)], "t long"), "t").first().t.year == 1970


def test_joins_and_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "question_id int, score string")
    b = spark.createDataFrame([("1", "p"), ("3", "q")], "Id string, score string")
    (r,) = joins.join_suffixed(a, b, "question_id", "Id", ("_answer", "_question")).collect()
    assert r.score_answer == "x" and r.score_question == "p"
    assert sorted(map(tuple, joins.id_diff(a, b, "question_id", "Id").collect())) == [("left_only", 2), ("right_only", 3)]
    assert [r.question_id for r in joins.pending(a, spark.createDataFrame([(1,)], "link int"), "question_id", "link").collect()] == [2]
    u = sets.union_all([a, b]).orderBy("score").collect()
    assert len(u) == 4 and u[0].question_id is None


def test_lengths_use_the_population_deviation(spark):
    import numpy as np

    texts = ["a " * n for n in (1, 4, 4, 9, 30, 2)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    r = aggregates.length_stats(df, "t").first()
    v = np.array([len(t.split()) * 1.2 for t in texts])
    assert abs(r["std"] - v.std()) < 1e-9 and abs(r["mean"] - v.mean()) < 1e-9
    for p in fixed.LENGTH_PERCENTILES:
        assert abs(r[f"p{p}"] - np.percentile(v, p)) < 1e-9


def test_describe_spread_quartiles(spark, monkeypatch):
    import numpy as np

    vals = [float((i * 7919) % 1000) for i in range(999)] + [500.0] * 500 + [None]
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(4)
    want = np.percentile([v for v in vals if v is not None], [25, 50, 75])
    for limit in (10, 10_000_000):
        monkeypatch.setattr("corpusloom.operators.skew.GROUP_LIMIT", limit)
        r = aggregates.describe(df, ["v"]).first()
        assert np.allclose([r.p25, r.p50, r.p75], want) and r.nulls == 1 and r["count"] == 1499


def test_costs(spark):
    df = spark.createDataFrame([("a b c d e",), ("a",)], "p string")
    r = {x.model: x for x in aggregates.estimate_cost(df, "p", 100, [("m", 2.0, 3.0)]).collect()}["m"]
    assert abs(r.cost - (2.0 * 7.2 / 1e6 + 3.0 * 200 / 1e6)) < 1e-15


def test_chat_shapes(spark):
    one = spark.createDataFrame([("q", "i", "r"), ("q2", None, "r2")], "query string, image string, response string")
    a, b = [r.messages for r in prompts.to_chat(one, "sys").orderBy("query").collect()]
    assert [m["role"] for m in a] == ["system", "user", "assistant"]
    assert [p["type"] for p in a[1]["content"]] == ["image", "text"] and [p["type"] for p in b[1]["content"]] == ["text"]
    many = spark.createDataFrame([("q", ["i", "j"])], "query string, image array<string>")
    (m,) = [r.messages for r in prompts.to_chat(many, "sys").collect()]
    assert [p["image"] for p in m[1]["content"]] == [None, "i", "j"] and len(m) == 2


def test_training_text(spark):
    df = spark.createDataFrame([("do", None, (1, "x"))], "instruction string, input string, response struct<a:int,b:string>")
    assert prompts.to_training_text(df, "<e>").first().text == 'do  {"a":1,"b":"x"}<e>'
    assert prompts.to_training_text(df.select("instruction"), "<e>").first().text == "do  <e>"


def test_replies(spark):
    raws = [
        ('```json\n[{"question": " q ", "answer": " a "}, {"question": "p", "choices": "A. x", "answer": "A"}]\n```',),
        ("[{\"question\": \"only\"}]",), ("not json",), ('[{"question": "q", "answer": "b"',), (None,), ("[]",),
    ]
    df = spark.createDataFrame(raws, "response string")
    good, bad = prompts.flatten_qa(df)
    assert sorted((r.input, r.response) for r in good.collect()) == [("p\nA. x", "A"), ("q\n", "a")]
    assert bad.count() == 4
    rows, rejected = prompts.flatten_instructions(spark.createDataFrame(
        [('{"instruction": "i", "output": {"k": [1, 2]}}', "P"), ('{"instruction": "i", "input": "n", "output": "o"}', "P"), ('{"output": "o"}', "P")],
        "response string, input string"))
    assert sorted((r.input, r.response) for r in rows.collect()) == [("P", '{"k":[1,2]}'), ("n", "o")]
    assert rejected.count() == 1
    y = _one(spark, "```yaml\noverall score: 4\nreason: a: b\nnoise\noverall score: 2\n```", prompts.parse_flat_yaml)
    assert y == {"overall score": "4", "reason": "a: b"}
    ctx, no = episodes.dialogue_contexts(spark.createDataFrame(
        [("001", '```[{"context": "c", "character_lines": [{"character": "N", "line": "hi"}]}, {"context": "d"}]```'), ("002", "x")], "episode_number string, output string"))
    assert sorted((r.episode_number, r.context) for r in ctx.collect()) == [("001", "c"), ("001", "d")] and no.count() == 1


def test_choice_prompt_and_lists(spark):
    df = spark.createDataFrame([("Q?", [("A", "x"), ("B", "y")], ["ex"])], "q string, c array<struct<choice:string,answer:string>>, e array<string>")
    got = df.select(prompts.render_choices("q", "c", "Pre\n", "e").alias("p")).first().p
    assert got == "Pre\nex\n\nQuestion: Q?\nA) x\nB) y\n\nAnswer:\n"
    l = spark.createDataFrame([(["a", "b"], [("1", "x")])], "a array<string>, e array<struct<episode_number:string,content:string>>")
    r = l.select(text.numbered_list("a").alias("n"), text.episode_list("e").alias("e")).first()
    assert r.n == "1. a\n2. b" and r.e == "Episode 1 - x"


def test_guideline_text():
    (t,) = prompts.with_format_guideline([{"name": "n", "guideline": "g", "examples": ["e"], "schema": {"title": "T", "type": "object", "properties": {}}}], "S:{schema}")
    assert t["guideline"] == 'g\n ### Instruction Examples: \ne\n\nS:{"properties": {}}' and "schema" not in t


def test_prompt_factory_picks_without_repeats(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "id int, t string")
    templates = [(f"n{k}", f"i{k}", "g") for k in range(4)]
    got = packaging.prompt_factory(df, templates, "id", "t", per_passage=2).collect()
    assert len(got) == 80 == len({(r.id, r.name) for r in got}) and len({r.name for r in got}) == 4
    assert got[0].prompt.startswith("\n### Instruction\ni") and "\n### Guideline\ng\n### Input\ntext " in got[0].prompt
    assert packaging.prompt_factory(df, templates, "id", "t").count() == 160


def test_training_mix_floors(spark):
    rows = [("i", "x", f"r{s}", s) for s in range(5)]
    a = spark.createDataFrame(rows, "instruction string, input string, response string, int_score int")
    forum = spark.createDataFrame([("q", None, "t", 2), ("q", "img", "v", 1), ("q", None, "low", 1), ("q", "img", "z", 0)],
                                  "query string, image string, response string, int_score int")
    texts, visual = packaging.training_mix(a, a, forum, "S", "F")
    got = sorted((r.source, r.messages[2]["content"][0]["text"]) for r in texts.collect())
    assert got == [("analyze", "r2"), ("analyze", "r3"), ("analyze", "r4"), ("forum", "t"), ("wiki", "r3"), ("wiki", "r4")]
    assert [(r.messages[2]["content"][0]["text"], r.messages[0]["content"][0]["text"]) for r in visual.collect()] == [("v", "F")]
    assert texts.where("source = 'wiki'").first().query == "i x"


def test_preferences_end_to_end(spark):
    rows = [
        (1, 10, "T", "<p>best</p>", 5, 7, True), (1, 11, "T", "mid &amp; low", 5, 3, False), (1, 12, "T", "tie", 5, 3, False),
        (2, 20, "U", "single", 1, 0, True),
    ]
    df = spark.createDataFrame(rows, "question_id int, answer_id int, title string, body string, score int, up_vote_count int, is_accepted boolean")
    got = sorted((r.question, r.response_j, r.response_k) for r in answers.qa_preferences(df).collect())
    assert got == [("T", "best", "mid & low"), ("T", "best", "tie")]


def _question_files(root):
    row = '<row Id="{}" PostTypeId="1" Title="{}" Body="&lt;p&gt;q&lt;/p&gt;" Tags="{}" Score="1" LastActivityDate="{}" />\n'
    for name, rows in {
        "a": [(1, "old", "|satu|", "2020"), (2, "two", "|satu-x|", "2020"), (3, "other", "|mars|", "2020"), (4, "alone", "|satu|", "2020")],
        "b": [(1, "new", "|satu|", "2021")],
    }.items():
        (root / name).mkdir(parents=True)
        (root / name / "Posts.xml").write_text("<posts>\n" + "".join(row.format(*r) for r in rows) + "</posts>\n")
    (root / "replies").mkdir()
    reply = lambda q, a, body, up, ok: json.dumps({"question_id": q, "answer_id": a, "title": f"T{q}", "body": body, "up_vote_count": up, "is_accepted": ok, "creation_date": 1_600_000_000})
    lines = [
        reply(1, 10, "<p>best</p>", 7, True), reply(1, 11, "mid &amp; low", 3, False), reply(1, 12, "tie", 3, False), reply(2, 20, "<b>a</b>", 2, False), reply(2, 21, "b", 0, False),
        reply(3, 30, "x", 1, True), reply(3, 31, "y", 0, False), reply(9, 90, "no question", 1, True), reply(1, 10, "<p>best</p>", 7, True),
    ]
    (root / "replies" / "1.jsonl").write_text("\n".join(lines))


def test_preference_set_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    _question_files(tmp_path)
    out = str(tmp_path / "out")
    args = (spark, f"{tmp_path}/*/Posts.xml", f"{tmp_path}/replies", out, "satu")
    # The run breaks in its third stage.
    with monkeypatch.context() as m:
        m.setattr(answers, "qa_preferences", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            answers.preference_set(*args, shares={"train": 0.5, "test": 0.5})
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"_params", "questions", "question_answers"}
    # It goes on without reading the dumps again.
    with monkeypatch.context() as m:
        m.setattr(answers, "tagged_questions", lambda *a: 1 / 0)
        got = answers.preference_set(*args, shares={"train": 0.5, "test": 0.5}).collect()
    assert sorted((r.question_id, r.question, r.response_j, r.response_k) for r in got) == [
        (1, "T1", "best", "mid & low"), (1, "T1", "best", "tie"), (2, "T2", "a", "b"),
    ]
    assert all(len({r.split for r in got if r.question_id == q}) == 1 for q in (1, 2))
    kept = spark.read.parquet(f"{out}/question_answers")
    assert {(r.title_answer, r.Title_question) for r in kept.select("title_answer", "Title_question").collect()} == {("T1", "new"), ("T2", "two")}
    # Complete tables are not made again, and other arguments are refused.
    with monkeypatch.context() as m:
        m.setattr(answers, "qa_preferences", lambda *a: 1 / 0)
        again = answers.preference_set(*args, shares={"train": 0.5, "test": 0.5}).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    with pytest.raises(ValueError, match="was begun with"):
        answers.preference_set(*args, shares={"train": 0.5, "test": 0.5}, max_pairs=1)


def test_funnel(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (None, "b"), (5, "b"), (6, "a")], "x int, v string")
    steps = {"big": F.col("x") > 1, "odd or null": F.col("x") % 2 == 1}
    said = lambda d: [tuple(r) for r in d.orderBy("pos").collect()]
    assert said(aggregates.funnel(df, steps)) == [(0, "read", 6), (1, "big", 4), (2, "odd or null", 2)]
    assert said(aggregates.funnel(df, {"big": F.col("x") > 1}, "all", ("values", F.col("v")))) == [(0, "all", 6), (1, "big", 4), (2, "values", 2)]
    assert said(aggregates.funnel(df, {}, distinct=("values", F.col("v")))) == [(0, "read", 6), (1, "values", 2)]
    assert said(aggregates.funnel(df.limit(0), steps, distinct=("values", F.col("v")))) == [(0, "read", 0), (1, "big", 0), (2, "odd or null", 0), (3, "values", 0)]


def test_samples(spark):
    df = spark.range(100).withColumn("g", F.when(F.col("id") < 70, 0).otherwise(F.col("id")))
    assert sampling.sample_n(df, 7, 1, "id").count() == 7
    a = [r.id for r in sampling.sample_n(df, 7, 1, "id").collect()]
    assert sorted(a) == sorted(r.id for r in sampling.sample_n(df.repartition(9), 7, 1, "id").collect())
    assert a != [r.id for r in sampling.sample_n(df, 7, 2, "id").collect()]
    per = sampling.sample_per_group(df, ["g"], 3, 5, "id").groupBy("g").count().collect()
    assert len(per) == 31 and max(r["count"] for r in per) == 3
    assert sampling.sample_per_group(df, ["g"], -1, 5, "id").count() == 100
    assert sampling.draw_n(df, 250, 3, "id").count() == 250
    split = sampling.hash_split(df, "id", {"a": 0.5, "b": 0.5}).groupBy("split").count().collect()
    assert sum(r["count"] for r in split) == 100 and len(split) == 2
    order = [r.id for r in sampling.shuffle(df, 9, "id").collect()]
    assert sorted(order) == list(range(100)) and order != list(range(100))


def test_fold_and_batches(spark):
    df = spark.createDataFrame([("a", i, f"v{i}") for i in range(5)] + [("b", 1, "x")], "s string, k int, v string")
    got = {(r.s, r.k): r.result for r in windows.fold_series(df, "s", ["k"], "v", lambda p, v: p + v).collect()}
    assert got[("a", 4)] == "v0v1v2v3v4" and got[("b", 1)] == "x"
    b = windows.with_batch_id(df, 4, ["s", "k"]).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in b] == [4, 2]


def test_sweep_judges_no_overlap_after_the_first_that_fits(spark, monkeypatch):
    """Overlaps are judged one by one: none after the one taken, and never the last, which is taken unjudged."""
    tried, cut = [], chunking._cut_by_plans
    monkeypatch.setattr(chunking, "_cut_by_plans", lambda df, plans, *a: tried.append([p[:2] for p in plans]) or cut(df, plans, *a))
    s = spark.createDataFrame([("p", "t", 1, "h", " ".join(["w"] * 200))], "page_id string, title string, pos int, heading string, content string")
    got = chunking.chunk_sweep(s, (12, 90), 6, first_overlap=10, grow=10, dedup=False)
    taken = {(r.context_length, r.overlap) for r in got.select("context_length", "overlap").distinct().collect()}
    judged = [p[0] for p in tried[:-1]]
    assert all(len(p) == 1 for p in tried[:-1]) and (12, 20) not in judged and (12, 10) in judged  # two words a window: no rows, none over
    last = max(o for n, o in judged if n == 90)
    assert taken == {(90, last)} and last < 90 and tried[-1] == [(12, 10), (90, last)]
