"""Ordinary and spread plans must agree whatever the group sizes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import joins, preference, skew, windows


def _rows(spark, n=400):
    # A third of all rows on key 0, some on NULL.
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 11).alias("k"),
        F.col("id"), ((F.col("id") * 37) % 20).alias("score"), F.col("id").cast("string").alias("t"),
    )


def _same(a, b):
    cols = sorted(a.columns)
    assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_dense_ids(spark):
    got = skew.dense_ids(_rows(spark), [F.desc("id")]).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(400))
    assert [r.id for r in got] == list(range(399, -1, -1))


def test_number_within_hot_equals_window(spark):
    df = _rows(spark)
    w = Window.partitionBy("k").orderBy(F.desc("score"), "id")
    want = df.withColumn("rn", F.row_number().over(w).cast("bigint"))
    for limit in (1, 40, 10_000):
        _same(skew.number_within(df, ["k"], [F.desc("score"), F.col("id")], limit=limit), want)


def test_running_before(spark):
    df = _rows(spark)
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("b", F.coalesce(F.sum("score").over(w), F.lit(0)))
    for limit in (1, 40, 10_000):
        _same(skew.running_before(df, ["k"], [F.col("id")], F.col("score"), "b", limit), want)


def test_place_within(spark):
    df = _rows(spark)
    by = Window.partitionBy("k")
    want = (
        df.withColumn("rn", F.row_number().over(by.orderBy(F.desc("score"), "id")))
        .withColumn("rank", F.rank().over(by.orderBy(F.desc("score"))))
        .withColumn("tie_end", F.count("*").over(by.orderBy(F.desc("score"))))
        .withColumn("n", F.count("*").over(by))
    )
    for limit in (1, 40, 10_000):
        _same(skew.place_within(df, ["k"], "score", [F.col("id")], limit), want)


def test_many_hot_groups_are_spread_without_a_split(spark, monkeypatch):
    """With more hot groups than a broadcast may hold no row is moved to split them off, and no hot group that lies in one partition is joined."""
    df, limit = _rows(spark), 1
    want = skew.place_within(df, ["k"], "score", [F.col("id")], 10_000)
    rows = skew.ordered_rows(df, ["k"], [F.col("id")], ["id"], 10_000)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(skew, "split_hot", None)
    _same(skew.place_within(df, ["k"], "score", [F.col("id")], limit), want)
    _same(skew.number_within(df, ["k"], [F.desc("score"), F.col("id")], limit=limit), want.drop("rank", "tie_end", "n"))
    _same(skew.ordered_rows(df, ["k"], [F.col("id")], ["id"], limit), rows)


def test_ordered_lists_pieces_hold_every_row(spark):
    df = _rows(spark)
    got = skew.ordered_lists(df, ["k"], [F.col("id")], ["id"], "l", list_limit=25)
    rows = got.collect()
    assert max(len(r.l) for r in rows) <= 25
    back = got.select("k", "piece", F.posexplode("l").alias("p", "v")).orderBy("k", "piece", "p").select("k", "v.id").collect()
    want = df.orderBy("k", "id").select("k", "id").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in want]


def test_ordered_rows_keep_the_grain(spark):
    df = _rows(spark)
    w = Window.partitionBy("k")
    want = df.select("k", F.row_number().over(w.orderBy("id")).cast("bigint").alias("place"), F.count(F.lit(1)).over(w).alias("total"), F.struct("id").alias("value"))
    for limit in (1, 40, 10_000):
        rows = skew.ordered_rows(df, ["k"], [F.col("id")], ["id"], limit)
        _same(rows, want)
        lists = skew.gather(rows, ["k"], "l", limit).collect()
        assert all(r.first == 1 + r.piece * limit and len(r.l) == min(limit, r.total - r.first + 1) for r in lists)


def test_join_few_deals_hot_keys(spark):
    left = _rows(spark).select("k", "id")
    right = spark.createDataFrame([(0, "a"), (0, "b"), (5, "c"), (99, "d"), (None, "e")], "k long, v string")
    want = left.join(right, "k")
    for limit in (0, 50, 10_000):
        _same(skew.join_few(left, right, ["k"], limit, 7), want)


def test_context_windows_over_blocks(spark):
    df = _rows(spark)
    for limit in (7, 30):
        _same(
            windows.trailing_context(df, ["k"], [F.col("id")], "t", 6, "-", limit=limit),
            windows.trailing_context(df, ["k"], [F.col("id")], "t", 6, "-", limit=10_000),
        )
        _same(
            windows.with_previous(df, ["k"], [F.col("id")], "t", limit=limit),
            windows.with_previous(df, ["k"], [F.col("id")], "t", limit=10_000),
        )


def test_round_robin_in_large_class(spark):
    df = _rows(spark)
    labels = {True: ["a", "b", "c", "d"], False: ["x", "y", "z"]}
    cls = (F.col("id") % 3 == 0)
    _same(
        windows.round_robin(df, cls, [F.col("id")], labels, limit=20),
        windows.round_robin(df, cls, [F.col("id")], labels),
    )


def test_all_pairs_meet_in_blocks(spark, monkeypatch):
    """Every pair once, over blocks of places; no row is made for a pair before the join."""
    monkeypatch.setattr(preference, "BLOCK", 4)
    rows = [(i % 3 if i % 10 else None, i, str(i), None if i % 17 == 0 else float(i * 7 % 12)) for i in range(90)]
    df = spark.createDataFrame(rows, "question_id int, answer_id int, answer string, pm_score double")
    low = lambda s: float("-inf") if s is None else s
    want = sorted((q, a, t, b, u) for q, a, t, x in rows for p, b, u, y in rows if q is not None and q == p and low(x) > low(y))
    for limit in (5, 1000):
        assert sorted(map(tuple, preference.preference_pairs(df, limit=limit).collect())) == want


def test_preference_pairs_all_capped_and_hot(spark):
    df = spark.createDataFrame(
        [(q, a, f"t{a}", float((a * 7) % 5)) for q, n in ((1, 1), (2, 2), (3, 12), (4, 30)) for a in range(n)],
        "question_id int, answer_id int, answer string, pm_score double",
    )
    a, b = df.alias("a"), df.alias("b")
    want = {
        tuple(r) for r in a.join(b, F.expr("a.question_id = b.question_id and a.pm_score > b.pm_score"))
        .selectExpr("a.question_id", "a.answer_id", "b.answer_id").collect()
    }
    for limit in (5, 10_000):
        rows = preference.preference_pairs(df, limit=limit).select("question_id", "answer_j", "answer_k").collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want
        order = preference.preference_order(df, limit=limit)
        assert order.agg(F.sum("n_worse")).first()[0] == len(want)
    for cap in (1, 4, 50):
        rows = [tuple(r) for r in preference.preference_pairs(df, max_pairs=cap).select("question_id", "answer_j", "answer_k").collect()]
        hot = [tuple(r) for r in preference.preference_pairs(df, max_pairs=cap, limit=5).select("question_id", "answer_j", "answer_k").collect()]
        assert sorted(rows) == sorted(hot)
        assert len(rows) == len(set(rows)) and set(rows) <= want
        for q in (1, 2, 3, 4):
            total = len([w for w in want if w[0] == q])
            assert len([r for r in rows if r[0] == q]) == min(cap, total)


def test_denorm_hot_post(spark):
    posts = spark.createDataFrame([("a", "x", "s"), ("b", "[deleted]", "s"), ("c", None, "s"), ("d", "y", "s")], "id string, selftext string, subreddit string")
    comments = spark.createDataFrame(
        [(f"c{i}", "t3_a", f"b{i}", 1, (i * 3) % 4, 0) for i in range(20)] + [("z", "t1_a", "r", 0, 0, 0), ("y", "t3_q", "r", 0, 0, 0)],
        "id string, parent_id string, body string, ups long, score long, downs long",
    )
    from corpusloom.plans.denorm import denorm

    whole = {r.post_id: r.comments for r in denorm(posts, comments).collect()}
    assert set(whole) == {"t3_a", "t3_d"} and whole["t3_d"] is None
    assert [c["score"] for c in whole["t3_a"]] == sorted([(i * 3) % 4 for i in range(20)], reverse=True)
    assert [c["rank"] for c in whole["t3_a"]][:6] == [1, 1, 1, 1, 1, 6]
    cut = denorm(posts, comments, list_limit=6).where("post_id = 't3_a'").orderBy("piece").collect()
    assert [len(r.comments) for r in cut] == [6, 6, 6, 2]
    assert [c for r in cut for c in r.comments] == whole["t3_a"]
    assert joins.lookup(posts, "id", "a").count() == 1
