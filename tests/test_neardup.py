"""Near-duplicates against a brute-force reading in id order."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corpusloom.operators import neardup, nearindex
from corpusloom.session import scratch_path


def _shingles(text, n):
    w = text.split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))) if len(w) >= n else frozenset([tuple(w)])


def _brute(rows, n, t):
    kept, seen = [], set()
    for i, text in sorted(rows):
        if text in seen:
            continue
        seen.add(text)
        s = _shingles(text, n)
        if not any(s and k and len(s & k) / len(s | k) >= t for _, k in kept):
            kept.append((i, s))
    return {i for i, _ in kept}


def _fixture():
    r = random.Random(7)
    word = lambda: "w%d" % r.randrange(4000)
    base = [[word() for _ in range(100)] for _ in range(12)]
    rows = [" ".join(b) for b in base]
    for b in base[:6]:
        rows.append(" ".join(b))  # exact copy
        for edits in (1, 2, 4, 8, 15):
            c = list(b)
            for _ in range(edits):
                c[r.randrange(100)] = word()
            rows.append(" ".join(c))
    # A chain: each link near the one before it, the ends apart.
    link = [word() for _ in range(100)]
    for step in range(6):
        rows.append(" ".join(link))
        link = link[9:] + [word() for _ in range(9)]
    # A third of all rows share a long passage but are not near-duplicates.
    passage = [word() for _ in range(60)]
    rows += [" ".join(passage + [word() for _ in range(60)]) for _ in range(30)]
    rows += ["", "", "one two three", "one two three", "one two four", "a " * 40]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def rows():
    return _fixture()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").repartition(5)


def test_exact_equals_brute_force(df, rows):
    for n, t in ((10, 0.7), (3, 0.5)):
        got = {r.id for r in neardup.dedup_near(df, "id", "text", n, t, None).collect()}
        assert got == _brute(rows, n, t)


def test_pairs_point_at_kept_rows(df, rows):
    kept = _brute(rows, 10, 0.7)
    pairs = neardup.near_duplicate_pairs(df, "id", "text", num_perm=None).collect()
    assert {p.id for p in pairs} == {i for i, _ in rows} - kept
    text = dict(rows)
    for p in pairs:
        assert p.kept_id in kept and p.kept_id < p.id
        a, b = _shingles(text[p.id], 10), _shingles(text[p.kept_id], 10)
        assert p.similarity >= 0.7
        assert a == b or abs(p.similarity - len(a & b) / len(a | b)) < 1e-9


def test_bands_keep_precision_and_recall(df, rows):
    exact = _brute(rows, 10, 0.7)
    got = {r.id for r in neardup.dedup_near(df, "id", "text", num_perm=256).collect()}
    missed = got - exact
    assert exact - got <= set() or len(exact - got) <= 2  # a missed drop can free or bind a follower
    assert len(missed) <= 0.2 * (len(rows) - len(exact))


def test_number_of_leaders_changes_no_result(df, rows, monkeypatch):
    for num_perm in (64, None):
        want = {r.id for r in neardup.dedup_near(df, "id", "text", num_perm=num_perm).collect()}
        monkeypatch.setattr(neardup, "LEADERS", 2)
        got = {r.id for r in neardup.dedup_near(df, "id", "text", num_perm=num_perm).collect()}
        monkeypatch.undo()
        assert got == want
        assert _brute(rows, 10, 0.7) <= got


def test_rows_that_only_share_keys_settle_in_few_rounds(spark, monkeypatch):
    """600 texts of three quarters common words: all stay, in far fewer rounds than there are rows."""
    r = random.Random(9)
    common = ["c%d" % i for i in range(9)]
    texts = [" ".join(r.sample(common + ["u%d_%d" % (i, k) for k in range(3)], 12)) for i in range(600)]
    rounds, greedy = [], neardup._greedy
    monkeypatch.setattr(neardup, "_greedy", lambda *a: rounds.append(greedy(*a)) or rounds[-1])
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert neardup.dedup_near(d, "id", "text", 1, 0.7, None).count() == 600
    assert len(rounds[0]) < 10


def test_result_ignores_row_order_and_partitions(spark, rows):
    a = spark.createDataFrame(list(reversed(rows)), "id long, text string").repartition(3)
    got = {r.id for r in neardup.dedup_near(a, "id", "text", num_perm=128).collect()}
    b = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    assert got == {r.id for r in neardup.dedup_near(b, "id", "text", num_perm=128).collect()}


def _index_batches():
    """Base texts; copies, changed texts, texts without words and NULL ids in later batches."""
    r = random.Random(8)
    base = [" ".join(r.choice("abcdefghij") + r.choice("klmnop") for _ in range(r.choice([4, 12, 40, 120]))) for _ in range(60)]

    def changed(t):
        w = t.split()
        for _ in range(r.choice([1, 1, 2])):
            w[r.randrange(len(w))] = "zz"
        return " ".join(w)

    first = [(i, t) for i, t in enumerate(base)] + [(100 + i, base[i]) for i in range(0, 60, 3)] + [(190, None), (191, " ")]
    second = [(300 + i, changed(t)) for i, t in enumerate(base)]
    later = [(500 + i, changed(t)) for i, t in enumerate(base)] + [(600 + i, t) for i, t in enumerate(base[:9])] + [(None, base[0]), (700, ""), (701, None), (500, base[1])]
    return first, second, later


def _index_brute(index, later, n, t):
    sets = {}
    for i, x in index:
        if s := _shingles(x or "", n):
            sets.setdefault(s, set()).add(i)
    out = []
    for i, x in later:
        s = _shingles(x or "", n)
        out += [(i, min(ids), round(len(s & k) / len(s | k), 9), len(ids)) for k, ids in sets.items() if s and len(s & k) >= t * len(s | k)]
    return sorted(map(repr, out))


def test_index_against_all_pairs(spark):
    first, second, later = _index_batches()
    shape = "id long, text string"
    path = scratch_path(spark, "index-test")
    p = nearindex.Params(ngrams=3, threshold=0.6, num_perm=256)
    nearindex.build_index(spark.createDataFrame(first, shape), path, "id", "text", p)
    batch = spark.createDataFrame(later, shape).withColumnRenamed("id", "key").withColumn("cls", F.lit("clash"))
    said = lambda df: sorted(repr((r.id, r.seen_id, round(r.similarity, 9), r.n_seen)) for r in df.collect())
    want = _index_brute(first, later, 3, 0.6)
    assert said(nearindex.match_index(batch, path, "key", "text", p)) == want and len(want) > 30
    # A further batch, half of it known already; then once more, which changes nothing.
    grown = second + first[:20]
    for _ in range(2):
        nearindex.add_to_index(spark.createDataFrame(grown, shape), path, "id", "text")
        assert said(nearindex.match_index(batch, path, "key", "text")) == _index_brute(first + second, later, 3, 0.6)
    assert nearindex.match_index(batch.limit(0), path, "key", "text").count() == 0


def test_index_refuses_other_parameters(spark):
    path = scratch_path(spark, "index-test")
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "id long, text string")
    with pytest.raises(ValueError, match="no index"):
        nearindex.match_index(df, path, "id", "text")
    nearindex.build_index(df, path, "id", "text")
    for other in (nearindex.Params(ngrams=9), nearindex.Params(threshold=0.8), nearindex.Params(num_perm=128), nearindex.Params(seed=2)):
        with pytest.raises(ValueError, match="has Params"):
            nearindex.match_index(df, path, "id", "text", other)
        with pytest.raises(ValueError, match="has Params"):
            nearindex.add_to_index(df, path, "id", "text", other)
    assert [tuple(r) for r in nearindex.match_index(df, path, "id", "text", nearindex.Params()).collect()] == [(1, 1, 1.0, 1)]
    with pytest.raises(AnalysisException):
        nearindex.build_index(df, path, "id", "text")
    with pytest.raises(ValueError, match="cannot find"):
        nearindex.Params(num_perm=4).shape


def test_index_bands_find_pairs_at_the_threshold():
    for t in (0.5, 0.7, 0.9):
        b, r = nearindex.Params(threshold=t).shape
        assert b * r <= 256 and (1 - t**r) ** b <= nearindex.MISS


def test_band_shape():
    assert neardup.band_shape(256, 0.7) == (28, 9)
    b, r = neardup.band_shape(32, 0.7)
    assert b * r <= 32 and abs((1 / b) ** (1 / r) - 0.7) < 0.05


def test_exact_keys_move_the_shingles_once(spark, monkeypatch):
    """Shared shingles are counted where they are sorted, in tasks that follow their number: no table of frequencies is made beside them."""
    rows = [(i, [(j << 20) + (j << 40) for j in range(i % 3, i % 3 + 10)]) for i in range(6)] + [(9, [5 << 50])]
    sets = spark.createDataFrame(rows, "id long, s array<bigint>")
    monkeypatch.setattr(neardup, "stable", None)
    monkeypatch.setattr(neardup, "KEY_ROWS", 4)
    keys = neardup._prefix_keys(sets, 0.7)
    assert "RepartitionByExpression [key" in (plan := keys._jdf.queryExecution().analyzed().toString()) and ", 16" in plan  # 61 shingles
    held = {}
    for r in keys.collect():
        held.setdefault(r.id, set()).add(r.key)
    assert 9 not in held and all(held[i] & held[j] for i in range(6) for j in range(6))


def test_text_ids_do_not_travel_with_shingles(spark, monkeypatch):
    """Text ids are numbered in their order before the shingles are made, and come back in the result."""
    words = [f"w{i}" for i in range(40)]
    rows = [("b-2", " ".join(words)), ("b-10", " ".join(words[:38])), ("a", " ".join(words[1:])), ("c", "else"), ("d", "else"), (None, "x y")]
    seen, greedy = [], neardup._greedy
    monkeypatch.setattr(neardup, "_greedy", lambda sets, keys, t: seen.append(sets.schema["id"].dataType.simpleString()) or greedy(sets, keys, t))
    df = spark.createDataFrame(rows, "id string, t string")
    got = {(r.id, r.kept_id, round(r.similarity, 3)) for r in neardup.near_duplicate_pairs(df, "id", "t", 3, 0.7, None).collect()}
    assert seen == ["bigint"]
    assert got == {("b-10", "a", round(35 / 38, 3)), ("b-2", "a", round(37 / 38, 3)), ("d", "c", 1.0)}
