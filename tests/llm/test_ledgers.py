"""Secret ledger, periodic runs and the Merkle manifest against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.llm import merkle, periodic, secret_ledger
from corpusloom.llm.queries import SQL, with_planted_period
from corpusloom.session import scratch_path
from tests import oracle
from tests.llm import common

SF = "/root/testdata/sf0.001"
NEW = ("op11_blob_ledger", "op12_basic_factors", "op13_interval_manifest")


@pytest.mark.parametrize("name", NEW)
def test_registered_query(spark, name):
    got = oracle.compare(spark, SF, name, entry.queries()[name], SQL[name], oracle.connect(SF))
    assert got["ok"], got["why"]


def _as_tables(spark, tmp_path, df):
    df.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"), "n", "h", "key").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# Secrets

BASE = {
    "assign": (re.compile(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def _base_spans(text):
    found = []
    for place, (kind, (pattern, keep)) in enumerate(BASE.items()):
        found += [(m.start(), place, kind, m.end()) for m in pattern.finditer(text or "") if keep(m)]
    return [(k, s, e) for s, _, k, e in sorted(found)]


TRICKY = [
    "password=token=abcdef x", "secret: key token: abcdefg", "password=token:abcdef", "PassWord = 'hunter2hunter2'", "api_key:\"a.b-c_d/e+f=\"", "apikey  =  12345", "apikey  =  123456",
    "ſecret=abcdefgh", "toKen=abcdefgh", "é token=zzzzzzz é", "AKIA" + "A" * 15, "AKIA" + "B" * 16, "xAKIAAKIA" + "C" * 16, "AKIAshort AKIA" + "9" * 30,
    "f" * 23, "f" * 24, "F" * 30, "0" * 24 + "g" + "1" * 25, "token=" + "deadbeef" * 4, "password=\nabcdefgh", "passwd='AKIA" + "Q" * 20 + "'", "tokentoken=aaaaaaa", "𝒳 secret=" + "b" * 40 + " token=cccccc",
    "-----BEGIN RSA PRIVATE KEY----- x", "ghp_" + "z" * 36, "eyJ" + "a" * 8 + "." + "b" * 9 + "." + "c" * 8,
]


def test_base_spans_against_plain_matches(spark, tmp_path):
    odd, _ = common.odd_documents(spark)
    texts = spark.createDataFrame([(100 + i, t, "en", "s1") for i, t in enumerate([*TRICKY, " ".join(TRICKY), "token=abcdefg " * 20_000])], "doc_id long, text string, lang string, source string")
    for c in common.EXTRA:
        texts = texts.withColumn(c, F.lit("clash"))
    docs = odd.unionByName(texts, allowMissingColumns=True)
    got = entry.queries()["op11_blob_ledger"](spark, _as_tables(spark, tmp_path, docs)).collect()
    want = []
    for r in docs.collect():
        s = _base_spans(r.text)
        want.append((r.doc_id, *[sum(k == kind for k, _, _ in s) for kind in BASE], _sha(",".join(f"{k}:{a}:{b}" for k, a, b in s))))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)) for r in got)
    by = {r.doc_id: r.spans for r in got}
    assert by[123] == "private_key:0:31" and by[124] == "service_token:0:40" and by[125].startswith("web_token:0:30")
    # All base spans are among all spans, in order.
    for r in got:
        base = [x for x in r.spans.split(",") if x.split(":")[0] in BASE]
        assert _sha(",".join(base)) == r.base_sha256


def _ledger_rows(spark, path):
    return [(bytes(r.blob), sorted(r.rules)) for r in secret_ledger.read_ledger(spark, path).collect()]


@pytest.mark.parametrize("few", [100_000, 0])
def test_only_unseen_blobs_and_rule_versions_are_scanned(spark, monkeypatch, few):
    monkeypatch.setattr(secret_ledger, "BROADCAST_BLOBS", few)
    path = scratch_path(spark, "ledger-test")
    shape = "doc_id long, text string"
    old = spark.createDataFrame([(1, "token=abcdefg"), (2, "token=abcdefg"), (3, None), (4, ""), (4, "plain")], shape)
    first = secret_ledger.scan(old, path, secret_ledger.BASE)
    assert sorted((r.doc_id, len(r.spans)) for r in first.collect()) == [(1, 1), (2, 1), (3, 0), (4, 0), (4, 0)]
    rows = _ledger_rows(spark, path)
    assert len(rows) == 3 and all(r == ["access@1", "assign@1", "hex@1"] for _, r in rows)
    # The same versions again: nothing is scanned.
    secret_ledger.scan(old, path, secret_ledger.BASE)
    assert len(_ledger_rows(spark, path)) == 3
    # One new text: one new row. The findings of old blobs reach new paths.
    new = spark.createDataFrame([(7, "token=abcdefg"), (8, "secret=hhhhhhhh"), (9, "secret=hhhhhhhh")], shape)
    got = secret_ledger.scan(new, path, secret_ledger.BASE)
    assert [(r.doc_id, [tuple(s) for s in r.spans]) for r in got.orderBy("doc_id").collect()] == [
        (7, [("assign", 0, 13)]), (8, [("assign", 0, 15)]), (9, [("assign", 0, 15)]),
    ]
    assert len(_ledger_rows(spark, path)) == 4
    # A changed rule looks at known blobs alone, and its new version alone counts.
    changed = (*secret_ledger.BASE[:2], secret_ledger.Rule("hex", 2, "[0-9a-f]{7,}"))
    got = secret_ledger.scan(old.unionByName(new), path, changed)
    again = [r for r in _ledger_rows(spark, path) if r[1] == ["hex@2"]]
    assert len(again) == 4 and len(_ledger_rows(spark, path)) == 8
    assert [tuple(s) for s in got.where("doc_id = 1").first().spans] == [("assign", 0, 13)]
    older = secret_ledger.findings(secret_ledger.read_ledger(spark, path), (secret_ledger.Rule("hex", 2, "[0-9a-f]{7,}"),))
    assert older.count() == 0


def test_ledger_rows_written_twice_change_nothing(spark):
    path = scratch_path(spark, "ledger-test")
    docs = spark.createDataFrame([(1, "token=abcdefg token=1234567")], "doc_id long, text string")
    want = secret_ledger.scan(docs, path).collect()
    secret_ledger.read_ledger(spark, path).write.parquet(path + "-copy")
    spark.read.parquet(path + "-copy").write.mode("append").parquet(path)
    assert secret_ledger.scan(docs, path).collect() == want


# Periodic runs


def _plain_runs(w, least=6, power=4):
    best = {}
    for q in range(1, len(w) // power + 1):
        x = 0
        while x + q < len(w):
            if w[x] != w[x + q]:
                x += 1
                continue
            b = x
            while x + q < len(w) and w[x] == w[x + q]:
                x += 1
            if x - b + q >= max(least, power * q):
                best.setdefault((b, x - b + q), q)
    return sorted(((s, m, q) for (s, m), q in best.items()), key=lambda r: (r[0], r[2]))


def _random_words(r):
    w = []
    for _ in range(r.randint(0, 5)):
        unit = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randint(1, 9))]
        w += (unit * r.randint(1, 7))[: r.randint(1, 40)]
    return w


def test_runs_against_plain_search():
    r = random.Random(3)
    for _ in range(1500):
        w = _random_words(r)
        for least, power in ((6, 4), (3, 3), (20, 5)):
            assert periodic.find_runs(np.array(w, np.int64), least, power) == _plain_runs(w, least, power), w


def test_runs_of_long_texts_take_little_time():
    assert periodic.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert periodic.find_runs(np.tile(np.arange(3000), 50)) == [(0, 150_000, 3000)]
    a, b = [0], [0, 1]
    while len(b) < 60_000:
        a, b = b, b + a
    fib = np.array(b)
    got = periodic.find_runs(fib, 6, 3)
    assert len(got) > 1000 and all((fib[s : s + m - q] == fib[s + q : s + m]).all() for s, m, q in got[::50])


def _planted(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_runs_of_documents_against_plain_search(spark, tmp_path):
    r = random.Random(4)
    odd, _ = common.odd_documents(spark)
    more = [(1000 + i, r.choice([" ", "\n", "\x0b \t"]).join(f"w{x}" for x in _random_words(r)) + r.choice(["", " "]), "en", "s1") for i in range(120)]
    more += [(2000, "a " * 50, "en", "s1"), (2001, "a a " * 8, "en", "s1"), (2002, "A a " * 8, "en", "s1"), (2**60 + 1, "x y " * 9, "en", "s1")]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    docs = docs.where("doc_id is null or doc_id not in (7, 8)").repartition(3)  # the plain search is quadratic
    want = []
    for d in docs.collect():
        w = _planted(d.doc_id, d.text)
        runs = _plain_runs(w)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        want.append((d.doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], _sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), _sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = entry.queries()["op12_basic_factors"](spark, _as_tables(spark, tmp_path, docs)).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(x)) for x in got)
    assert sum(x[1] > 0 for x in want) > 20


def test_planted_periods(spark):
    docs = spark.createDataFrame([(i, common.prose(i, 40), "en") for i in range(60)] + [(None, "a b", "en"), (3, None, "en")], "doc_id long, text string, h string")
    got = [(r.doc_id, periodic.split_words(r.text)) for r in with_planted_period(docs).collect()]
    want = [(r.doc_id, _planted(r.doc_id, r.text)) for r in docs.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_runs_of_an_empty_table(spark):
    assert periodic.periodic_runs(common.empty_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(common.empty_documents(spark), power=2)


# Merkle manifest


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def _climb(levels, at, cur):
    proof = ""
    for nodes in levels[:-1]:
        lo = at // 16 * 16
        before, after = "".join(nodes[lo:at]), "".join(nodes[at + 1 : lo + 16])
        cur, proof, at = _sha(before + cur + after), proof + before + after, at // 16
    return cur, proof


def _plain_manifest(rows):
    """Rows (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, _sha("".join(map(_field, r))), r))
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: (sorted(v, key=lambda x: x[:3]), None) for k, v in by.items()}
    trees = {k: (v, _levels([x[2] for x in v])) for k, (v, _) in trees.items()}
    upper = _levels([trees[k][1][-1][0] for k in keys])
    lower = {c: c + 32 for c in range(65, 91)}
    out = []
    for g, k in enumerate(keys):
        leaves, levels = trees[k]
        for at, (_, _, leaf, r) in enumerate(leaves):
            forged = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            cur = _sha("".join(map(_field, (*r[:4], r[4].translate(lower))))) if forged else leaf
            cur, p1 = _climb(levels, at, cur)
            cur, p2 = _climb(upper, g, cur)
            out.append((r[0], leaf, levels[-1][0], upper[-1][0], _sha(p1 + p2), cur, cur == upper[-1][0]))
    return out


@pytest.mark.parametrize("sources", [1, 3, 40])
def test_manifest_against_plain_trees(spark, tmp_path, sources):
    odd, _ = common.odd_documents(spark)
    r = random.Random(sources)
    # A third of all rows in one source, others with 1, 16, 17 and some more leaves.
    rows = [(i, f"Text É {i}" if i % 9 else None, r.choice(["en", None]), "hot" if i % 3 == 0 or sources == 1 else f"s{r.randrange(sources)}") for i in range(700)]
    for n, s in () if sources == 1 else ((1, "one"), (16, "sixteen"), (17, "seventeen"), (256, "é"), (257, "z")):
        rows += [(10_000 + i, f"T{i}", "en", s) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in common.EXTRA:
        docs = docs.withColumn(c, F.lit("clash"))
    if sources > 1:
        docs = docs.unionByName(odd)
    path = _as_tables(spark, tmp_path, docs.repartition(5))
    got = entry.queries()["op13_interval_manifest"](spark, path).collect()
    table = spark.read.parquet(path + "/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    want = _plain_manifest([tuple(x) for x in table.collect()])
    # Equal rows may change places, so their proofs are compared as bags.
    assert sorted(map(repr, want)) == sorted(repr(tuple(x)) for x in got)
    assert {x.verified for x in got} == {True, False}


def test_manifest_nodes_are_nested_intervals(spark):
    rows = spark.createDataFrame([(i, "g", f"{i:064x}") for i in range(300)], "k long, source string, leaf string")
    m = merkle.build(rows, "source", ["k"])
    nodes = m.nodes.orderBy("level", "lo").collect()
    assert [(x.level, x.lo, x.hi) for x in nodes][:2] == [(1, 0, 16), (1, 16, 32)]
    assert [(x.level, x.lo, x.hi) for x in nodes][-3:] == [(2, 0, 256), (2, 256, 300), (3, 0, 300)]
    assert all(k.lo >= x.lo and k.hi <= x.hi for x in nodes for k in x.kids)
    assert all(x.kids[i].hi == x.kids[i + 1].lo for x in nodes for i in range(len(x.kids) - 1))


def test_manifest_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.manifest(docs)
    assert got.count() == 0 and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
