"""The registered queries of the training-data operators, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import scratch_path, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# ASCII letters only; other letters keep their case.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def near_duplicate_sql(width: int, percent: int = 80) -> str:
    """Ctes `sets` (doc_id, s), `links` (a, b) and `comp` (doc_id, component_id) over documents."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return f"""WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {width} THEN list_transform(range(1, len(w) - {width} + 2), lambda i: {gram})
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE w END) AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
    GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)"""


@query("op1_minhash_forest", near_duplicate_sql(2) + """
SELECT sets.doc_id, len(s) AS n_shingles, component_id, sets.doc_id = component_id AS kept
FROM sets JOIN comp ON comp.doc_id = sets.doc_id""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import neardup_forest

    return neardup_forest.near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query("op2_containment", f"""WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents), iwords AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM words WHERE len(w) > 0),
igrams AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM iwords WHERE len(w) > 0),
sizes AS (SELECT item_id, CAST(count(*) AS INT) AS n_item FROM igrams GROUP BY item_id)
SELECT doc_id, item_id, n_item, CAST(count(*) AS INT) AS n_shared, count(*) / n_item AS containment
FROM grams JOIN igrams USING (g) JOIN sizes USING (item_id) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import contamination

    return contamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=5, percent=80)


@query("op3_pseudonyms")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import pseudonyms

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, key="registered-query")


@query("op4_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import language

    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    got = language.identify(table(spark, sf_dir, "documents"), fold != 2)
    return got.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op8_co_training")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import quality

    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_pivotal_mix")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op7_mincut_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import maintext

    return maintext.extract(table(spark, sf_dir, "pages"))


@query("op6_nn_descent", """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
comp AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT comp.vec_id, coalesce(n_links, 0) AS n_links, component_id, comp.vec_id = component_id AS kept FROM comp LEFT JOIN n ON n.vec_id = comp.vec_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import nndescent

    return nndescent.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


@query("op9_collinear_chains")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import passages

    return passages.repeated_passages(table(spark, sf_dir, "documents"), min_words=50, identity=0.8)


@query("op10_license_compression")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import licenses

    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


# crc32 of the decimal doc_id, unsigned, as DuckDB has no such function: a table of 256 steps, then one step per digit.
_CRC = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, CAST([ord(x) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')] AS BIGINT[])), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
    FROM documents, crc_table)"""


def _spans_sql(kind: str, place: int, pattern: str, base: str = "") -> str:
    """Rows (doc_id, place, kind, s, e) of one rule: matches and what lies between them, laid end to end."""
    q = pattern.replace("'", "''")
    return f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, s, s + length(m[i]) AS e, m[i] AS found FROM (
    SELECT doc_id, m, i, CAST(list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS BIGINT) AS s FROM (
    SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{q}') AS m, string_split_regex(text, '{q}') AS p FROM documents WHERE regexp_matches(text, '{q}')))) {base}"""


_WORD = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
_ASSIGN_HEAD = rf"""(?:{_WORD})["']?\x20*[:=]\x20*["']?"""
_HEAD_SQL = _ASSIGN_HEAD.replace("'", "''")
_SECRETS_SQL = "WITH found AS (" + "\nUNION ALL ".join([
    _spans_sql("assign", 1, _ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]+", f"WHERE length(regexp_replace(m[i], '^{_HEAD_SQL}', '')) >= 6"),
    _spans_sql("access", 2, "AKIA[A-Z0-9]+", "WHERE length(m[i]) >= 20"),
    _spans_sql("hex", 3, "[0-9a-f]{24,}"),
    _spans_sql("private_key", 4, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    _spans_sql("web_token", 5, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    _spans_sql("service_token", 6, "gh[oprsu]_[A-Za-z0-9]{36,}"),
]) + """), per AS (SELECT doc_id, count(*) FILTER (WHERE place = 1) AS n_assign, count(*) FILTER (WHERE place = 2) AS n_access, count(*) FILTER (WHERE place = 3) AS n_hex,
    string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, place) FILTER (WHERE place <= 3) AS base, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, place) AS spans FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id"""


@query("op11_blob_ledger", _SECRETS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import secret_ledger

    got = secret_ledger.scan(table(spark, sf_dir, "documents"), scratch_path(spark, "secret-ledger"))
    base = [r.name for r in secret_ledger.BASE]
    said = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")
    return got.select(
        "doc_id", *[n(k).alias(f"n_{k}") for k in base],
        F.sha2(said(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
    )


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h = crc32(doc_id) and g = h div 10, where 10 divides h the words of the text from a = g mod n on repeat the
    p = 1 + (n - a) div (3 + g mod 8) words there."""
    from corpusloom.llm.sqlwords import let

    whole = F.col("text")
    # `let` computes the words once, however often a word is taken from them.
    def planted(w):
        return let(F.struct(F.size(w).cast("bigint").alias("n"), F.floor(F.crc32(F.col("doc_id").cast("string")) / 10).alias("g")), lambda v: let(
            F.struct((v["g"] % v["n"]).alias("a"), (1 + F.floor((v["n"] - v["g"] % v["n"]) / (3 + v["g"] % 8))).alias("p")),
            lambda c: F.array_join(F.transform(w, lambda x, i: F.when(i < c["a"], x).otherwise(F.get(w, (c["a"] + (i - c["a"]) % c["p"]).cast("int")))), " "),
        ))

    words = F.filter(F.split(whole, "[ \\t-\\r]+"), lambda x: x != "")
    chosen = (F.crc32(F.col("doc_id").cast("string")) % 10 == 0) & whole.rlike("[^ \\t-\\r]")
    return docs.select("doc_id", F.when(chosen, let(words, planted)).otherwise(whole).alias("text"))


@query("op12_basic_factors", rf"""WITH {_CRC},
raw AS (SELECT d.doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents d JOIN crc ON crc.doc_id = d.doc_id),
cut AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN g % len(w) END AS a, g FROM raw),
shape AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
texts AS (SELECT doc_id, n, CASE WHEN planted THEN list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1])) ELSE w END AS w FROM shape),
words AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM texts),
-- Words d apart that are equal, as stretches; a stretch of one distance is periodic with a divisor of it, too, where that one has the same ends.
equal AS (SELECT l.doc_id, l.i, r.i - l.i AS d FROM words l JOIN words r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
part AS (SELECT doc_id, d, i, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS island FROM equal),
stretch AS (SELECT doc_id, d, min(i) AS s, count(*) + d AS m FROM part GROUP BY doc_id, d, island HAVING count(*) + d >= greatest(6, 4 * d)),
runs AS (SELECT doc_id, s, m, min(d) AS q FROM stretch GROUP BY doc_id, s, m),
said AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', m, ',', q, chr(10)), '' ORDER BY s, q) AS said FROM runs GROUP BY doc_id),
best AS (SELECT DISTINCT ON (doc_id) doc_id, s, m, q FROM runs ORDER BY doc_id, CAST(m AS DOUBLE) / q DESC, s, q),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, m AS length, q AS period, 1000 * m // q AS exponent_milli,
    sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM texts t LEFT JOIN said ON said.doc_id = t.doc_id LEFT JOIN best ON best.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id = t.doc_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import periodic

    got = periodic.periodic_runs(with_planted_period(table(spark, sf_dir, "documents")), least=6, power=4)
    # Runs are in order, so the first of the most repeated is kept.
    most = F.aggregate("runs", F.get("runs", 0), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    said = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return got.withColumn("best", most).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _merkle_sql(fan_out: int = 16, levels: int = 6) -> str:
    """Both trees level by level, for up to fan_out ** levels leaves of a group."""
    def field(c: str) -> str:
        return f"coalesce(concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', CAST({c} AS VARCHAR)), '-')"

    def leaf(text: str) -> str:
        return "sha256(concat(" + ", ".join(field(c) for c in ("d.doc_id", "source", "lang", "n_chars", text)) + "))"

    def tree(name: str, leaves: str) -> str:
        """Ctes {name}0 .. (g, c, i, digest; c nodes of group g), {name}top (g, digest) and {name}k1 .. (g, i, kids)."""
        out = [f"{name}0 AS ({leaves})"]
        for k in range(1, levels + 1):
            out.append(f"{name}k{k} AS (SELECT g, c, i // {fan_out} AS i, list(digest ORDER BY i) AS kids FROM {name}{k - 1} WHERE c > 1 GROUP BY g, c, i // {fan_out})")
            out.append(f"{name}{k} AS (SELECT g, (c + {fan_out - 1}) // {fan_out} AS c, i, sha256(array_to_string(kids, '')) AS digest FROM {name}k{k})")
        out.append(f"{name}top AS (" + " UNION ALL ".join(f"SELECT g, digest FROM {name}{k} WHERE c = 1" for k in range(levels + 1)) + ")")
        return ",\n".join(out)

    def climb(name: str, start: str) -> tuple[str, str]:
        """Ctes that fold `cur` and gather `proof` up a tree, from rows (doc_id, g, c, i, cur, proof)."""
        out, now = [], start
        for k in range(1, levels + 1):
            before, after = f"array_to_string(kids[1:p.i % {fan_out}], '')", f"array_to_string(kids[p.i % {fan_out} + 2:], '')"
            out.append(
                f"{name}up{k} AS (SELECT doc_id, p.g, (p.c + {fan_out - 1}) // {fan_out} AS c, p.i // {fan_out} AS i, CASE WHEN kids IS NULL THEN cur ELSE sha256(concat({before}, cur, {after})) END AS cur,"
                f" CASE WHEN kids IS NULL THEN proof ELSE concat(proof, {before}, {after}) END AS proof FROM {now} p LEFT JOIN {name}k{k} k ON k.g = p.g AND k.i = p.i // {fan_out} AND p.c > 1)"
            )
            now = f"{name}up{k}"
        return ",\n".join(out), now

    low, lows = climb("s", "mine")
    high, highs = climb("r", "middle")
    lower_text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH {_CRC},
docs AS (SELECT d.doc_id, source, {leaf('text')} AS leaf, CASE WHEN h % 5 = 0 THEN {leaf(lower_text)} ELSE {leaf('text')} END AS held FROM documents d JOIN crc ON crc.doc_id = d.doc_id),
sources AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM docs)),
ranked AS (SELECT doc_id, leaf, held, g, count(*) OVER (PARTITION BY g) AS c, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
    FROM docs JOIN sources ON docs.source IS NOT DISTINCT FROM sources.source),
{tree('s', 'SELECT g, c, i, leaf AS digest FROM ranked')},
{tree('r', 'SELECT 0 AS g, count(*) OVER () AS c, g AS i, digest FROM stop')},
mine AS (SELECT doc_id, g, c, i, held AS cur, '' AS proof FROM ranked),
{low},
middle AS (SELECT doc_id, 0 AS g, (SELECT count(*) FROM sources) AS c, g AS i, cur, proof FROM {lows}),
{high}
SELECT l.doc_id, leaf, t.digest AS subroot, root.digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root.digest AS verified
FROM ranked l JOIN {highs} u ON u.doc_id = l.doc_id JOIN stop t ON t.g = l.g, rtop root"""


@query("op13_interval_manifest", _merkle_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import merkle
    from corpusloom.llm.sqlwords import lower_ascii

    forged = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower_ascii(F.col("text")))
    return merkle.manifest(table(spark, sf_dir, "documents"), forged)
