"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its whole text, its blob. The ledger is a folder of Parquet
files, one row for each scan of a blob: which rules looked at it, each with its version, and the spans they found. A scan asks
the ledger first: a blob that all wanted rule versions have seen is not looked at again, and one that lacks some is
looked at by these alone. Equal texts are scanned once, whoever has them. The findings of a blob are then joined back to all paths.

A ledger row says all about its own scan, so a run that fails half-way leaves a right ledger, and rows written twice change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.store import written
from corpusloom.operators.skew import small

# A scan with up to this many blobs to look at sends their addresses to the texts instead of moving all texts.
BROADCAST_BLOBS = 100_000

LEDGER = "blob binary, rules array<string>, spans array<struct<rule:string,start:bigint,end:bigint>>"


class Rule(NamedTuple):
    """Matches are leftmost and do not overlap; one whose `group` has fewer than `least` characters is no finding."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def tag(self) -> str:
        return f"{self.name}@{self.version}"


# The first three rules must find the same spans as their definitions.
BASE = (
    Rule("assign", 1, r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
RULES = BASE + (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("service_token", 1, r"gh[oprsu]_[A-Za-z0-9]{36,}"),
)


def address(text: Column) -> Column:
    """The blob of a text: the 32 bytes of its SHA-256; NULL is the empty text."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none where nothing has been scanned yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _look(rules: Sequence[Rule]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    known = {r.tag: (r.pattern, r.group, r.least) for r in rules}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # ASCII: a letter of a pattern stands for itself and its other case only.
        ready = {t: (re.compile(p, re.ASCII), g, n) for t, (p, g, n) in known.items()}
        for b in batches:
            spans = []
            for text, todo in zip(b["text"], b["todo"], strict=True):
                found = []
                for tag in todo:
                    pattern, group, least = ready[tag]
                    found += [
                        {"rule": tag, "start": m.start(), "end": m.end()}
                        for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least
                    ]
                spans.append(found)
            yield pd.DataFrame({"blob": b["blob"], "rules": b["todo"], "spans": pd.Series(spans, dtype=object)})

    return run


def update(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, text_col: str = "text") -> None:
    """Scan the blobs of `versions` that lack a rule version, each once and by the lacking ones, and append them to `ledger`."""
    spark = versions.sparkSession
    tags = F.array(*[F.lit(r.tag) for r in rules])
    texts = versions.select(address(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Copies of a blob meet before the shuffle: a third of all rows may share one.
    one = lambda rows: rows.groupBy("blob").agg(F.first("text").alias("text"))
    seen = read_ledger(spark, ledger)
    if seen.isEmpty():
        todo = one(texts).withColumn("todo", tags)
    else:
        done = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("done"))
        lack = texts.select("blob").distinct().join(done, "blob", "left")
        lack = lack.withColumn("todo", F.array_except(tags, F.coalesce("done", F.array().cast("array<string>"))))
        lack = written(lack.where(F.size("todo") > 0).select("blob", "todo"), "unseen")
        few = small(lack, BROADCAST_BLOBS)
        # Few of them: only their texts move. Many: texts move once, by blob, and meet the addresses there.
        todo = one(texts.join(few.select("blob"), "blob", "left_semi") if few is not lack else texts).join(few, "blob")
    todo.mapInPandas(_look(rules), LEDGER).write.mode("append").parquet(ledger)


def findings(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, spans): every blob in which one of `rules` found something, with its spans by start, then rule as listed."""
    tags = F.array(*[F.lit(r.tag) for r in rules])
    names = F.array(*[F.lit(r.name) for r in rules])
    s = ledger.where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s"))
    place = F.array_position(tags, F.col("s.rule")).cast("int")
    s = s.where(place > 0).select("blob", F.struct(F.col("s.start").alias("start"), place.alias("place"), F.col("s.end").alias("end")).alias("s"))
    # A blob's findings are bounded by its own text; the set drops spans of a blob that two runs scanned.
    s = s.groupBy("blob").agg(F.sort_array(F.collect_set("s")).alias("spans"))
    named = lambda x: F.struct(F.get(names, x["place"] - 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    return s.select("blob", F.transform("spans", named).alias("spans"))


def scan(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, spans): one row per row of `versions`, spans as (kind, start, end) in code points, end exclusive.

    `ledger` is a folder on shared storage; it is made by the first scan and grows with every further one. Texts are taken whole.
    A NULL text is the empty text and has no spans; a row with a NULL id, a repeated id or a repeated row is a row of its own.
    Spans of one rule never overlap, spans of different rules may. Other columns are ignored, whatever their names.
    An empty table gives an empty result.
    """
    update(versions, ledger, rules, text_col)
    paths = versions.select(F.col(id_col).alias("doc_id"), address(F.col(text_col)).alias("blob"))
    found = findings(read_ledger(versions.sparkSession, ledger), rules)
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", empty).alias("spans"))
