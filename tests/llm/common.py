"""Small tables for the operator tests, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re

EXTRA = "digest n key id grp component_id kept a b chain h hs p draw block item_id size target vec_id _t i x q s w wanted".split()


def words(text: str | None) -> list[str]:
    table = {c: c + 32 for c in range(65, 91)}
    return [w.translate(table) for w in re.findall("[^\x20\x09-\x0d]+", text or "")]


def shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 7))) for _ in range(n))


def odd_documents(spark):
    """NULLs in every column, empty, blank and long texts, equal rows, an id with two texts, clashing column names."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 80), "en", "s1"), (1, prose(2, 80), "en", "s1"), (1, prose(3, 60), "fr", "s2"), (2, None, "en", "s1"), (3, "", "en", None),
        (4, " \n\t ", None, "s1"), (5, "Word", "de", "s3"), (6, prose(2, 80) + " more", "en", "s1"), (None, prose(2, 80), "en", "s2"),
        (None, None, None, None), (7, long, "en", "s1"), (8, long, None, "s2"), (9, "12345 !!! 678", "es", "s2"), (10, "é " * 90, "fr", "s9"),
    ]
    df = spark.createDataFrame([(*r, *["clash"] * len(EXTRA)) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in EXTRA))
    return df, rows


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
