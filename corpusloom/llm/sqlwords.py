"""Words and shingles as DataFrame expressions, the same words that `words` finds in numpy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """`body` over `value`, with `value` computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """Runs of characters other than space and \\x09-\\x0D, A-Z lower-cased; none for NULL."""
    cut = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "[ \\t-\\r]+")
    return F.array_remove(cut, "")


def _starts(n: Column, width: int) -> Column:
    """Places of the first words of all shingles; a shorter text has one shingle, an empty one none."""
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def shingles(w: Column, width: int) -> Column:
    """All `width`-word shingles as strings, repeats kept."""
    return let(w, lambda x: F.transform(_starts(F.size(x), width), lambda i: F.array_join(F.slice(x, i, width), " ")))


def shingle_hashes(w: Column, width: int) -> Column:
    """64-bit hashes of all shingles, repeats kept: every word is hashed once, then its neighbours are combined."""
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return let(
        hashed,
        lambda h: F.transform(_starts(F.size(h), width), lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(width)])),
    )
