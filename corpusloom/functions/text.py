"""Column -> Column text functions. All of them stay in the JVM."""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import fixed

# Unicode white space plus the four separator controls, which `str.split` also cuts at.
WS = r"(?U)[\s\x1c-\x1f]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: Column | str) -> Column:
    """Whitespace words. At most the first and last piece of a split are empty."""
    return F.array_remove(F.split(_c(c), WS + "+"), "")


def token_set(c: Column | str) -> Column:
    return F.array_distinct(tokens(c))


def word_count(c: Column | str) -> Column:
    return F.coalesce(F.size(tokens(c)), F.lit(0))


def est_tokens(c: Column | str) -> Column:
    return word_count(c) * F.lit(fixed.TOKENS_PER_WORD)


def truncate_words(c: Column | str, max_tokens: int) -> Column:
    """Over the limit by the token estimate: keep `max_tokens` *words*, single-spaced."""
    t = tokens(c)
    cut = F.array_join(F.slice(t, 1, max_tokens), " ")
    return F.when(F.size(t) * F.lit(fixed.TOKENS_PER_WORD) > max_tokens, cut).otherwise(_c(c))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), f"^{WS}+|{WS}+$", "")


def collapse_newlines(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "\n+", "\n")


def hashes_to_space(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "#+", " ")


def newlines_to_space(c: Column | str) -> Column:
    return F.replace(_c(c), F.lit("\n"), F.lit(" "))


_RULES = {
    "newlines": collapse_newlines,
    "hashes": hashes_to_space,
    "strip": strip,
    "lower": lambda c: F.lower(_c(c)),
    "one_line": newlines_to_space,
}


def clean_text(c: Column | str, rules: Sequence[str]) -> Column:
    """Apply named rules in the order given: newlines, hashes, strip, lower, one_line."""
    out = _c(c)
    for r in rules:
        out = _RULES[r](out)
    return out


def _named_entities() -> str:
    """Entity names with their characters as JSON, the everyday ones first."""
    first = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "nbsp": "\u00a0", "apos": "'"}
    return json.dumps({**first, **{n: chr(c) for n, c in sorted(name2codepoint.items()) if n not in first}})


def unescape(c: Column | str) -> Column:
    """Decode named, decimal and hexadecimal character references, each once: the text is cut
    before every `&`, and a piece that opens with a known reference has it replaced."""
    col = _c(c)
    names = F.from_json(F.lit(_named_entities()), "map<string,string>")

    def piece(p: Column) -> Column:
        ref = F.regexp_extract(p, r"^&(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);", 1)
        hexa = F.when(
            F.lower(F.substring(ref, 1, 2)) == "#x", F.substring(ref, 3, 8)
        ).when(F.substring(ref, 1, 1) == "#", F.hex(F.substring(ref, 2, 8).cast("bigint")))
        point = F.conv(hexa, 16, 10).cast("bigint")
        real = ((point > 0) & (point < 0xD800)) | ((point > 0xDFFF) & (point <= 0x10FFFF))
        numeric = F.when(real, F.decode(F.unhex(F.lpad(hexa, 8, "0")), "UTF-32"))
        got = F.coalesce(numeric, F.try_element_at(names, ref))
        return F.coalesce(F.concat(got, F.substring(p, F.length(ref) + 3, F.length(p))), p)

    pieces = F.transform(F.split(col, "(?=&)"), lambda p: F.when(F.startswith(p, F.lit("&")), piece(p)).otherwise(p))
    return F.when(F.contains(col, F.lit("&")), F.array_join(pieces, "")).otherwise(col)


def html_to_text(c: Column | str) -> Column:
    """Text of an HTML fragment: comments, scripts and styles out, tags out, entities decoded."""
    s = F.regexp_replace(_c(c), r"(?s)<!--.*?-->", "")
    s = F.regexp_replace(s, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    return unescape(F.regexp_replace(s, r"</?[A-Za-z!][^>]*>", ""))


def split_tags(c: Column | str) -> Column:
    """`|a|b|` and the older `<a><b>` to an array of names."""
    s = F.regexp_replace(F.replace(_c(c), F.lit("><"), F.lit("|")), "^[|<]+|[|>]+$", "")
    return F.split(s, r"\|")


def preference_score(up: Column | str, accepted: Column | str) -> Column:
    return F.log2(_c(up) + 1) + F.when(_c(accepted), F.lit(1.0)).otherwise(F.lit(-1.0))


def numbered_list(arr: Column | str, first: Column | int = 1) -> Column:
    """Lines "1. ..", "2. ..", numbered from `first`: the further pieces of a long list go on counting."""
    return F.array_join(
        F.transform(_c(arr), lambda x, i: F.concat((i + first).cast("string"), F.lit(". "), x)), "\n"
    )


def episode_list(arr: Column | str, episode: str = "episode_number", content: str = "content") -> Column:
    return F.array_join(
        F.transform(
            _c(arr),
            lambda x: F.concat(F.lit("Episode "), x[episode].cast("string"), F.lit(" - "), x[content]),
        ),
        "\n",
    )


def is_multiple_choice(c: Column | str) -> Column:
    """An "A." to "D." anywhere; a sentence that ends in such a letter counts too."""
    return F.coalesce(_c(c).rlike(r"[ABCD]\."), F.lit(False))


def doc_id(title: Column | str, heading: Column | str) -> Column:
    return F.md5(F.concat(_c(title), _c(heading)))


def last_segment(c: Column | str) -> Column:
    return F.element_at(F.split(_c(c), "/"), -1)


def unit_hash(*parts: Column | str) -> Column:
    """A whole number in [0, 2^32) from md5: the same in every engine, fixed by its inputs."""
    joined = F.concat_ws("\u0001", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")


def choose(choices: Sequence[str], *key: Column | str) -> Column:
    """One of `choices`, fixed by the key columns."""
    arr = F.array(*[F.lit(x) for x in choices])
    return F.element_at(arr, (F.pmod(unit_hash(*key), F.lit(len(choices))) + 1).cast("int"))


def render(layout: str, **slots: Column | str) -> Column:
    """Fill `{name}` slots; a missing value renders as nothing."""
    parts: list[Column] = []
    rest = layout
    while rest:
        at = rest.find("{")
        if at < 0:
            parts.append(F.lit(rest))
            break
        end = rest.index("}", at)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(_c(slots[rest[at + 1:end]]).cast("string"), F.lit("")))
        rest = rest[end + 1:]
    return F.concat(*parts)


def to_query(instruction: Column | str, input_: Column | str) -> Column:
    return F.concat(_c(instruction), F.lit(" "), _c(input_))
