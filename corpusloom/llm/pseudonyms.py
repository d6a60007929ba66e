"""Personal data replaced by format-preserving pseudonyms.

Found and validated: payment cards (Luhn), IBANs (mod 97), social security numbers, phone numbers, IPv4 addresses,
calendar dates, e-mail addresses, access keys, long hexadecimal secrets and password assignments.
A value's symbols are split into two halves and go through ROUNDS of a Feistel network: in every round each symbol of
one half is moved within its own alphabet (digits stay digits, small letters small letters, ...) by a keyed SHA-256 of
the other half. So every value maps to another of the same format, different values of one kind stay different, and
equal values get the same pseudonym in every document. Cards and IBANs get their check digits anew; dates are permuted
as days of a 400-year calendar cycle (146,097 = 189 * 773 days) and written in their own form.

All of it is DataFrame expressions, one projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.sqlwords import let

ROUNDS = 8
_DAY0 = -62091  # 1800-01-01 as days since 1970-01-01

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Kind, pattern of the whole value, what must not stand before and after it. Earlier kinds win.
KINDS: list[tuple[str, str, str, str]] = [
    ("email", "[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{2,}", "[A-Za-z0-9._%+-]", ""),
    ("password", "(?i:password|passwd|pwd|secret|token|api_?key)\\s?[=:]\\s?[^\\s\"',;]{6,}", "[A-Za-z0-9]", ""),
    ("access_key", "(?:AKIA|ASIA)[A-Z0-9]{16}", "[A-Za-z0-9]", "[A-Za-z0-9]"),
    ("hex_secret", "(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})", "[A-Za-z0-9]", "[A-Za-z0-9]"),
    ("iban", "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "[A-Za-z0-9]", "[A-Za-z0-9]"),
    ("ipv4", f"{_OCTET}(?:\\.{_OCTET}){{3}}", "[0-9.]|[A-Za-z]", "[0-9A-Za-z]|\\.[0-9]"),
    ("date", "[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}", "[0-9A-Za-z/.-]", "[0-9A-Za-z]|[/.-][0-9]"),
    ("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9A-Za-z-]", "[0-9A-Za-z]|-[0-9]"),
    ("phone", "\\+[0-9]{1,3}[ .-]?(?:\\([0-9]{1,4}\\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,5}|\\([0-9]{3}\\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}",
     "[0-9A-Za-z.+-]", "[0-9A-Za-z]|-[0-9]"),
    ("card", "[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", "[0-9A-Za-z.-]", "[0-9A-Za-z]|[.-][0-9]"),
]
_ANY = "|".join(("" if not b else f"(?<!{b})") + f"(?:{p})" + ("" if not a else f"(?!{a})") for _, p, b, a in KINDS)
# Alphabets a symbol can stay within, by what it is in its own format.
_ALPHABETS = {"d": "0123456789", "n": "123456789", "N": "23456789", "x": "0123456789abcdef", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _draw(key: str, kind: str, rnd: Column, at: Column, other: Column) -> Column:
    """A keyed pseudo-random number of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), rnd, at, other), 256), 1, 15), 16, 10).cast("bigint")


def feistel(symbols: Column, sizes: Column, key: str, kind: str) -> Column:
    """Permute an array of numbers below `sizes` (same length): an array of the same ranges.

    The network alternates between the halves. With a single symbol its second half is empty, and the symbol is
    shifted by a keyed constant.
    """
    half = F.ceil(F.size(symbols) / 2).cast("int")

    def part(a: Column, first: bool) -> Column:
        return F.slice(a, F.lit(1), half) if first else F.slice(a, half + 1, F.size(a) - half)

    def moved(mine: Column, other: Column, bound: Column, k: Column) -> Column:
        told = F.array_join(F.transform(other, lambda x: x.cast("string")), ",")
        return F.transform(mine, lambda x, i: F.pmod(x + F.pmod(_draw(key, kind, k, i, told), F.get(bound, i)), F.get(bound, i)))

    def step(s: Column, k: Column) -> Column:
        l, r = s["l"], s["r"]
        return F.when(k % 2 == 0, F.struct(moved(l, r, part(sizes, True), k).alias("l"), r.alias("r"))).otherwise(
            F.struct(l.alias("l"), moved(r, l, part(sizes, False), k).alias("r"))
        )

    start = F.struct(part(symbols, True).alias("l"), part(symbols, False).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def _chars(s: Column) -> Column:
    """Array of single characters ('' for an empty string is no character)."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def _by_alphabet(s: Column, classes, key: str, kind: str) -> Column:
    """Permute the characters of `s` whose class (from `classes(chars)`, one name each) is an alphabet; others stay."""
    alphabet = F.create_map(*[F.lit(x) for kv in _ALPHABETS.items() for x in kv])

    def run(z: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(z) - 1), lambda i: F.map_contains_key(alphabet, F.get(z, i)["k"]))
        letters = lambda i: F.element_at(alphabet, F.get(z, i)["k"])

        def put(p: Column) -> Column:
            new = feistel(
                F.transform(p, lambda i: (F.position(F.get(z, i)["c"], letters(i)) - 1).cast("bigint")),
                F.transform(p, lambda i: F.length(letters(i)).cast("bigint")), key, kind,
            )
            moved = let(new, lambda m: F.transform(z, lambda e, i: F.when(
                F.array_contains(p, i), F.substr(letters(i), (F.get(m, (F.array_position(p, i) - 1).cast("int")) + 1).cast("int"), F.lit(1))
            ).otherwise(e["c"])))
            return F.array_join(moved, "")

        return F.when(F.size(z) > 0, let(at, put)).otherwise(F.lit(""))

    both = let(_chars(s), lambda c: F.zip_with(c, classes(c), lambda a, b: F.struct(a.alias("c"), b.alias("k"))))
    return let(both, run)


def _class(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), "d").when(c.rlike("[a-z]"), "a").when(c.rlike("[A-Z]"), "A").otherwise("")


def _plain(c: Column) -> Column:
    return F.transform(c, _class)


def _phone_classes(c: Column) -> Column:
    """A first digit of a group stays in 2-9 or as it is."""

    def one(x: Column, i: Column) -> Column:
        first = F.when(i == 0, F.lit(True)).otherwise(~F.get(c, i - 1).rlike("[0-9]"))
        return F.when(~x.rlike("[0-9]"), "").when(~first, "d").when(x >= "2", "N").otherwise("")

    return F.transform(c, one)


def luhn_sum(digits: Column, skip: int) -> Column:
    """Luhn sum of a digit string; `skip` is 1 when the check digit is missing."""
    numbers = F.transform(F.reverse(_chars(digits)), lambda c: c.cast("int"))
    twice = F.transform(numbers, lambda d, i: F.when((i + skip) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(twice, F.lit(0), lambda a, d: a + d)


def _mod97(s: Column) -> Column:
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(s), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _iban_ok(v: Column) -> Column:
    flat = F.translate(v, " ", "")
    return F.length(flat).between(15, 34) & (_mod97(F.concat(F.substr(flat, F.lit(5)), F.substring(flat, 1, 4))) == 1)


def _refill(shape: Column, symbols: Column) -> Column:
    """Write `symbols` one after another over the letters and digits of `shape`, separators stay."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    put = lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["s"], F.substr(symbols, a["i"], F.lit(1))).alias("s"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i")))
    return F.aggregate(_chars(shape), start, put, lambda a: a["s"])


def _date_of(v: Column) -> tuple[Column, Column]:
    """(pattern the value is written in, its day number); NULL when it is no calendar date of 1400 to 2599."""
    patterns = ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy"]
    shape = F.when(F.substring(v, 5, 1) == "-", F.array(F.lit(patterns[0]))).when(F.substring(v, 3, 1) == "/", F.array(F.lit(patterns[1]), F.lit(patterns[2]))).otherwise(F.array(F.lit(patterns[3])))
    day = lambda p: F.try_to_timestamp(v, p)
    good = F.filter(shape, lambda p: day(p).isNotNull())
    pattern = F.get(good, F.lit(0))
    number = F.unix_date(day(pattern).cast("date"))
    return pattern, F.when(number.between(_DAY0 - 146097, _DAY0 + 2 * 146097 - 1), number)


def _replacement(kind: str, v: Column, key: str) -> Column:
    """The pseudonym of one value of a kind; NULL when the value does not pass its validation."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "email":
        keep = F.length(F.substring_index(v, ".", -1)) + 1
        head = F.substr(v, F.lit(1), F.length(v) - keep)
        return F.concat(_by_alphabet(head, _plain, key, kind), F.substr(v, F.length(head) + 1))
    if kind == "password":
        head = F.regexp_extract(v, "^[^=:]*[=:]\\s?", 0)
        return F.concat(head, _by_alphabet(F.substr(v, F.length(head) + 1), _plain, key, kind))
    if kind == "access_key":
        return F.concat(F.substring(v, 1, 4), _by_alphabet(F.substr(v, F.lit(5)), _plain, key, kind))
    if kind == "hex_secret":
        return _by_alphabet(v, lambda c: F.transform(c, lambda x: F.lit("x")), key, kind)
    if kind == "iban":
        flat = F.translate(v, " ", "")
        body = _by_alphabet(F.substr(flat, F.lit(5)), _plain, key, kind)
        check = lambda b: F.lpad((98 - _mod97(F.concat(b, F.substring(flat, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        return F.when(_iban_ok(v), _refill(v, let(body, lambda b: F.concat(F.substring(flat, 1, 2), check(b), b))))
    if kind == "ipv4":
        octets = F.transform(F.split(v, "[.]"), lambda x: x.cast("bigint"))

        def moved(o: Column) -> Column:
            usual = F.get(o, 0).between(1, 223)
            first = F.when(usual, F.get(o, 0) - 1).when(F.get(o, 0) == 0, 32).otherwise(F.get(o, 0) - 224).cast("bigint")
            rest = F.lit(256).cast("bigint")
            new = feistel(F.concat(F.array(first), F.slice(o, 2, 3)), F.array(F.when(usual, 223).otherwise(33).cast("bigint"), rest, rest, rest), key, kind)
            back = lambda x: F.when(usual, x + 1).when(x == 32, 0).otherwise(x + 224)
            return let(new, lambda n: F.array_join(F.transform(n, lambda x, i: F.when(i == 0, back(x)).otherwise(x).cast("string")), "."))

        return let(octets, moved)
    if kind == "date":
        pattern, number = _date_of(v)

        def moved_day(z: Column) -> Column:
            inside = F.pmod(z["n"] - _DAY0, F.lit(146097))
            new = feistel(F.array(F.floor(inside / 773), F.pmod(inside, F.lit(773)).cast("bigint")), F.array(F.lit(189).cast("bigint"), F.lit(773).cast("bigint")), key, kind)
            day = let(new, lambda m: z["n"] - inside + F.get(m, 0) * 773 + F.get(m, 1))
            return F.when(z["n"].isNotNull(), F.call_function("date_format", F.date_from_unix_date(day.cast("int")), z["p"]))

        return let(F.struct(pattern.alias("p"), number.cast("bigint").alias("n")), moved_day)
    if kind == "ssn":
        area, group, serial = (F.substring(digits, a, n).cast("bigint") for a, n in ((1, 3), (4, 2), (6, 4)))
        ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        sizes = F.array(*[F.lit(n).cast("bigint") for n in (898, 99, 9999)])
        new = feistel(F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1), sizes, key, kind)
        text = let(new, lambda m: F.format_string("%03d-%02d-%04d", F.when(F.get(m, 0) >= 665, F.get(m, 0) + 2).otherwise(F.get(m, 0) + 1), F.get(m, 1) + 1, F.get(m, 2) + 1))
        return F.when(ok, text)
    if kind == "phone":
        head = F.regexp_extract(v, "^(?:\\+[0-9]{1,3}(?![0-9])|\\+[0-9])?", 0)
        return F.concat(head, _by_alphabet(F.substr(v, F.length(head) + 1), _phone_classes, key, kind))
    body = _by_alphabet(F.substr(digits, F.lit(2), F.length(digits) - 2), _plain, key, "card")
    with_check = let(F.concat(F.substring(digits, 1, 1), body), lambda b: F.concat(b, F.pmod(-luhn_sum(b, 1), F.lit(10)).cast("string")))
    return F.when(luhn_sum(digits, 0) % 10 == 0, _refill(v, with_check))


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", out: str = "text", counts: str | None = "n_pii", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """`df` with `out` = `text_col` with every value found replaced, and `counts` = how many were replaced.

    `key` is the secret; the same key gives the same pseudonyms. `kinds` restricts the kinds (names in KINDS).
    A NULL text stays NULL with a count of 0, an empty one stays empty. Values that do not pass their validation are
    left as they are. Rows are neither dropped nor joined, so repeated rows stay and other columns pass through;
    a column named like `out` or `counts` is replaced.
    """
    used = [k for k in KINDS if kinds is None or k[0] in kinds]
    any_of = "|".join(("" if not b else f"(?<!{b})") + f"(?:{p})" + ("" if not a else f"(?!{a})") for _, p, b, a in used)
    text = F.col(text_col)

    def one(v: Column) -> Column:
        # Every branch is computed only for values of its kind.
        chosen = F.lit(None).cast("string")
        for name, pattern, _, _ in reversed(used):
            chosen = F.when(v.rlike(f"^(?:{pattern})$"), _replacement(name, v, key)).otherwise(chosen)
        return chosen

    def joined(z: Column) -> Column:
        both = F.zip_with(z["pieces"], z["new"], lambda p, m: F.concat(p, F.coalesce(m["to"], m["was"], F.lit(""))))
        return F.struct(F.array_join(both, "").alias("t"), F.size(F.filter(z["new"], lambda m: m["to"].isNotNull())).alias("n"))

    found = F.transform(F.regexp_extract_all(text, F.lit(any_of), F.lit(0)), lambda v: F.struct(v.alias("was"), one(v).alias("to")))
    done = let(F.struct(F.split(text, any_of, -1).alias("pieces"), found.alias("new")), joined)
    # Whatever is found holds a digit, @, = or :, so most texts skip the search.
    done = F.when(text.rlike("[0-9@=:]"), done).otherwise(F.struct(text.alias("t"), F.lit(0).alias("n")))
    made = df.withColumn("_pseudonym_of", done)
    cols = {out: F.col("_pseudonym_of.t"), **({counts: F.coalesce("_pseudonym_of.n", F.lit(0))} if counts else {})}
    order = [c for c in df.columns if c != counts or not counts]
    return made.select(*[cols[c].alias(c) if c in cols else F.col(f"`{c}`") for c in order], *[v.alias(k) for k, v in cols.items() if k not in order])
