"""Format-preserving pseudonyms by keyed Feistel permutations.

Validated numbers and dates are permuted within their own format: a card
number becomes another valid card number of the same length and spacing, a
date another calendar date in the same notation. The permutation of a kind is
keyed and one to one, so equal values stay linked across documents, different
values stay different, and who has the key can turn the pseudonyms back
(``inverse=True``).

A value is two coordinates, (left, right), in ranges of sizes (a, b). A round
adds a keyed SHA-256 of one coordinate to the other, modulo its size; the
rounds alternate. No value ever leaves its format, so no cycle walking is
needed. Kinds:

=======  =========================================  =======================
kind     found and validated                        permuted
=======  =========================================  =======================
card     13 to 19 digits, first 2 to 6, four        all digits but the first;
         groups of four, or 4-6-5; Luhn sum         check digit anew
phone    (AAA) EEE-NNNN, AAA-EEE-NNNN and with      area, exchange and line
         blanks or dots, +1 or 1 before them or     among those from 200, or
         not, any digits                            among the others
ssn      AAA-GG-SSSS, no reserved part              the valid range
iban     two letters, two check digits, 11 to 30    digits; check digits anew
         more, or in groups of four (letters in
         the first at most); mod 97
ip       four octets up to 255, no leading zero     all 32 bits
date     YYYY-MM-DD, DD.MM.YYYY, MM/DD/YYYY of      the days 1900 to 2099
         1900 to 2099, a day of the calendar
email    local part of ASCII letters, digits and    letters as letters, digits
         ``._%+-`` at a domain name                 as digits, local part only
=======  =========================================  =======================

A value may stand after ``.``, ``-`` or ``_`` and before ``_``, and a date before
a time (``2020-01-31T10:00``), but not inside a longer number or word.

The key is no part of the plan: it is a one-row table that a scalar subquery
reads when the query runs, so neither ``explain`` nor an event log shows it. Who
gives none gets a random key for this call: values stay linked inside the
result, and nobody can turn them back.

All work is SQL functions: the matches and the text between them are split
once, each match is rewritten, and both are put together again. Nothing is
shuffled. Text without digits is passed through.

Edge cases: null texts stay null; a value that fails its validation stays as
it is; equal matches in one text are each rewritten; the same digits under two
kinds are unrelated; very long texts are rewritten whole; repeated rows give
equal results; other columns are kept and cannot clash; an empty table gives
an empty result.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The session setting with the key of a run; Spark redacts settings of such names in its logs.
KEY_SETTING = "docsift.pii.secret"
ROUNDS = 8

OCTET = r"(?:0|[1-9]\d{0,2})"
#: What each kind looks like; the order decides where two could begin at one place.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "iban": r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}| [A-Z0-9]{4}(?: \d{4}){2,6}(?: \d{1,3})?)",
    "date": r"(?:19|20)\d\d-\d\d-\d\d|\d\d\.\d\d\.(?:19|20)\d\d|\d\d/\d\d/(?:19|20)\d\d",
    "ip": rf"{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}",
    "phone": r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "card": r"[2-6]\d{3}(?:[ -]\d{4}){3}|[2-6]\d{3}[ -]\d{6}[ -]\d{5}|[2-6]\d{12,18}",
}
#: Not inside a longer number or word; a date may have a time behind it.
BEFORE, AFTER = r"(?<![\p{L}\p{N}+]|\p{N}[.-])", r"(?:(?=T\d\d:)|(?![\p{L}\p{N}]|[.-]\p{N}))"
PATTERN = BEFORE + "(?:" + "|".join(PATTERNS.values()) + ")" + AFTER
SYMBOLS_PER_STEP = 22  # two halves of 11 symbols: 26 ** 11 fits a long
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days are the years 1900 to 2099


def _long(c: Column) -> Column:
    return c.cast("bigint")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once for all its uses."""
    return F.transform(F.array(value), use)[0]


def _two(a: Column | int, b: Column | int) -> Column:
    return F.array(*[_long(x if isinstance(x, Column) else F.lit(x)) for x in (a, b)])


def _power(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n.cast("int"))).cast("bigint")


def _filled(value: Column, width: Column | int) -> Column:
    text = value.cast("string")
    width = width if isinstance(width, Column) else F.lit(width)
    return F.concat(F.repeat(F.lit("0"), (width - F.length(text)).cast("int")), text)


def feistel(pair: Column, sizes: Column, key: Column, kind: str, inverse: bool = False) -> Column:
    """Permutes (left, right) within the ranges (a, b), both array<bigint>.
    The rounds are a fold over their numbers; even rounds change the left.
    The sizes, and what all rounds hash alike, are evaluated once a value."""

    def step(same: Column, p: Column, n: Column) -> Column:
        def moved(value: Column, other: Column, size: Column) -> Column:
            text = F.concat_ws("|", same["text"], n.cast("string"), other.cast("string"))
            shift = F.pmod(_long(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10)), size)
            return F.pmod(value - shift if inverse else value + shift, size)

        left = F.array(moved(p[0], p[1], same["sizes"][0]), p[1])
        return F.when(n % 2 == 0, left).otherwise(F.array(p[0], moved(p[1], p[0], same["sizes"][1])))

    order = list(range(ROUNDS))
    rounds = F.array(*[F.lit(n) for n in (reversed(order) if inverse else order)])
    same = _let(sizes, lambda s: F.struct(s.alias("sizes"), F.concat_ws("|", key, F.lit(kind), F.array_join(s, "x")).alias("text")))
    return _let(same, lambda c: F.aggregate(rounds, pair, lambda p, n: step(c, p, n)))


def _digits_permuted(digits: Column, key: Column, kind: str, inverse: bool) -> Column:
    """A string of 2 to 30 digits, permuted as two halves."""

    def permuted(digits: Column, n: Column, a: Column) -> Column:
        pair = _two(F.substr(digits, F.lit(1), a), F.substr(digits, a + 1, n))
        out = feistel(pair, _two(_power(a), _power(n - a)), key, kind, inverse)
        return _let(out, lambda p: F.concat(_filled(p[0], a), _filled(p[1], n - a)))

    return _let(digits, lambda d: _let(F.length(d), lambda n: _let(F.floor(n / 2), lambda a: permuted(d, n, a))))


def _refill(shape: Column, digits: Column) -> Column:
    """The digits, in order, in the places of the digits of ``shape``."""

    def put(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        out = F.concat(acc["out"], F.when(is_digit, F.substr(digits, acc["used"] + 1, F.lit(1))).otherwise(c))
        return F.struct(out.alias("out"), (acc["used"] + is_digit.cast("int")).alias("used"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("used")), put, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    """The Luhn sum, modulo 10, with the last digit counted once."""
    value = lambda c, i: _let(c.cast("int") * (1 + i % 2), lambda v: v - F.when(v > 9, 9).otherwise(0))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x) % 10


def _mod97(text: Column) -> Column:
    """Remainder of an account text whose letters stand for 10 to 35."""

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _card(m: Column, key: Column, inverse: bool) -> tuple[Column, Column]:
    digits = F.regexp_replace(m, "[^0-9]", "")

    def out(d: Column) -> Column:
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), _digits_permuted(F.substr(d, F.lit(2), F.length(d) - 2), key, "card", inverse))
        check = _let(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))
        return _let(check, lambda x: _refill(m, x))

    return _luhn(digits) == 0, _let(digits, out)


def _phone(m: Column, key: Column, inverse: bool) -> tuple[Column, Column]:

    def new(digits: Column) -> Column:
        country = F.substring(digits, 1, F.length(digits) - 10)  # 1, or nothing
        area, exchange, line = (_long(F.substring(digits, at, n)) for at, n in ((-10, 3), (-7, 3), (-4, 4)))
        # Area and exchange from 200 are 640,000 pairs; the other 360,000 are a range of their own.
        usual = (area >= 200) & (exchange >= 200)
        other = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
        left = F.when(usual, (area - 200) * 800 + exchange - 200).otherwise(other)
        out = feistel(_two(left, line), _two(F.when(usual, 640_000).otherwise(360_000), 10_000), key, "phone", inverse)

        def pair(x: Column) -> Column:
            low = F.when(x < 200_000, x).otherwise((200 + F.floor((x - 200_000) / 200)) * 1000 + (x - 200_000) % 200)
            return F.when(usual, (200 + F.floor(x / 800)) * 1000 + 200 + x % 800).otherwise(low)

        return _let(out, lambda p: F.concat(country, F.lpad(pair(p[0]).cast("string"), 6, "0"), _filled(p[1], 4)))

    return F.lit(True), _let(_let(F.regexp_replace(m, "[^0-9]", ""), new), lambda d: _refill(m, d))


def _ssn(m: Column, key: Column, inverse: bool) -> tuple[Column, Column]:
    area, group, serial = (_long(F.substring(m, at, n)) for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    left = area - 1 - F.when(area > 666, 1).otherwise(0)
    out = feistel(_two(left, (group - 1) * 9999 + serial - 1), _two(898, 99 * 9999), key, "ssn", inverse)
    return valid, _let(out, lambda p: F.concat_ws(
        "-", _filled(p[0] + 1 + F.when(p[0] >= 665, 1).otherwise(0), 3), _filled(F.floor(p[1] / 9999) + 1, 2), _filled(p[1] % 9999 + 1, 4)
    ))


def _iban(m: Column, key: Column, inverse: bool) -> tuple[Column, Column]:
    country, rest = F.substring(m, 1, 2), F.substring(m, 5, 60)
    digits = F.regexp_replace(rest, "[^0-9]", "")
    plain = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    valid = (F.length(digits) >= 2) & (_mod97(F.concat(plain(rest), F.substring(m, 1, 4))) == 1)
    new = _let(_digits_permuted(digits, key, "iban", inverse), lambda d: _refill(rest, d))
    return valid, _let(new, lambda r: F.concat(country, _filled(98 - _mod97(F.concat(plain(r), country, F.lit("00"))), 2), r))


def _ip(m: Column, key: Column, inverse: bool) -> tuple[Column, Column]:
    octets = F.transform(F.split(m, r"\."), _long)
    pair = _let(octets, lambda o: _two(o[0] * 256 + o[1], o[2] * 256 + o[3]))
    out = feistel(pair, _two(65536, 65536), key, "ip", inverse)
    new = _let(out, lambda p: F.concat_ws(
        ".", *[x.cast("string") for h in (p[0], p[1]) for x in (F.floor(h / 256), h % 256)]
    ))
    return ~F.exists(octets, lambda o: o > 255), new


def _date(m: Column, key: Column, inverse: bool) -> tuple[Column, Column]:
    part = lambda at, n: F.substring(m, at, n).cast("int")
    dashed, dotted = m.contains("-"), m.contains(".")
    year = F.when(dashed, part(1, 4)).otherwise(part(7, 4))
    month = F.when(dashed, part(6, 2)).when(dotted, part(4, 2)).otherwise(part(1, 2))
    day = F.when(dashed, part(9, 2)).when(dotted, part(1, 2)).otherwise(part(4, 2))
    first = F.make_date(year, F.least(F.greatest(month, F.lit(1)), F.lit(12)), F.lit(1))
    valid = month.between(1, 12) & (day >= 1) & (day <= F.day(F.last_day(first)))
    offset = F.datediff(F.date_add(first, day - 1), F.lit(FIRST_DAY).cast("date"))
    out = feistel(_two(F.floor(offset / DAYS[1]), offset % DAYS[1]), _two(*DAYS), key, "date", inverse)
    new = _let(out, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p[0] * DAYS[1] + p[1]).cast("int")))
    form = lambda d, f: F.date_format(d, f)
    return valid, _let(new, lambda d: F.when(dashed, form(d, "yyyy-MM-dd")).when(dotted, form(d, "dd.MM.yyyy")).otherwise(form(d, "MM/dd/yyyy")))


def _symbols_permuted(symbols: Column, key: Column, inverse: bool) -> Column:
    """Letters and digits permuted within their own alphabets, as two halves."""
    n = F.length(symbols)
    a = F.floor(n / 2)
    radix = lambda c: F.when(F.ascii(c) < 58, F.lit(10)).otherwise(F.lit(26)).cast("bigint")
    first = lambda c: F.when(F.ascii(c) < 58, 48).when(F.ascii(c) < 91, 65).otherwise(97)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    parts = F.array(F.substr(symbols, F.lit(1), a), F.substr(symbols, a + 1, n))
    chars = F.transform(parts, lambda h: F.filter(F.split(h, ""), lambda c: c != ""))
    value = lambda cs: F.aggregate(cs, zero, lambda v, c: v * radix(c) + F.ascii(c) - first(c))
    size = lambda cs: F.aggregate(cs, one, lambda v, c: v * radix(c))

    def written(cs: Column, v: Column) -> Column:
        def put(acc: Column, c: Column) -> Column:
            char = F.char((first(c) + acc["rest"] % radix(c)).cast("bigint"))
            return F.struct(((acc["rest"] - acc["rest"] % radix(c)) / radix(c)).cast("bigint").alias("rest"), F.concat(char, acc["out"]).alias("out"))

        return F.aggregate(F.reverse(cs), F.struct(v.alias("rest"), F.lit("").alias("out")), put, lambda acc: acc["out"])

    def both(x: Column) -> Column:
        out = feistel(F.transform(x, value), F.transform(x, size), key, "email", inverse)
        return _let(out, lambda p: F.concat(written(x[0], p[0]), written(x[1], p[1])))

    return _let(chars, both)


def _email(m: Column, key: Column, inverse: bool) -> tuple[Column, Column]:
    local = F.substring_index(m, "@", 1)
    symbols = F.regexp_replace(local, "[^A-Za-z0-9]", "")
    starts = F.sequence(F.lit(1), F.greatest(F.length(symbols), F.lit(1)), F.lit(SYMBOLS_PER_STEP))
    steps = F.transform(starts, lambda at: _let(F.substr(symbols, at, F.lit(SYMBOLS_PER_STEP)), lambda s: _symbols_permuted(s, key, inverse)))

    def put(acc: Column, c: Column, new: Column) -> Column:
        is_symbol = c.between("0", "9") | c.between("A", "Z") | c.between("a", "z")
        out = F.concat(acc["out"], F.when(is_symbol, F.substr(new, acc["used"] + 1, F.lit(1))).otherwise(c))
        return F.struct(out.alias("out"), (acc["used"] + is_symbol.cast("int")).alias("used"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))
    out = _let(F.array_join(steps, ""), lambda new: F.aggregate(F.split(local, ""), start, lambda a, c: put(a, c, new), lambda a: a["out"]))
    return symbols != "", F.concat(out, F.substr(m, F.length(local) + 1, F.length(m)))


KINDS: dict[str, Callable[[Column, Column, bool], tuple[Column, Column]]] = {
    "email": _email, "iban": _iban, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn, "card": _card,
}


def pseudonym(m: Column, key: Column, inverse: bool = False) -> Column:
    """A matched value as struct (kind, value); kind is null, and the value
    unchanged, when it fails the validation of its kind."""
    out = F.lit(None).cast("struct<kind:string,value:string>")
    as_is = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"))
    for kind, rule in reversed(KINDS.items()):
        valid, value = rule(m, key, inverse)
        found = F.when(valid, F.struct(F.lit(kind).alias("kind"), value.alias("value"))).otherwise(as_is)
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), found).otherwise(out)
    return out


def run_key(spark: SparkSession) -> str:
    """The key that the session names, else a random one."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def pseudonymise(docs: DataFrame, key: str | None = None, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """One row per input row: ``doc`` (the other columns), ``text`` rewritten,
    ``n_found`` values and their ``kinds`` (sorted, comma-joined). Without a
    ``key`` that of the session (``docsift.pii.secret``) counts, else a random one."""
    spark = docs.sparkSession
    secret = spark.createDataFrame([(key or run_key(spark),)], "key string")
    others = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text_col])
    none = F.array().cast("array<string>")
    text = docs[f"`{text_col}`"]
    rows = docs.select(others.alias("doc"), text.alias("text"), F.coalesce(text.rlike(PATTERN), F.lit(False)).alias("any"))
    rows = rows.select(
        "doc", "text",
        F.when(F.col("any"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(none).alias("matches"),
        F.when(F.col("any"), F.split("text", PATTERN, -1)).otherwise(none).alias("gaps"),
    )
    rows = rows.withColumn("key", secret.scalar())
    found = F.transform("matches", lambda m: pseudonym(m, F.col("key"), inverse))
    rows = rows.select("doc", "text", "gaps", found.alias("found"))
    pieces = F.zip_with("gaps", F.transform("found", lambda x: x["value"]), lambda g, v: F.concat(g, F.coalesce(v, F.lit(""))))
    kinds = F.filter(F.transform("found", lambda x: x["kind"]), lambda k: k.isNotNull())
    return rows.select(
        "doc",
        F.when(F.size("found") == 0, F.col("text")).otherwise(F.array_join(pieces, "")).alias("text"),
        F.size(kinds).cast("bigint").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct(kinds)), ",").alias("kinds"),
    )
