"""Pseudonyms for personal data that keep their format, in SQL functions only.

Numbers and dates are found by pattern and validated (check digits, ranges, the
calendar).  Each valid value is an element of a finite domain that a keyed Feistel
network permutes, so equal values stay equal across documents, different ones stay
different, and every pseudonym is again a valid value of the same format:

========  =====================================================================
card      13 to 19 digits with a valid Luhn digit; the first digit stays, the
          others are permuted and the check digit is set anew
phone     ten digits behind an optional country code, which stays
ssn       area, group and serial within the ranges in use
ip        four numbers up to 255
date      a day of 1900 to 2099 as year-month-day, month/day/year or day.month.year
email     letters and digits of both parts are drawn from a keyed stream of the
          whole address; this is no permutation but as good as free of collisions
========  =====================================================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "date", "ssn", "phone", "card")
ROUNDS = 8

_START, _END = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
PATTERNS = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)+",
    "ip": "(?<![0-9A-Za-z.])\\d{1,3}(?:\\.\\d{1,3}){3}(?![0-9A-Za-z])(?!\\.\\d)",
    "date": f"{_START}(?:\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}/\\d{{2}}/\\d{{4}}|"
    f"\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}){_END}",
    "ssn": f"{_START}\\d{{3}}-\\d{{2}}-\\d{{4}}{_END}",
    "phone": "(?<![0-9A-Za-z+])(?:\\+\\d{1,3}[ .-]?)?(?:\\(\\d{3}\\) ?|\\d{3}[ .-])"
    f"\\d{{3}}[ .-]\\d{{4}}{_END}",
    "card": f"{_START}\\d(?:[ -]?\\d){{12,18}}{_END}",
}
ANY = "|".join(f"(?:{PATTERNS[kind]})" for kind in KINDS)

#: Days of 1900-01-01 to 2099-12-31, 17 x 4297.
_DAYS = (17, 4297)


def _int(text: Column) -> Column:
    return text.cast("bigint")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, its last digit not doubled."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total, i):
        d = _int(F.substring(digits, F.length(digits) - i + 1, F.lit(1)))
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(places, F.lit(0).cast("bigint"), add)


def keyed(key: str, *parts: Column) -> Column:
    """A 60-bit number from the key and the parts."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def permuted(left: Column, right: Column, a: Column, b: Column, tag: str, key: str) -> Column:
    """Pair (left, right) below (a, b) under a keyed permutation of all such pairs.

    A Feistel network with halves of unequal size: rounds add a keyed function of one
    half to the other in turn, modulo its size.
    """

    def turn(pair, i):
        l, r = pair["l"], pair["r"]
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(l + keyed(key, F.lit(tag), i, r), a)).otherwise(l).alias("l"),
            F.when(odd, r).otherwise(F.pmod(r + keyed(key, F.lit(tag), i, l), b)).alias("r"),
        )

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by those of ``digits``."""

    def one(i):
        char = F.substring(value, i, F.lit(1))
        seen = F.length(_digits(F.substring(value, F.lit(1), i)))
        return F.when(char.rlike("[0-9]"), F.substring(digits, seen, F.lit(1))).otherwise(char)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


def _pad(number: Column, width: Column) -> Column:
    return F.lpad(number.cast("string"), width, F.lit("0"))


def _with(value: Column, use) -> Column:
    """``use`` applied to a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    free = F.length(digits) - 2
    low = F.floor(free / 2).cast("int")
    high = (free - low).cast("int")
    power = lambda n: F.pow(F.lit(10.0), n).cast("bigint")
    left = _int(F.substring(digits, F.lit(2), low))
    right = _int(F.substring(digits, low + 2, high))

    def put(pair):
        body = F.concat(F.substring(digits, 1, 1), _pad(pair["l"], low), _pad(pair["r"], high))
        check = F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10))
        return _refill(value, F.concat(body, check.cast("string")))

    new = _with(permuted(left, right, power(low), power(high), "card", key), put)
    return F.when(_luhn(digits) % 10 == 0, new)


def _phone(value: Column, key: str) -> Column:
    digits = _digits(value)
    own = F.length(digits) - 10
    left = _int(F.substring(digits, own + 1, F.lit(5)))
    right = _int(F.substring(digits, own + 6, F.lit(5)))
    size = F.lit(100_000)

    def put(pair):
        five = F.lit(5)
        new = F.concat(_pad(pair["l"], five), _pad(pair["r"], five))
        return _refill(value, F.concat(F.substring(digits, F.lit(1), own), new))

    return _with(permuted(left, right, size, size, "phone", key), put)


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (
        _int(F.substring(value, a, n)) for a, n in ((1, 3), (5, 2), (8, 4))
    )
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    left = area - 1 - F.when(area > 666, 1).otherwise(0)
    right = (group - 1) * 9999 + serial - 1

    def put(pair):
        new_area = pair["l"] + 1 + F.when(pair["l"] + 1 >= 666, 1).otherwise(0)
        return F.concat_ws(
            "-",
            _pad(new_area, F.lit(3)),
            _pad(F.floor(pair["r"] / 9999) + 1, F.lit(2)),
            _pad(pair["r"] % 9999 + 1, F.lit(4)),
        )

    return F.when(valid, _with(permuted(left, right, F.lit(898), F.lit(99 * 9999), "ssn", key), put))


def _ip(value: Column, key: str) -> Column:
    parts = F.split(value, "\\.")
    n = [_int(F.element_at(parts, i)) for i in range(1, 5)]
    valid = (n[0] < 256) & (n[1] < 256) & (n[2] < 256) & (n[3] < 256)
    size = F.lit(65536)

    def put(pair):
        halves = [pair["l"], pair["r"]]
        return F.concat_ws(".", *[x for h in halves for x in (F.floor(h / 256), h % 256)])

    return F.when(valid, _with(permuted(n[0] * 256 + n[1], n[2] * 256 + n[3], size, size, "ip", key), put))


def _date(value: Column, key: str) -> Column:
    iso, slash = F.substring(value, 5, 1) == "-", F.substring(value, 3, 1) == "/"
    at = lambda i, n: _int(F.substring(value, i, n))
    # Each part is read only where it is known to be digits.
    year = F.when(iso, at(1, 4)).otherwise(at(7, 4))
    month = F.when(iso, at(6, 2)).otherwise(F.when(slash, at(1, 2)).otherwise(at(4, 2)))
    day = F.when(iso, at(9, 2)).otherwise(F.when(slash, at(4, 2)).otherwise(at(1, 2)))

    def whole(d):
        valid = (
            d["y"].between(1900, 2099)
            & d["m"].between(1, 12)
            & d["d"].between(1, 28)
        )
        first = F.make_date(d["y"].cast("int"), d["m"].cast("int"), F.lit(1))
        late = (
            d["y"].between(1900, 2099)
            & d["m"].between(1, 12)
            & (d["d"] > 28)
        )
        in_month = F.when(late, d["d"] <= F.day(F.last_day(first))).otherwise(valid)
        origin = F.lit("1900-01-01").cast("date")

        def put(pair):
            new = F.date_add(origin, (pair["l"] * _DAYS[1] + pair["r"]).cast("int"))
            return (
                F.when(iso, F.date_format(new, "yyyy-MM-dd"))
                .when(slash, F.date_format(new, "MM/dd/yyyy"))
                .otherwise(F.date_format(new, "dd.MM.yyyy"))
            )

        days = F.datediff(F.date_add(first, (d["d"] - 1).cast("int")), origin)
        new = _with(
            permuted(
                F.floor(days / _DAYS[1]), days % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1]), "date", key
            ),
            put,
        )
        return F.when(in_month, new)

    return _with(F.struct(year.alias("y"), month.alias("m"), day.alias("d")), whole)


def _email(value: Column, key: str) -> Column:
    dot = F.length(F.substring_index(value, ".", -1)) + 1

    def one(i):
        char = F.substring(value, i, F.lit(1))
        draw = keyed(key, F.lit("email"), i, F.lower(value))
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (draw % 26 + 1).cast("int"), F.lit(1))
        return (
            F.when(i > F.length(value) - dot, char)
            .when(char.rlike("[0-9]"), (draw % 10).cast("string"))
            .when(char.rlike("[a-z]"), letter)
            .when(char.rlike("[A-Z]"), F.upper(letter))
            .otherwise(char)
        )

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


_PSEUDONYM = {
    "email": _email,
    "ip": _ip,
    "date": _date,
    "ssn": _ssn,
    "phone": _phone,
    "card": _card,
}


def pseudonymise(
    docs: DataFrame, key: str, text_col: str = "text", found_col: str = "found"
) -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced by pseudonyms.

    Adds ``found_col``: an array of (kind, value, pseudonym) in the order of the text.
    Values that fail validation stay as they are.  Null texts stay null and have no
    finds; repeated rows are treated alike; other columns pass through, except an old
    column named ``found_col``.
    """
    text = F.col(text_col)

    def judge(value):
        kind, new = None, None
        for name in KINDS:
            matches = value.rlike(f"^(?:{PATTERNS[name]})$")
            kind = F.when(matches, name) if kind is None else kind.when(matches, name)
            made = _PSEUDONYM[name](value, key)
            new = F.when(matches, made) if new is None else new.when(matches, made)
        return F.struct(kind.alias("kind"), value.alias("value"), new.alias("pseudonym"))

    has = F.coalesce(text.rlike("[0-9@]") & text.rlike(ANY), F.lit(False))
    empty = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")
    hits = F.when(has, F.transform(F.regexp_extract_all(text, F.lit(ANY), 0), judge)).otherwise(empty)
    plain = docs.drop(found_col) if found_col in docs.columns else docs
    marked = plain.withColumn("_llm_hits", hits)
    replaced = F.concat(
        F.array_join(
            F.zip_with(
                F.split(text, ANY, -1),
                F.col("_llm_hits"),
                lambda part, hit: F.concat(
                    part, F.coalesce(hit["pseudonym"], hit["value"], F.lit(""))
                ),
            ),
            "",
        )
    )
    kept = F.filter("_llm_hits", lambda h: h["pseudonym"].isNotNull())
    return marked.select(
        *[
            F.when(F.size("_llm_hits") > 0, replaced).otherwise(text).alias(c)
            if c == text_col
            else F.col(c)
            for c in plain.columns
        ],
        kept.alias(found_col),
    )
