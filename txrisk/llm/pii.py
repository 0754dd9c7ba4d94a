"""Format-preserving pseudonyms for personal numbers, dates and addresses, by keyed Feistel permutations.

DataFrame functions only. Values are found by pattern and validated (check digits of card and account numbers, octets of network
addresses, ranges of social security numbers, the calendar for dates). Each valid value is permuted within its format by a
Feistel network whose round function is SHA-256 under a key: the same value always gives the same pseudonym,
whatever its punctuation, so equal values stay linked across documents; different values never share one.

* card numbers: all digits but the last are permuted, the last is the new check digit;
* telephone numbers: `+` and 8 to 15 digits, or ten digits as written in North America; the country code stays;
* bank accounts (IBAN): the account within its kinds of characters, with new check digits (modulo 97); the country stays;
* social security numbers: within the valid areas, groups and serials;
* IPv4 addresses: within all addresses;
* dates: the day within a block of 73,170 days (1900-01-01 to 2100-05-01 is one block), written as before (a date
  without leading zeros stays without);
* e-mail addresses: the letters and digits before the @, each within its kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import spare

ROUNDS = 8
_IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
_DATE = r"(?<![\d/.-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d/-]|\.\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = (r"(?<![\w+])\+(?:1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\d(?:[ ./-]?[ (]?\d\)?){7,14})(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
          r"|(?<![\w.-])\d{3}([.-])\d{3}\3\d{4}(?![\d-])")
_CARD = r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w])"
_EMAIL = r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)"
NUMBERS = rf"(?:(?=[\d+(])(?:{_IP}|{_DATE}|{_SSN}|{_PHONE}|{_CARD})|{_IBAN})"
VALUES = rf"{_EMAIL}|{NUMBERS}"
_BLOCK = (270, 271)                                    # 270 * 271 = 73,170 days


# Country calling codes of two digits (1 and 7 have one, all others three): fixed values.
CALLING = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _random(key: str, *parts: Column) -> Column:
    """60 keyed pseudo-random bits."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def permute_number(x: Column, a: int, b: int, key: str, kind: str, tweak: Column | None = None) -> Column:
    """A keyed permutation of 0 .. a * b - 1 (bigint): Feistel rounds on the quotient and the remainder by b."""
    extra = tweak if tweak is not None else F.lit(0)
    start = F.struct(F.floor(x / F.lit(b)).cast("bigint").alias("l"), F.pmod(x, F.lit(b)).cast("bigint").alias("r"))

    def step(s: Column, i: Column) -> Column:
        l = F.pmod(s["l"] + _random(key, F.lit(kind), i, extra, s["r"]) % a, F.lit(a)).cast("bigint")
        r = F.pmod(s["r"] + _random(key, F.lit(kind), i + 100, extra, s["l"]) % b, F.lit(b)).cast("bigint")
        even = i % 2 == 0
        return F.struct(F.when(even, l).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(r).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def permute_text(s: Column, key: str, kind: str) -> Column:
    """A keyed permutation of texts in which every digit, small and large ASCII letter keeps its kind and place."""
    half = F.floor(F.char_length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1).alias("r"))

    def moved(part: Column, other: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.char_length(part).cast("string"), other), 256)

        def one(ch: Column, at: Column) -> Column:
            by = F.conv(F.substr(stream, (at % 30) * 2 + 1, F.lit(4)), 16, 10).cast("int")
            code = F.ascii(ch)

            def within(low: int, n: int) -> Column:
                return F.when(code.between(low, low + n - 1), F.char((code - low + by) % n + low))

            plain = F.octet_length(ch) == 1
            return F.coalesce(F.when(plain, F.coalesce(within(48, 10), within(97, 26), within(65, 26))), ch)

        chars = F.filter(F.split(part, ""), lambda c: c != "")
        return F.array_join(F.transform(chars, one), "")

    def step(p: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, moved(p["l"], p["r"], i)).otherwise(p["l"]).alias("l"),
                        F.when(even, p["r"]).otherwise(moved(p["r"], p["l"], i)).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda p: F.concat(p["l"], p["r"]))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"\D", "")


def _luhn(digits: Column, check_follows: bool) -> Column:
    """The Luhn sum of a digit text; ``check_follows``: of one that a check digit is still to follow."""
    odd = 0 if check_follows else 1
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(
        i % 2 == odd, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda n, d: n + d)


def _written_like(v: Column, marks: Column) -> Column:
    """The characters of ``marks`` in place of the digits and capital letters of ``v``, one by one."""
    chars = F.filter(F.split(v, ""), lambda c: c != "")
    step = lambda s, c: F.when(c.between("0", "9") | c.between("A", "Z"), F.struct(
        F.concat(s["t"], F.substr(marks, s["i"], F.lit(1))).alias("t"), (s["i"] + 1).alias("i"))).otherwise(
        F.struct(F.concat(s["t"], c).alias("t"), s["i"].alias("i")))
    return F.aggregate(chars, F.struct(F.lit("").alias("t"), F.lit(1).alias("i")), step, lambda s: s["t"])


def _card(v: Column, key: str) -> Column:
    d = _digits(v)
    body = permute_text(F.substr(d, F.lit(1), F.char_length(d) - 1), key, "card")
    new = F.concat(body, ((10 - _luhn(body, True) % 10) % 10).cast("string"))
    return F.when(_luhn(d, False) % 10 == 0, _written_like(v, new))


def _phone(v: Column, key: str) -> Column:
    d = _digits(v)
    code = F.when(~F.startswith(v, F.lit("+")), F.char_length(d) - 10).when(F.substring(d, 1, 1).isin("1", "7"), 1).when(
        F.substring(d, 1, 2).isin(*CALLING), 2).otherwise(3)
    return _written_like(v, F.concat(F.substr(d, F.lit(1), code), permute_text(F.substr(d, code + 1), key, "phone")))


def _mod97(marks: Column) -> Column:
    """The remainder by 97 of digits and capital letters read as a number (A is 10, Z is 35)."""
    chars = F.filter(F.split(marks, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda n, c: F.when(c.between("0", "9"), (n * 10 + F.ascii(c) - 48) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97))


def _iban(v: Column, key: str) -> Column:
    marks = F.regexp_replace(v, " ", "")
    country, body = F.substring(marks, 1, 2), F.substr(marks, F.lit(5))
    new = permute_text(body, key, "iban")
    check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(body, F.substring(marks, 1, 4))) == 1
    return F.when(valid, _written_like(v, F.concat(country, check, new)))


def _ip(v: Column, key: str) -> Column:
    o = F.transform(F.split(v, r"\."), lambda x: x.cast("bigint"))
    number = F.aggregate(o, F.lit(0).cast("bigint"), lambda n, x: n * 256 + x)
    new = permute_number(number, 65536, 65536, key, "ip")
    text = F.concat_ws(".", *[F.pmod(F.shiftright(new, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])
    return F.when(F.forall(o, lambda x: x <= 255), text)


def _ssn(v: Column, key: str) -> Column:
    area, group, serial = (F.substring(v, s, n).cast("bigint") for s, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)          # 0 .. 897
    new = permute_number((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn")
    high = F.floor(new / F.lit(9999)).cast("bigint")
    place = F.floor(high / F.lit(99)).cast("bigint")
    area = F.when(place > 664, place + 2).otherwise(place + 1)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.when(valid, F.concat_ws("-", pad(area, 3), pad(high % 99 + 1, 2), pad(new % 9999 + 1, 4)))


def _date(v: Column, key: str) -> Column:
    sign = F.regexp_extract(v, r"\D", 0)
    parts = F.split(v, r"\D")
    first = F.char_length(parts[0]) == 4
    # day before month with dots, or where only that is a date; month before day otherwise
    a, b = parts[0], parts[1]
    day_first = (sign == ".") | (a.cast("int") > 12)
    two = lambda x: F.lpad(x, 2, "0")
    iso = F.when(first, F.concat_ws("-", a, two(b), two(parts[2]))).when(day_first, F.concat_ws("-", parts[2], two(b), two(a))).otherwise(
        F.concat_ws("-", parts[2], two(a), two(b)))
    # without leading zeros where one is missing
    bare = v.rlike(r"(?:^|\D)\d(?:\D|$)")
    size = _BLOCK[0] * _BLOCK[1]
    day = F.date_diff(F.try_to_date(iso, "yyyy-MM-dd"), F.to_date(F.lit("1900-01-01"))).cast("bigint")
    block = F.floor(day / F.lit(size)).cast("bigint")
    new = permute_number(F.pmod(day, F.lit(size)), *_BLOCK, key, "date", block) + block * size
    date = F.date_add(F.to_date(F.lit("1900-01-01")), new.cast("int"))
    y = F.date_format(date, "yyyy")
    m, d = (F.when(bare, F.date_format(date, f)).otherwise(F.date_format(date, f + f)) for f in ("M", "d"))
    out = F.when(first, F.concat_ws("-", y, m, d)).when(day_first, F.concat_ws("-", d, m, y)).otherwise(F.concat_ws("-", m, d, y))
    return F.when(day.isNotNull(), F.replace(out, F.lit("-"), sign))


def _email(v: Column, key: str) -> Column:
    local, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    return F.concat(permute_text(local, key, "email"), F.lit("@"), domain)


KINDS: dict[str, tuple[str, Callable[[Column, str], Column]]] = {
    "email": (r"@", _email), "ip": (r"^\d{1,3}(\.\d{1,3}){3}$", _ip), "ssn": (r"^\d{3}-\d{2}-\d{4}$", _ssn),
    "date": (r"^(\d{4}\D\d{1,2}\D\d{1,2}|\d{1,2}\D\d{1,2}\D\d{4})$", _date), "iban": (r"^[A-Z]", _iban),
    "phone": (r"^[+(]|^\d{3}([.-])\d{3}\1\d{4}$", _phone), "card": (r"^\d(?:[ -]?\d){12,18}$", _card)}


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value; null if it does not validate."""
    out = None
    for pattern, make in KINDS.values():
        out = F.when(value.rlike(pattern), make(value, key)) if out is None else out.when(value.rlike(pattern), make(value, key))
    return out


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``df`` with every valid personal value in ``text_col`` replaced by its pseudonym under ``key``.

    Invalid look-alikes stay. Null and empty texts stay as they are, other columns, repeated rows and null ids too; very long
    texts are treated whole, an empty table gives an empty table. ``count_col`` names an optional column with the number of values replaced. No shuffle.
    """
    text = F.col(text_col)
    values, between, new = spare(df, "values", "between", "new")
    at, digit = F.contains(text, F.lit("@")), text.rlike(r"\d")
    pick = lambda f: F.when(at, f(F.lit(VALUES))).when(digit, f(F.lit(NUMBERS)))
    found = df.withColumns({values: pick(lambda p: F.regexp_extract_all(text, p, F.lit(0))),
                            between: pick(lambda p: F.call_function("split", text, p, F.lit(-1)))})
    found = found.withColumn(new, F.transform(values, lambda v: pseudonym(v, key)))
    joined = F.array_join(F.transform(between, lambda b, i: F.concat(
        b, F.coalesce(F.get(F.col(new), i), F.get(F.col(values), i), F.lit("")))), "")
    new_text = F.when(F.size(values) > 0, joined).otherwise(text)
    out = [new_text.alias(c) if c == text_col else F.col(c) for c in df.columns]
    if count_col:
        out.append(F.coalesce(F.array_size(F.filter(new, lambda v: v.isNotNull())), F.lit(0)).cast("bigint").alias(count_col))
    return found.select(*out)
