"""Pseudonyms held against a second writing of the ciphers in plain Python, on whole texts."""

import hashlib
import re
from datetime import date, timedelta

import duckdb

from txrisk.llm import pii
from txrisk.llm.runtime import ready

KEY = "k"


def sha(*parts):
    return hashlib.sha256("|".join(str(p) for p in parts).encode()).hexdigest()


def cipher_number(x, a, b, kind, tweak=0):
    left, right = divmod(x, b)
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + int(sha(KEY, kind, i, tweak, right)[:15], 16) % a) % a
        else:
            right = (right + int(sha(KEY, kind, i + 100, tweak, left)[:15], 16) % b) % b
    return left * b + right


def cipher_text(s, kind):
    left, right = s[: len(s) // 2], s[len(s) // 2:]

    def moved(part, other, i):
        stream, out = sha(KEY, kind, i, len(part), other), ""
        for at, ch in enumerate(part):
            by = int(stream[at % 30 * 2: at % 30 * 2 + 4], 16)
            for low, n in ((48, 10), (97, 26), (65, 26)):
                if low <= ord(ch) < low + n:
                    ch = chr((ord(ch) - low + by) % n + low)
                    break
            out += ch
        return out

    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = moved(left, right, i)
        else:
            right = moved(right, left, i)
    return left + right


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10


def written_like(v, marks):
    it = iter(marks)
    return "".join(next(it) if c.isascii() and (c.isdigit() or c.isupper()) else c for c in v)


def calendar(y, m, d):
    try:
        return date(int(y), int(m), int(d))
    except ValueError:
        return None


def iban_number(marks):
    return int("".join(c if c.isdigit() else str(ord(c) - 55) for c in marks))


def pseudonym(v):
    d = re.sub(r"\D", "", v)
    if "@" in v:
        local, domain = v.split("@")
        return cipher_text(local, "email") + "@" + domain
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", v):
        o = [int(x) for x in v.split(".")]
        if max(o) > 255:
            return None
        new = cipher_number(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 65536, 65536, "ip")
        return ".".join(str(new >> s & 255) for s in (24, 16, 8, 0))
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", v):
        area, group, serial = map(int, v.split("-"))
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return None
        new = cipher_number(((area - 2 if area > 666 else area - 1) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
        place, group = divmod(new // 9999, 99)
        return f"{place + 2 if place > 664 else place + 1:03}-{group + 1:02}-{new % 9999 + 1:04}"
    if re.fullmatch(r"\d{4}\D\d{1,2}\D\d{1,2}|\d{1,2}\D\d{1,2}\D\d{4}", v):
        sign, parts = re.search(r"\D", v)[0], re.split(r"\D", v)
        first, day_first = len(parts[0]) == 4, sign == "." or int(parts[0]) > 12
        ymd = parts if first else [parts[2], *(parts[1::-1] if day_first else parts[:2])]
        if (when := calendar(*ymd)) is None:
            return None
        days, size = (when - date(1900, 1, 1)).days, 270 * 271
        new = date(1900, 1, 1) + timedelta(days=cipher_number(days % size, 270, 271, "date", days // size) + days // size * size)
        two = "{:d}" if any(len(x) == 1 for x in parts) else "{:02d}"
        y, m, dd = f"{new.year:04}", two.format(new.month), two.format(new.day)
        return sign.join((y, m, dd) if first else (dd, m, y) if day_first else (m, dd, y))
    if v[0].isupper():
        marks = v.replace(" ", "")
        if iban_number(marks[4:] + marks[:4]) % 97 != 1:
            return None
        body = cipher_text(marks[4:], "iban")
        return written_like(v, f"{marks[:2]}{98 - iban_number(body + marks[:2] + '00') % 97:02}{body}")
    if v[0] in "+(" or re.fullmatch(r"\d{3}([.-])\d{3}\1\d{4}", v):
        code = len(d) - 10 if v[0] != "+" else 1 if d[0] in "17" else 2 if d[:2] in pii.CALLING else 3
        return written_like(v, d[:code] + cipher_text(d[code:], "phone"))
    if luhn(d):
        return None
    body = cipher_text(d[:-1], "card")
    return written_like(v, body + str(-luhn(body + "0") % 10))


def brute_force(text):
    if text is None:
        return None
    return re.sub(pii.VALUES, lambda m: pseudonym(m[0]) or m[0], text, flags=re.ASCII)


LINES = ["+44 20 7946 0958", "+33 1 23 45 67 89", "+49 30 901820", "+353 1 496 0000.", "+1 (319) 555-5132, 319-555-5132 and (319) 555-5132", "+12", "+1234567",
         "+1 319 555 5132 2024", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32.", "FR14 2004 1010 0505 0001 3M02 606",
         "NL91 ABNA 0417 1643 00 and DE00 3704 0044 0532 0130 00", "1/5/2020", "01/05/2020", "5.1.2020", "05.01.2020", "2020-1-5", "2020-01-05", "31/2/2020", "1.2.3.4", "300.1.1.1",
         "13/1/1999 (1/13/1999)", "1850-1-1 or 2150-12-31", "4799-1346-8104-4206", "4799 1346 8104 4207", "123-45-6789 666-45-6789", "fh.K7@mail5.example.com a@b", "", "no values",
         "x" * 50 + " 1/5/2020 " * 3]


def masked(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, KEY).collect()}


def test_values_equal_the_second_writing(spark):
    ready(spark)
    got = masked(spark, [*LINES, None])
    assert got == {i: brute_force(t) for i, t in enumerate([*LINES, None])}
    for i in (0, 1, 2, 3, 8, 9, 10, 11, 13, 15, 17):
        assert got[i] != LINES[i], LINES[i]


def test_equal_values_stay_linked_in_any_writing(spark):
    ready(spark)
    got = masked(spark, LINES)
    assert got[8].replace(" ", "") == got[9] and got[9][:2] == "DE" and iban_number(got[9][4:] + got[9][:4]) % 97 == 1
    day = date.fromisoformat(got[18])
    assert got[13] == f"{day.month}/{day.day}/{day.year}" and got[14] == f"{day:%m/%d/%Y}" and got[15] == f"{day.day}.{day.month}.{day.year}"
    assert got[0].startswith("+44 ") and got[1].startswith("+33 ") and got[2].startswith("+49 ") and got[3].startswith("+353 ")


def test_whole_documents_equal_the_second_writing(spark, sf001):
    ready(spark)
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf001}/documents.parquet'").fetchall()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, KEY).collect()}
    assert got == {i: brute_force(t) for i, t in rows}
    assert sum(got[i] != t for i, t in rows) > 5


def test_very_long_text_and_empty_table(spark):
    ready(spark)
    text = "word " * 150_000 + "call +44 20 7946 0958 " + "word " * 150_000
    assert masked(spark, [text]) == {0: brute_force(text)}
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), KEY).collect() == []
