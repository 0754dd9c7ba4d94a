"""Line de-duplication and pseudonyms (DataFrame functions only)."""
import re
from datetime import date

from pyspark.sql import functions as F

from txrisk.llm import lines, pii
from txrisk.llm.runtime import ready


def test_lines_equal_brute_force(spark):
    ready(spark)
    docs = [(i, f"head {i % 2}\nbody {i}\n\n foot" if i % 3 else f"head 0\nhead 0\nbody {i}", "a" if i < 12 else "b") for i in range(20)]
    docs += [(30 + i, "nav\nx", None) for i in range(3)] + [(40, None, "a"), (41, "", "a"), (42, "\n\n", "b"), (42, "\n\n", "b")]
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, source string, bad_lines int, kept_lines string")
    got = lines.drop_boilerplate(df, max_ratio=0.5, min_pages=3, n_lines="n", n_removed="gone")
    assert got.columns == [*df.columns, "n", "gone"]
    total, have = {}, {}
    for _, t, s in docs:
        total[s] = total.get(s, 0) + 1
        for x in set((t or "").split("\n")) if t is not None else ():
            have[s, x] = have.get((s, x), 0) + 1
    want = []
    for i, t, s in docs:
        ls = t.split("\n") if t is not None else []
        kept = [x for x in ls if not (x.strip() and have[s, x] >= 3 and have[s, x] > 0.5 * total[s])]
        want.append((i, "\n".join(kept) if t is not None else None, s, 1, "k", len(ls), len(ls) - len(kept)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(w[6] for w in want) and lines.drop_boilerplate(df.limit(0)).count() == 0


def test_lines_use_no_python(spark):
    ready(spark)
    df = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    for out in (lines.drop_boilerplate(df), pii.pseudonymise(df, "k")):
        assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def masked(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, "v") for i, t in enumerate(texts)], "doc_id long, text string, values string")
    return [r["text"] for r in pii.pseudonymise(df, key, count_col="n").orderBy("doc_id").collect()]


def test_values_keep_format_and_stay_linked(spark):
    ready(spark)
    out = masked(spark, ["card 4799134681044206.", "again: 4799-1346-8104-4206", "4799134681044207", "+1 (319) 555-5132", "tel 319-555-5132", "27.109.211.155",
                         "300.1.1.1", "1.2.3.4.5", "123-45-6789", "666-45-6789", "fh.K7@mail5.example.com", None, "", "7602ad27cf5550de1c"])
    card = re.fullmatch(r"card (\d{16})\.", out[0])[1]
    assert card != "4799134681044206" and luhn(card) and re.sub(r"\D", "", out[1]) == card
    assert re.fullmatch(r"again: \d{4}-\d{4}-\d{4}-\d{4}", out[1])
    assert out[2] == "4799134681044207" and out[6:8] == ["300.1.1.1", "1.2.3.4.5"] and out[9] == "666-45-6789" and out[11:] == [None, "", "7602ad27cf5550de1c"]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[3]) and re.sub(r"\D", "", out[3])[1:] == re.sub(r"\D", "", out[4])
    assert out[5] != "27.109.211.155" and all(int(x) < 256 for x in out[5].split("."))
    a, g, s = map(int, out[8].split("-"))
    assert out[8] != "123-45-6789" and 0 < a < 900 and a != 666 and g and s
    assert re.fullmatch(r"[a-z]{2}\.[A-Z]\d@mail5\.example\.com", out[10])
    assert masked(spark, ["4799134681044206"], "other")[0] != card


def test_dates(spark):
    ready(spark)
    out = masked(spark, ["2024-02-29", "29.02.2024", "02/29/2024", "29/02/2024", "2023-02-29", "02/30/2020", "1850-01-01", "2024-02-29 and 2024/02/29"])
    day = date.fromisoformat(out[0])
    assert day != date(2024, 2, 29)
    assert out[1] == day.strftime("%d.%m.%Y") and out[2] == day.strftime("%m/%d/%Y") and out[3] == day.strftime("%d/%m/%Y")
    assert out[4:6] == ["2023-02-29", "02/30/2020"] and date.fromisoformat(out[6]) < date(1900, 1, 1)
    assert out[7] == f"{day} and {day.strftime('%Y/%m/%d')}"


def test_networks_are_permutations(spark):
    ready(spark)
    n = spark.range(27 * 31).select(pii.permute_number(F.col("id"), 27, 31, "k", "x").alias("p"))
    assert n.agg(F.countDistinct("p"), F.min("p"), F.max("p")).first()[:] == (837, 0, 836)
    for width in (1, 2, 3):
        m = spark.range(10 ** width).select(pii.permute_text(F.lpad(F.col("id").cast("string"), width, "0"), "k", "x").alias("p"))
        assert m.agg(F.countDistinct("p"), F.min(F.length("p"))).first()[:] == (10 ** width, width)
