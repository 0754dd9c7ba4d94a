import hashlib

import public_tokenizers as P
import pytest

from txrisk.llm import bpe
from txrisk.llm.runtime import ready

TEXTS = ["it's  we'll   x\n\n y" * 60, "a" * 3000, " " * 900 + "b", "abc " * 100 + "x" * 900 + " def " * 300, "naïve 東京 café — ½ <|endoftext|> " * 40,
         "'" * 500 + "re", "hi"]


def expected(rows):
    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        yield i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk,overlap", [(200, 20), (64, 8), (32768, 512)])
def test_chunked_ids_are_those_of_the_whole_text(spark, chunk, overlap):
    ready(spark)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (None, TEXTS[0]), (3, TEXTS[3]), (3, "other " * 200), (7, None), (8, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, no int")
    got = [tuple(r) for r in bpe.round_trip(bpe.encode(df, chunk_chars=chunk, overlap=overlap)).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)


def test_white_space_directly_before_chunk_starts(spark):
    ready(spark)
    rows = [(i, ("".join("abcde fg" [j % 8] for j in range(64 - len(gap))) + gap) * 4 + "Next")
            for i, gap in enumerate(["\n\n", " \n", "\n\n\n", "\t\t", "  ", "\r\n", "\u3000\u3000", "\n" * 20, "\x1c\n", "\x85\n"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in bpe.round_trip(bpe.encode(df, chunk_chars=64, overlap=16)).collect()]
    assert sorted(got) == sorted(expected(rows))


def test_decode_gives_the_bytes_back_and_empty_tables_stay_empty(spark):
    ready(spark)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode(bpe.encode(df, chunk_chars=100, overlap=10)).collect()}
    assert back == dict(enumerate(TEXTS))
    assert bpe.round_trip(bpe.encode(df.limit(0))).count() == 0
