import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from vertexloom.llm import prefix_bpe as bpe
from vertexloom.llm.queries import QUERIES

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CASES = [None, "", " ", "it's  two   spaces\n\n x", "é" * 300, "a" * 3000, "日本語 text 😀", "İ x\x1cy", "12345 6.7", "word " * 500, "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})


def expected(library, x):
    ids = library.encode_ordinary(x or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()


def test_cases_and_clashing_columns(spark, library):
    df = spark.createDataFrame([(i, x, "t", 1) for i, x in enumerate(CASES)] + [(None, "x", "t", 1), (1, "", "t", 1)], "doc_id long, text string, ids string, n_tokens int")
    rows = bpe.round_trip(df, PATH, P.PATTERN).collect()
    assert len(rows) == len(CASES) + 2
    for r in rows:
        if r.doc_id is not None:
            assert tuple(r)[1:] == expected(library, CASES[r.doc_id])
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).collect() == []


def test_columns_round_trip(spark, library):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    ids = bpe.encode_texts(df, PATH, P.PATTERN)
    back = bpe.decode_ids(ids, PATH, P.PATTERN).withColumn("text", F.col("data").cast("string"))
    assert {r.doc_id: r.text for r in back.collect()} == {i: x or "" for i, x in enumerate(CASES)}


def test_query_equals_library(spark, library):
    d = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = QUERIES["op9_bpe_codec"](spark, d).collect()
    assert len(rows) == len(text)
    assert all(tuple(r)[1:] == expected(library, text[r.doc_id]) for r in rows)


def test_append_edit_and_every_prefix(library):
    m, rnd = bpe.codec(PATH, P.PATTERN).merges, random.Random(3)
    one = lambda b: [i for i in library._core_bpe.encode_single_piece(b)]
    for _ in range(100):
        d = bytes(rnd.choice(b"abcthe \xc3\xa9") for _ in range(120))
        p = bpe.Prefixes(m, d[:50])
        p.append(d[50:])
        assert p.last == bpe.Prefixes(m, d).last
        at = rnd.randint(1, len(d))
        assert p.tokens(at) == one(d[:at]) or len(one(d[:at])) == 1
        i = rnd.randint(0, len(d))
        j, new = rnd.randint(i, min(len(d), i + 5)), bytes(rnd.choice(b"abct") for _ in range(rnd.randint(0, 6)))
        p.edit(i, j, new)
        assert p.last == bpe.Prefixes(m, d[:i] + new + d[j:]).last
