"""Removal against a plain version that looks at every window, and against the SQL."""

import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from vertexloom.llm import substrings
from vertexloom.llm.common import table
from vertexloom.llm.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


def plain(rows):
    first = {}
    for doc, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            if doc is not None:
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in rows:
        w = (text or "").encode().split()
        gone = {j for i in range(len(w) - 12) for j in range(i, i + 13) if doc is not None and first[tuple(w[i : i + 13])] < doc}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((-1 if doc is None else doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_cases(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice("abcdefgh")
    passages = [[word() + word() for _ in range(n)] for n in (12, 13, 14, 30, 200)]
    rows = []
    for doc in range(120):
        w = []
        for _ in range(rnd.randint(0, 6)):
            w += rnd.choice(passages) if rnd.random() < 0.6 else [word() + word() + word() for _ in range(rnd.randint(0, 20))]
        rows.append((doc, rnd.choice([" ", "\n", "\t \x0b"]).join(w)))
    rows += [(200, None), (201, ""), (202, "the " * 3000), (203, "the " * 20), (None, "the " * 20), (204, " ".join(passages[4])), (204, " ".join(passages[4])), (205, "a\x1cb\xa0c " * 14), (205, "a\x1cb\xa0c " * 13), (206, "a\x1cb\xa0c " * 13), (207, "a\x1cb\xa0c " * 13), (207, "new " + " ".join(map(str, range(40)))), (208, "x" * 300_000 + " y" * 30), (209, "x" * 300_000 + " y" * 30 + " z" * 200_000)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, place int, places string")
    assert got(substrings.digest(df)) == plain(rows)
    assert substrings.digest(df.limit(0)).collect() == []
    kept = substrings.remove(df)
    assert kept.columns == df.columns and kept.count() == len(rows)
    odd = df.withColumnsRenamed({"place": "__id", "places": "__hash"}).withColumns({"row": F.array("doc_id"), "__copy": F.lit(None).cast("boolean")})
    again = substrings.remove(odd)
    assert again.columns == odd.columns and sorted(map(str, again.select(odd.columns[:4]).collect())) == sorted(map(str, kept.toDF(*odd.columns[:4]).collect()))
    assert all(r.row == [r.doc_id] and r["__id"] == 1 and r["__hash"] == "p" for r in again.collect())
    digests = {(r.doc_id, r.n_words): r for r in substrings.digest(df).collect()}
    for r in kept.collect():
        if r.text is None:
            assert r.doc_id == 200
    found = {}
    for r in substrings.maximal_repeats(df.where("doc_id < 200 OR doc_id IN (202, 206)")).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.end))
    want = {i: n for i, _, n, _ in plain([x for x in rows if x[0] is not None and (x[0] < 200 or x[0] in (202, 206))]) if n}
    assert {i: sum(b - a for a, b in x) for i, x in found.items()} == want  # all that goes, and no more
    for x in found.values():
        x.sort()
        assert all(b - a >= 13 for a, b in x) and all(b < a for (_, b), (a, _) in zip(x, x[1:], strict=False))  # none overlaps or touches the next
    assert digests


def test_query_and_sql(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, D, "documents").collect()]
    want = plain(rows)
    assert sum(x[2] for x in want) > 0
    assert got(QUERIES["op6_substring_dedup"](spark, D)) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    assert sorted(con.execute(ORACLES["op6_substring_dedup"]).fetchall()) == want


def words_removed(rows):
    """The kept words of each text, joined by a space; None where nothing goes."""
    first, out = {}, {}
    split = {i: (x or "").encode().split() for i, x in rows}
    for i, w in split.items():
        for k in range(len(w) - 12):
            if i is not None:
                g = tuple(w[k : k + 13])
                first[g] = min(first.get(g, i), i)
    for i, w in split.items():
        gone = {j for k in range(len(w) - 12) for j in range(k, k + 13) if i is not None and first[tuple(w[k : k + 13])] < i}
        out[i] = b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else None
    return out
