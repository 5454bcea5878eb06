"""The search against brute force and the SQL."""

import duckdb
import numpy as np

from vertexloom.llm import vectors
from vertexloom.llm.common import table
from vertexloom.llm.queries import ORACLES, QUERIES


def brute(rows, every=100, k=10):
    ok = [(i, np.array(x, float)) for i, x in rows if i is not None and x and all(e is not None and np.isfinite(e) for e in x) and any(x)]
    out = []
    for q, x in ok:
        if q % every == 0:
            near = sorted((float(vectors.exact(x[None], y[None])[0]), i) for i, y in ok if i != q and len(x) == len(y))[:k]
            out += [(q, n + 1, i, s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def test_query(spark):
    for d in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = [(r.vec_id, r.embedding) for r in table(spark, d, "embeddings").collect()]
        got = sorted(map(tuple, QUERIES["op1_nearest_vectors"](spark, d).collect()))
        want = brute(rows)
        hit = len({(a, c) for a, _, c, _ in got} & {(a, c) for a, _, c, _ in want}) / len(want)
        assert len(got) == len(want) and hit > 0.99
        if d.endswith("0.01"):
            assert got == want
            con = duckdb.connect()
            con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
            assert sorted(con.execute(ORACLES["op1_nearest_vectors"]).fetchall()) == want


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES", 2)
    monkeypatch.setattr(vectors, "VECTORS", 20)
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(70).tolist()) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (60, [0.0] * 70), (61, None), (62, []), (63, [1.0] * 69 + [None]), (64, [float("nan")] * 70), (65, [float("inf")] * 70), (None, rows[1][1]), (70, [1.0, 2.0]), (80, [1.0, 3.0])]
    df = spark.createDataFrame([(*x, 1, 0.5) for x in rows], "vec_id long, embedding array<double>, rank int, score double")
    assert sorted(map(tuple, vectors.nearest(df, 10).collect())) == brute(rows, 10)
    assert vectors.nearest(df.limit(0)).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vectors.nearest(same, 10).collect())) == brute([(i, [1.0, 2.0]) for i in range(30)], 10)


def test_repeated_rows(spark):
    """Copies of a row, and other vectors of its id, take one rank; whatever task and block they are in."""
    r = np.random.default_rng(6)
    one = [(i, r.standard_normal(8).tolist()) for i in range(40)]
    near = (np.array(one[0][1]) + 0.01).tolist()
    rows = one + [(100, near)] * 30 + [(101, (np.array(near) + 0.01).tolist())] * 2 + [(101, one[7][1])] + [(102, one[0][1]), (102, one[9][1])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    least = {}
    for q in (0, 10, 20, 30):
        for i, x in rows:
            if i != q:
                s = float(vectors.exact(np.array([one[q][1]]), np.array([x]))[0])
                least[q, i] = min(s, least.get((q, i), np.inf))
    want = []
    for q in (0, 10, 20, 30):
        want += [(q, n + 1, i, s) for n, (s, i) in enumerate(sorted((s, i) for (p, i), s in least.items() if p == q)[:10])]
    for parts in (1, 4):
        got = sorted(map(tuple, vectors.nearest(df.repartition(parts), 10).where("query_id < 40").collect()))
        assert got == want


def test_rare_dimensions(spark, monkeypatch):
    """More dimensions than are searched by codes."""
    monkeypatch.setattr(vectors, "DIMS", 1, raising=False)
    r = np.random.default_rng(7)
    rows = [(i, r.standard_normal(3 + i // 40).tolist()) for i in range(120)] + [(130, [1.0] * 9), (131, [2.0] * 9), (131, [1.5] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, vectors.nearest(df, 10).collect())) == brute(rows[:-2] + rows[-1:], 10)


def test_the_65th_dimension(spark):
    rows = [(10 * n + i, [1.0] * n) for n in range(1, 65) for i in (1, 2, 3)] + [(0, [1.0] * 70), (5, [2.0] * 70)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    assert sorted(map(tuple, vectors.nearest(df, 1000).collect())) == brute(rows, 1000) != []


def test_lists_lots_and_rounds(spark, monkeypatch):
    """Clustered vectors, lists that are probed in either round, lots of vectors and crowds of queries: whatever the bounds skip isn't among the nearest."""
    for name, x in (("FIRST", 1), ("VECTORS", 16), ("QUERIES", 3), ("STEP", 8), ("PAIRS", 32)):
        monkeypatch.setattr(vectors, name, x)
    r = np.random.default_rng(8)
    middle = r.standard_normal((6, 16)) * 4
    rows = [(i, (middle[i % 6] + r.standard_normal(16) * (0.2 if i % 5 else 2)).tolist()) for i in range(600)] + [(601, middle[0].tolist())] * 200
    coders, dims = vectors._coders(vectors.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert dims == [16] and len(coders[16].centres) > 3
    got = sorted(map(tuple, vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), 10).collect()))
    assert got == brute(rows[:601], 10)


def test_bounds_hold():
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 60))
    c = vectors.Coder.fit(x[:500], 9)
    near, codes, sizes, along = c.encode(x)
    of = near == near[0]
    guess, off = c.estimate(x[:50], near[0], codes[of], sizes[of], along[of])
    true = vectors._squares(x[:50], x[of])
    assert (np.abs(guess - true) <= off).mean() > 0.999
    assert abs((guess - true).mean()) < 1
    bits = np.unpackbits(codes[of], axis=1)
    y = (x[of] - c.centres[near[0]]) @ c.rotation
    assert bits.shape == y.shape and ((bits == 1) == (y > 0)).all()
