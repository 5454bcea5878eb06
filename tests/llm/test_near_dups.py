"""Groups against brute force over all pairs, and the estimator against the exact similarity."""

import random

import numpy as np

from vertexloom.llm import near_dups
from vertexloom.llm.common import table
from vertexloom.llm.queries import QUERIES


def brute(rows):
    """Least id of each row's group, by exact similarity of all pairs of different texts."""
    sets = {t: s for t, s in zip({(x or "").lower() for _, x in rows}, near_dups.shingles(list({(x or "").lower() for _, x in rows})), strict=True)}
    names = [t for t in sets if len(sets[t][0])]
    up = {t: t for t in names}

    def root(t):
        while up[t] != t:
            t = up[t]
        return t

    holders = {}
    for t in names:
        for h in sets[t][0].tolist():
            holders.setdefault(h, []).append(t)
    seen = set()
    for near in holders.values():
        for i, a in enumerate(near):
            for b in near[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if near_dups.probability_jaccard(sets[a], sets[b]) >= 0.8:
                        up[root(a)] = root(b)
    least = {}
    for i, x in rows:
        t = (x or "").lower()
        if t in up and i is not None:
            least[root(t)] = min(least.get(root(t), i), i)
    out = []
    for i, x in rows:
        t = (x or "").lower()
        c = least.get(root(t), i) if t in up else i
        out.append((-1 if i is None else i, -1 if c is None else c))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id) for r in df.collect())


def test_cases(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    rows, doc = [], 1
    for _ in range(12):
        base = [word() for _ in range(rnd.choice([6, 30, 150, 400]))]
        for _ in range(rnd.randint(1, 12)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                w[rnd.randrange(len(w))] = word()
            rows.append((doc, " ".join(w)))
            doc += 1
    long = [word() for _ in range(20000)]
    rows += [(500, " ".join(long)), (501, " ".join(long[:-30])), (502, "A b"), (503, "a B"), (504, "a b c"), (505, ""), (506, None), (507, " \n"), (508, ""), (None, rows[0][1]), (509, "x " * 200), (510, "x " * 190), (511, "x"), (512, "x"), (512, "x")]
    df = spark.createDataFrame([(*r, 1, b"k") for r in rows], "doc_id long, text string, label int, key binary")
    assert got(near_dups.near_duplicates(df)) == brute(rows)
    assert near_dups.near_duplicates(df.limit(0)).collect() == []
    kept = near_dups.keep_one(df.withColumnRenamed("label", "gone"))
    assert kept.columns == ["doc_id", "text", "gone", "key"]
    want = {i for i, c in brute(rows) if i == c or i == -1}
    assert {-1 if r.doc_id is None else r.doc_id for r in kept.collect()} == want


def test_query_by_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, d, "documents").collect()]
    want = brute(rows)
    assert any(i != c for i, c in want)
    assert got(QUERIES["op2_near_duplicates"](spark, d)) == want


def test_crowd_about_the_threshold(spark):
    """Members that share bucket after bucket, some alike enough and some not."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    base, rows = [word() for _ in range(100)], []
    for k in range(60):
        w = list(base)
        for i in range(rnd.randint(0, 14)):
            w[(7 * i + k) % 100] = word()
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dups.near_duplicates(df)) == brute(rows)


def test_large_crowd_about_the_threshold(spark):
    """Thousands of copies of one template that share buckets and are mostly not alike enough; none of the links between them may depend on a centre."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(8))
    base, rows = [word() for _ in range(100)], []
    for k in range(3060):
        w = list(base)
        for i in rnd.sample(range(100), 2 if k < 3000 else 1):
            w[i] = word()
        rows.append((k, " ".join(w)))
    sets = [h for h, _ in near_dups.shingles([x for _, x in rows])]
    held, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = np.zeros((len(rows), int((n > 1).sum())), np.float32)
    r = np.repeat(np.arange(len(rows)), [len(s) for s in sets])
    own[r[n[col] > 1], (np.cumsum(n > 1) - 1)[col[n[col] > 1]]] = 1
    both, size = own @ own.T, np.array([len(s) for s in sets])
    label = np.arange(len(rows))
    for i, j in np.argwhere(np.triu(both / (size[:, None] + size - both) >= 0.8, 1)):
        if label[i] != label[j]:
            label[label == max(label[i], label[j])] = min(label[i], label[j])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert got(near_dups.near_duplicates(df)) == [(k, int(label[k])) for k in range(len(rows))]


def test_bound_of_the_blocks():
    rnd = np.random.default_rng(4)
    sets = [(np.sort(rnd.choice(60, n, replace=False)).astype(np.int64), rnd.integers(1, 6, n)) for n in rnd.integers(5, 60, 40)]
    every = np.arange(len(sets))
    high = near_dups.bounds(sets, every, every)
    exact = np.array([[near_dups.probability_jaccard(a, b) for b in sets] for a in sets])
    assert (high >= exact - 1e-5).all()
    ones = [(h, np.ones(len(h), np.int64)) for h, _ in sets]
    exact = np.array([[near_dups.probability_jaccard(a, b) for b in ones] for a in ones])
    assert np.abs(near_dups.bounds(ones, every, every) - exact).max() < 1e-5


def test_estimate():
    rnd = np.random.default_rng(1)
    a = (rnd.integers(0, 1 << 62, 400).astype(np.uint64), rnd.integers(1, 5, 400))
    b = (np.r_[a[0][:330], rnd.integers(0, 1 << 62, 50).astype(np.uint64)], np.r_[a[1][:300], rnd.integers(1, 5, 80)])
    z = near_dups.signatures([a, b], 4000)
    assert abs((z[0] == z[1]).mean() - near_dups.probability_jaccard(a, b)) < 0.03
    plain = sum(1 / sum(max(p / x, q / y) for p, q in zip(*[[dict(zip(m[0].tolist(), m[1].tolist(), strict=True)).get(e, 0) for e in {*a[0].tolist(), *b[0].tolist()}] for m in (a, b)], strict=True)) for x, y in [(dict(zip(a[0].tolist(), a[1].tolist(), strict=True)).get(e, 0), dict(zip(b[0].tolist(), b[1].tolist(), strict=True)).get(e, 0)) for e in {*a[0].tolist()} & {*b[0].tolist()}])
    assert abs(plain - near_dups.probability_jaccard(a, b)) < 1e-9
