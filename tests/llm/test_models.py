"""Held-out accuracy of the two models, and their behaviour on odd rows."""

import numpy as np
from pyspark.sql import functions as F

from vertexloom.llm import language, quality
from vertexloom.llm.common import table
from vertexloom.llm.queries import QUERIES

D = "/root/testdata/sf0.01"
ODD = [(None, "the thing", "en"), (1, None, "en"), (2, "", None), (3, "12 + 3!", "en"), (4, "the of and " * 30000, None), (4, "der und die", "de"), (4, "der und die", "de"), (5, "日本", "x")]


def test_language_accuracy(spark):
    docs = table(spark, D, "documents")
    r = QUERIES["op3_language_id"](spark, D).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = r.agg(F.count("*"), F.count(F.when(F.col("lang") == F.col("lang_pred"), 1))).first()
    assert n > 100 and right / n > 0.95
    assert QUERIES["op3_language_id"](spark, D).count() == docs.count()


def test_language_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "z", 0.5) for r in ODD], "doc_id long, text string, lang string, lang_pred string, score double")
    net = language.train(table(spark, D, "documents"))
    rows = language.predict(docs, net).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: r for r in rows}
    assert got[None].lang_pred == "en" and got[None].held_out
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3))
    assert {r.lang_pred for r in rows if r.doc_id == 5} <= set(net.languages)
    assert all(0 <= r.score <= 1 for r in rows)
    assert language.identify(docs).count() == len(ODD)
    assert language.identify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_tables_equal_plain_convolution():
    net = language.ByteConv.new(["a", "b"])
    c = np.random.default_rng(1).integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    tops = []
    for w in net.filters:
        conv = np.stack([sum(w[k][c[:, i + k]] for k in range(len(w))) for i in range(language.WINDOW - len(w) + 1)], 1)
        tops.append(conv.max(1))
    z = np.maximum(np.concatenate(tops, 1), 0) @ net.weights + net.bias
    assert np.allclose(net.log_probabilities(c, net.tables()), np.log(net._softmax(z)), atol=1e-5)


def test_gradients_of_the_network():
    """Against finite differences, in double precision."""
    r, net = np.random.default_rng(2), language.ByteConv.new(["a", "b", "c"])
    net.filters = [w.astype(float) for w in net.filters]
    net.offsets, net.weights, net.bias = net.offsets.astype(float) + 0.1, net.weights.astype(float), net.bias.astype(float)
    c, want = r.integers(0, 256, (4, language.WINDOW)).astype(np.uint8), np.array([0, 2, 1, 2])
    grads = net.gradients(c, want)[1]
    for p, g in zip([*net.filters, net.offsets, net.weights, net.bias], grads, strict=True):
        places = np.argsort(-np.abs(g).ravel())[:5].tolist() + r.integers(0, g.size, 5).tolist()
        for k in places:
            at = np.unravel_index(k, g.shape)
            if g.ndim == 3 and at[1] == 0:
                continue  # padding has no weight
            was, side = p[at], []
            for step in (1e-6, -1e-6):
                p[at] = was + step
                side.append(net.gradients(c, want)[0])
            p[at] = was
            assert abs((side[0] - side[1]) / 2e-6 - g[at]) < 1e-6


def test_language_query_against_plain_loops(spark):
    """The registered query's rows, from the same trained network but window by window and place by place."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    net = language.train(docs)
    got = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, "/root/testdata/sf0.001").collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in sorted(rows, key=lambda r: len(r.text or ""))[::25]:
        if not r.text or not any(map(str.isalpha, r.text)):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        data, total, weights = r.text.encode(), np.zeros(len(net.languages)), 0.0
        for at in range(0, len(data), language.WINDOW):
            x = data[at : at + language.WINDOW].ljust(language.WINDOW, b"\0")
            h = []
            for i, w in enumerate(net.filters):
                for f in range(language.FILTERS):
                    h.append(max(sum(float(w[k, x[p + k], f]) for k in range(len(w))) for p in range(language.WINDOW - len(w) + 1)) + float(net.offsets[i * language.FILTERS + f]))
            z = np.maximum(h, 0) @ net.weights.astype(float) + net.bias
            share = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            letters = sum(b >= 128 or chr(b).isalpha() for b in x) + 1e-3
            total, weights = total + letters * np.log(share + 1e-12), weights + letters
        p = np.exp(total / weights - (total / weights).max())
        p /= p.sum()
        assert got[r.doc_id].lang_pred == net.languages[int(p.argmax())] and abs(got[r.doc_id].score - p.max()) < 1e-4


def test_more_than_256_languages(spark):
    rows = [(10 * k + j, f"w{k} " * 20, f"l{k}") for k in range(300) for j in range(3)]
    net = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), docs=2)
    assert len(net.languages) > 256


def test_quality_held_out(spark):
    rows = QUERIES["op10_quality"](spark, D).join(table(spark, D, "labels"), "doc_id").where("held_out").collect()
    s, y = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    auc = (s[y == 1][:, None] > s[y == 0]).mean() + (s[y == 1][:, None] == s[y == 0]).mean() / 2
    right = ((s >= 0.3) == y).mean()
    print(auc, right)
    assert auc > 0.9 and right > 0.9
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ODD], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 1), (5, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs.limit(0), model).collect() == []
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}


def test_risks_and_gradients():
    """Against plain loops and finite differences."""
    r = np.random.default_rng(3)
    a, b, w = r.normal(0.5, 1, (7, 4)), r.normal(0, 1, (9, 4)), r.normal(0, 1, 4)
    loss = lambda z: float(np.log(1 + np.exp(-z)))
    for prior in (0.3, 0.9):
        positive, negative, g = quality.non_negative_risk(w, a, b, prior)
        want = prior * sum(loss(x @ w) for x in a) / 7, sum(loss(-(x @ w)) for x in b) / 9 - prior * sum(loss(-(x @ w)) for x in a) / 7
        assert np.allclose((positive, negative), want)
        for k in range(4):
            e = np.eye(4)[k] * 1e-6
            up, down = quality.non_negative_risk(w + e, a, b, prior), quality.non_negative_risk(w - e, a, b, prior)
            side = lambda x: x[0] + x[1] if negative >= 0 else -x[1]
            assert abs((side(up) - side(down)) / 2e-6 - g[k]) < 1e-6
    for risk, at in ((lambda v: quality.apart(v, a, b), w), (lambda v: quality.unbiased_risk(v, a[:, 0], b[:, 0], 0.4), np.array([0.7, -0.2]))):
        for k in range(len(at)):
            e = np.eye(len(at))[k] * 1e-6
            assert abs((risk(at + e)[0] - risk(at - e)[0]) / 2e-6 - risk(at)[1][k]) < 1e-6


def test_prior_and_calibration():
    """The prior is found from positives and unlabelled rows alone, and so are probabilities."""
    r = np.random.default_rng(4)
    for prior in (0.2, 0.5, 0.85):
        good = r.normal(1.2, 1, (6000, 6)).astype("f4")
        bad = r.normal(-1.2, 1, (6000, 6)).astype("f4")
        unl = np.vstack([good[2000 : 2000 + int(4000 * prior)], bad[: int(4000 * (1 - prior))]])
        model = quality.fit(good[:2000], unl)
        assert abs(model.prior - prior) < 0.05
        p, n = model.score(good[5400:]), model.score(bad[5400:])
        assert (p >= 0.3).mean() > 0.97 and (n >= 0.3).mean() < 0.06 and abs(model.score(unl).mean() - prior) < 0.06


def test_quality_query_against_plain_loops(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    model = quality.train(docs, table(spark, d, "labels"))
    got = {r.doc_id: r for r in QUERIES["op10_quality"](spark, d).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows[::10]:
        raw = (r.text or "").encode()
        pairs, x = {}, np.zeros(quality.KINDS**2 + quality.FIGURES)
        for p, q in zip(raw, raw[1:], strict=False):
            k = int(quality.KIND[p]) * quality.KINDS + int(quality.KIND[q])
            pairs[k] = pairs.get(k, 0) + 1
        for k, n in pairs.items():
            x[k] = (n / (len(raw) - 1)) ** 0.5
        x[-quality.FIGURES :] = quality.features(r.text or "")[-quality.FIGURES :]
        z = sum(float(a - s) * float(w) for a, s, w in zip(x, model.shift, model.weights, strict=False)) + model.weights[-1]
        p = 1 / (1 + np.exp(-(model.slope * z + model.offset)))
        assert abs(got[r.doc_id].score - p) < 1e-3 and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)


def test_risk_never_counts_below_zero():
    r = np.random.default_rng(4)
    pos, neg = r.normal(1, 1, (300, 5)).astype("f4"), r.normal(-1, 1, (300, 5)).astype("f4")
    m = quality.non_negative_fit(pos[:150], np.vstack([pos[150:], neg]), 1 / 3)
    assert m.score(pos).mean() > 0.8 and m.score(neg).mean() < 0.2
