"""A quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1, the unlabelled ones are any documents of the web table; labels 0 play no part. The risk
prior * E+[loss(f)] + max(0, E_u[loss(-f)] - prior * E+[loss(-f)]) is minimised, and where the part in brackets is negative its sign is turned, so that
it can't be driven below what a risk can be. The class prior is estimated from scores that tell positives from unlabelled documents: above any score, the unlabelled share is at
least prior times the positive share, and where no negative is left it is just that, so the prior is the least ratio of the two, with a margin for small samples. A slope and an
offset then turn the classifier's values into probabilities, by the convex unbiased risk of the same two samples, over values of documents that a fit hasn't seen. Features are
frequencies of pairs of byte classes and figures on words and lines, over whole texts. The fit uses at most POSITIVE and UNLABELLED rows, chosen by a hash.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, held_out, texts

POSITIVE, UNLABELLED = 3000, 6000
THRESHOLD, KINDS, EPOCHS, RATE, DECAY, SEED = 0.3, 32, 30, 0.02, 1e-4, 11
#: Parts of both samples that a fit leaves out in turn; least share of positives above a score whose ratio counts, and how sure its margin is to cover the truth.
FOLDS, LEAST, SURE = 4, 0.05, 0.9


def _kinds() -> np.ndarray:
    """Classes of bytes: lower-case letters in pairs, capitals, digits, blanks, line ends, the commoner marks each alone, other marks, control bytes, UTF-8 lead and continuation bytes."""
    out, marks = np.full(256, 30, np.uint8), ".,!?#$%&*|-'"
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = 29 if b >= 192 else 28
        elif "a" <= c <= "z":
            out[b] = (b - 97) // 2
        elif "A" <= c <= "Z":
            out[b] = 13
        elif c.isdigit():
            out[b] = 14
        elif c == " ":
            out[b] = 15
        elif c in marks:
            out[b] = 16 + marks.index(c) if marks.index(c) < 12 else 31
        elif c in "\n\r":
            out[b] = 31
        elif c.isprintable():
            out[b] = 27
    return out


KIND = _kinds()
FIGURES = 12


def features(text: str) -> np.ndarray:
    """Roots of the frequencies of pairs of classes, then figures on the whole text, all of about the same size."""
    raw = text.encode()
    k = KIND[np.frombuffer(raw, np.uint8)]
    out = np.zeros(KINDS * KINDS + FIGURES, np.float32)
    if len(k) > 1:
        out[: KINDS * KINDS] = np.sqrt(np.bincount(k[:-1].astype(np.int32) * KINDS + k[1:], minlength=KINDS * KINDS) / (len(k) - 1))
    if raw:
        words, lines, n = raw.split(), raw.split(b"\n"), len(raw)
        count, w, kinds = Counter(words), max(1, len(words)), np.bincount(k, minlength=KINDS) / n
        out[-FIGURES:] = (
            np.log1p(n) / 10, np.log1p(len(words)) / 10, len(count) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w, max(count.values(), default=0) / w,
            len(set(lines)) / len(lines), kinds[13], kinds[16:28].sum(), kinds[14], n / w / 20, np.log1p(max(map(len, words), default=0)) / 5, 1,
        )
    return out


@dataclass
class Classifier:
    """A linear function of features less shift; its value times slope plus offset is the logit of the score."""

    weights: np.ndarray
    shift: np.ndarray
    prior: float
    slope: float = 1.0
    offset: float = 0.0

    def value(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.shift) @ self.weights[:-1] + self.weights[-1]).astype(np.float64)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.value(x) + self.offset)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def non_negative_risk(w: np.ndarray, a: np.ndarray, b: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """Of rows a of positives and b of unlabelled documents under the logistic loss: the positives' part of the risk, the negatives', and the gradient to follow."""
    za, zb = a @ w, b @ w
    positive, negative = prior * np.logaddexp(0, -za).mean(), np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean()
    from_negative = b.T @ _sigmoid(zb) / len(b) - prior * (a.T @ _sigmoid(za)) / len(a)
    return positive, negative, -from_negative if negative < 0 else from_negative - prior * (a.T @ _sigmoid(-za)) / len(a)


def apart(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
    """The logistic risk of telling rows a from rows b, which count alike, and its gradient."""
    za, zb = a @ w, b @ w
    return np.logaddexp(0, -za).mean() + np.logaddexp(0, zb).mean(), b.T @ _sigmoid(zb) / len(b) - a.T @ _sigmoid(-za) / len(a)


def _descend(p: np.ndarray, u: np.ndarray, w: np.ndarray, gradient, epochs: int) -> np.ndarray:
    """Adam on batches of both samples."""
    r, m, v, t, steps = np.random.default_rng(SEED), 0.0, 0.0, 0, max(1, len(u) // 256)
    for _ in range(epochs):
        for pi, ui in zip(np.array_split(r.permutation(max(len(p), steps)) % len(p), steps), np.array_split(r.permutation(max(len(u), steps)) % len(u), steps), strict=True):
            g = gradient(w, p[pi], u[ui])
            g[:-1] += DECAY * w[:-1]
            t += 1
            m, v = m + 0.1 * (g - m), v + 0.001 * (g * g - v)
            w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _ones(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return np.hstack([x - shift, np.ones((len(x), 1), np.float32)])


def non_negative_fit(pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = EPOCHS) -> Classifier:
    """Minimise the non-negative unbiased risk of a linear function."""
    shift = unl.mean(0)
    start = np.r_[np.zeros(pos.shape[1]), np.log(prior / (1 - prior))]
    return Classifier(_descend(_ones(pos, shift), _ones(unl, shift), start, lambda w, a, b: non_negative_risk(w, a, b, prior)[2], epochs), shift, prior)


def _left_out(pos: np.ndarray, unl: np.ndarray, fit) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows, each from a fit on the folds it isn't in."""
    r = np.random.default_rng(SEED)
    of_pos, of_unl = r.permutation(len(pos)) % FOLDS, r.permutation(len(unl)) % FOLDS
    a, b = np.zeros(len(pos)), np.zeros(len(unl))
    for k in range(FOLDS):
        rest = pos[of_pos != k], unl[of_unl != k]
        model = fit(*(x if len(x) else y for x, y in zip(rest, (pos, unl), strict=True)))
        a[of_pos == k], b[of_unl == k] = model.value(pos[of_pos == k]), model.value(unl[of_unl == k])
    return a, b


def estimate_prior(pos: np.ndarray, unl: np.ndarray, epochs: int = EPOCHS // 2) -> float:
    """The share of positives among the unlabelled rows, from a classifier that tells the samples apart."""

    def fit(p: np.ndarray, u: np.ndarray) -> Classifier:
        shift = u.mean(0)
        return Classifier(_descend(_ones(p, shift), _ones(u, shift), np.zeros(p.shape[1] + 1), lambda w, a, b: apart(w, a, b)[1], epochs), shift, 0.5)

    a, b = _left_out(pos, unl, fit)
    at = np.r_[-np.inf, np.sort(np.r_[a, b])]
    above = lambda x: 1 - np.searchsorted(np.sort(x), at, "left") / len(x)
    p, u = above(a), above(b)
    margin = sum(np.sqrt(np.log(4 / (1 - SURE)) / 2 / len(x)) for x in (a, b))
    k = np.where(p >= LEAST, (u + margin) / np.maximum(p, LEAST), np.inf).argmin()
    return float(np.clip(u[k] / p[k], 0.01, 0.99))


def unbiased_risk(line: np.ndarray, pos: np.ndarray, unl: np.ndarray, prior: float, ridge: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """The unbiased risk of slope * value + offset under the logistic loss, which is convex, with its gradient and second derivatives; values come standardised."""
    x = np.c_[unl, np.ones(len(unl))]
    z, want = x @ line, prior * np.array([pos.mean(), 1.0])
    s, hold = _sigmoid(z), ridge * np.array([line[0], 0])
    return float(np.logaddexp(0, z).mean() - want @ line + ridge * line[0] ** 2 / 2), x.T @ s / len(x) - want + hold, (x * (s * (1 - s))[:, None]).T @ x / len(x) + np.diag([ridge, 1e-9])


def calibrate(pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of least unbiased risk, by Newton steps of bounded length."""
    middle, wide = unl.mean(), unl.std() + 1e-9
    line = np.array([1.0, np.log(prior / (1 - prior))])
    for _ in range(200):
        _, g, h = unbiased_risk(line, (pos - middle) / wide, (unl - middle) / wide, prior)
        step = np.linalg.solve(h, g)
        size = np.linalg.norm(step)
        line = line - step * min(1.0, 2 / max(size, 1e-12))
        if size < 1e-9:
            break
    slope = max(line[0], 1e-3)  # the order of values stays
    return float(slope / wide), float(line[1] - slope * middle / wide)


def fit(pos: np.ndarray, unl: np.ndarray) -> Classifier:
    """Prior, classifier and calibration from features of positives and of unlabelled rows."""
    prior = estimate_prior(pos, unl)
    slope, offset = calibrate(*_left_out(pos, unl, lambda p, u: non_negative_fit(p, u, prior)), prior)
    model = non_negative_fit(pos, unl, prior)
    return replace(model, slope=slope, offset=offset)


def _collect(df: DataFrame) -> np.ndarray:
    def run(batch: pa.RecordBatch):
        yield {"doc_id": batch.column("doc_id"), "x": [features(t).astype(np.float16).tobytes() for t in texts(batch)]}

    rows = sorted(by_batches(df.select("doc_id", "text"), run, "doc_id long, x binary").collect())
    return np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float16).reshape(len(rows), -1).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, unlabelled: int = UNLABELLED) -> Classifier | None:
    """None if there is no positive document to learn from. A document that is labelled both 0 and 1 isn't a trusted positive."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held_out(F.col("doc_id")))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where("quality = 1")
    good, total = known.count(), docs.count()
    if not good or not total:
        return None
    by_hash = lambda most, of, *cols: F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) < int(min(1.0, most / of) * (1 << 30))
    picked = known.where(by_hash(positive, good, "doc_id")).select("doc_id").limit(2 * positive)  # so few rows may be broadcast
    pos = _collect(docs.join(F.broadcast(picked), "doc_id").limit(4 * positive))
    unl = _collect(docs.where(by_hash(unlabelled, total, F.lit(SEED), "doc_id", "text")).limit(2 * unlabelled))
    if not len(pos) or not len(unl):
        return None
    return fit(pos, unl)


def score(docs: DataFrame, model: Classifier | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold, else 0) of every row.

    Null and empty texts have the features of an empty text. Without a model every score is 0.5. Equal texts get equal scores; further columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        x, model = texts(batch), sent.value
        s = [float(model.score(features(t)[None])[0]) if model else 0.5 for t in x]  # one by one, so that equal texts have equal sums
        yield {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": [int(v >= threshold) for v in s]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return by_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")
