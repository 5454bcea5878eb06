"""Language identification by a byte convolutional network.

Filters of several widths run over fixed windows of WINDOW bytes, each filter's maximum goes to a softmax layer. The network is trained here, in
numpy, on at most DOCS labelled documents a language (expected number; a hash of doc_id chooses) and WINDOWS windows from each, spread over its
whole text; a prediction covers every window of a text. All 256 byte values have weights of their own (0 is padding too); two neighbouring bytes index one table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, held_out, texts

WINDOW, WIDTHS, FILTERS, BYTES = 256, (2, 3, 4), 16, 256
DOCS, WINDOWS = 500, 4
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 7
#: Bytes of letters: A to Z, a to z, and all bytes of longer UTF-8 sequences.
LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(BYTES)])


def has_letter(text: str) -> bool:
    return bool(re.search("[A-Za-z]", text)) or any(map(str.isalpha, text))


def windows_of(data: bytes) -> np.ndarray:
    """The bytes of all windows, one after the other; the last one is padded with 0."""
    out = np.zeros(-(-len(data) // WINDOW) * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(-1, WINDOW)


@dataclass
class ByteConv:
    """Filters [width, byte, filter] for each width, their offsets, and the softmax layer over their maxima."""

    languages: list[str]
    filters: list[np.ndarray]
    offsets: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str]) -> ByteConv:
        r = np.random.default_rng(SEED)
        filters = [(r.standard_normal((w, BYTES, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[:, 0] = 0
        n = len(WIDTHS) * FILTERS
        return cls(languages, filters, np.zeros(n, np.float32), (r.standard_normal((n, len(languages))) * 0.1).astype(np.float32), np.zeros(len(languages), np.float32))

    def gradients(self, c: np.ndarray, want: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean cross entropy of windows c, and its gradients by filters, offsets, weights and bias; a filter's goes to the place of its maximum."""
        n, best, tops, f = len(c), [], [], np.arange(FILTERS)
        for w in self.filters:
            span = WINDOW - len(w) + 1
            conv = w[0][c[:, :span]]
            for k in range(1, len(w)):
                conv += w[k][c[:, k : k + span]]
            best.append(conv.argmax(1))
            tops.append(np.take_along_axis(conv, best[-1][:, None], 1)[:, 0])
        raw = np.concatenate(tops, 1) + self.offsets
        h = np.maximum(raw, 0)
        d = self._softmax(h @ self.weights + self.bias)
        loss = -float(np.log(d[np.arange(n), want] + 1e-30).mean())
        d[np.arange(n), want] -= 1
        d /= n
        back = (d @ self.weights.T) * (raw > 0)
        grads = []
        for i, w in enumerate(self.filters):
            g, own = np.zeros_like(w), back[:, i * FILTERS : (i + 1) * FILTERS]
            for k in range(len(w)):
                np.add.at(g[k], (c[np.arange(n)[:, None], best[i] + k], f), own)
            g[:, 0] = 0
            grads.append(g)
        return loss, [*grads, back.sum(0), h.T @ d, d.sum(0)]

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam on the cross entropy."""
        r = np.random.default_rng(SEED)
        params = [*self.filters, self.offsets, self.weights, self.bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = r.permutation(len(x))
            for at in range(0, len(x), BATCH):
                k = order[at : at + BATCH]
                t += 1
                for p, g, a, b in zip(params, self.gradients(x[k], y[k])[1], m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= (RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each width, what a pair of bytes adds at its start, and what the third byte or the second pair adds."""
        pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
        return [(pair(w[0], w[1]), None if len(w) == 2 else w[2] if len(w) == 3 else pair(w[2], w[3])) for w in self.filters]

    def log_probabilities(self, c: np.ndarray, tables: list, step: int = 256) -> np.ndarray:
        out = np.empty((len(c), len(self.languages)))
        for at in range(0, len(c), step):
            x = c[at : at + step]
            pairs, tops = x[:, :-1].astype(np.int64) * BYTES + x[:, 1:], []
            for w, (first, rest) in zip(WIDTHS, tables, strict=True):
                conv = np.take(first, pairs[:, : WINDOW - w + 1], 0)
                if w == 3:
                    conv += np.take(rest, x[:, 2:], 0)
                elif w == 4:
                    conv += np.take(rest, pairs[:, 2:], 0)
                tops.append(conv.max(1))
            z = np.maximum(np.concatenate(tops, 1) + self.offsets, 0) @ self.weights + self.bias
            out[at : at + step] = np.log(self._softmax(z.astype(np.float64)) + 1e-12)
        return out


def train(df: DataFrame, docs: int = DOCS) -> ByteConv | None:
    """A network for all languages of df's rows that may be learnt from; None if there are none."""
    known = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    count = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not count:
        return None
    names = sorted(count)
    share = df.sparkSession.createDataFrame([(k, min(1.0, docs / count[k])) for k in names], "lang string, share double")
    chosen = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    picked = chosen.select("doc_id", "text", "lang").limit(2 * docs * len(names))

    def run(batch: pa.RecordBatch):
        out = {"doc_id": [], "lang": [], "window": []}
        for doc, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), texts(batch), strict=True):
            w = windows_of(text.encode())
            for k in np.unique(np.linspace(0, max(0, len(w) - 2), WINDOWS).astype(int)):
                out["doc_id"].append(doc)
                out["lang"].append(lang)
                out["window"].append(w[k].tobytes())
        yield out

    rows = sorted(by_batches(picked, run, "doc_id long, lang string, window binary").collect())
    if not rows:
        return None
    net = ByteConv.new(names)
    net.train(np.frombuffer(b"".join(bytes(r.window) for r in rows), np.uint8).reshape(-1, WINDOW), np.array([names.index(r.lang) for r in rows]))
    return net


def predict(df: DataFrame, net: ByteConv | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row, and the columns keep (of other names).

    lang_pred is `und` with score 0 for texts that are null or have no letter, and for all if nothing could be learnt. Other texts get the language
    whose mean log-probability over their windows, weighted by the letters in each, is highest; the score is that language's share. Equal texts get equal
    predictions, of equal languages the first by name.
    """
    model = df.sparkSession.sparkContext.broadcast(net)
    made: dict = {}

    def run(batch: pa.RecordBatch):
        net = model.value
        x, names, scores, parts, spans, at = texts(batch), [], [], [], {}, 0
        if net:
            tables = made.get("tables") or made.setdefault("tables", net.tables())
            for i, t in enumerate(x):
                if has_letter(t):
                    parts.append(windows_of(t.encode()))
                    spans[i] = at, (at := at + len(parts[-1]))
        if parts:
            c = np.concatenate(parts)
            logs, weight = net.log_probabilities(c, tables), LETTER[c].sum(1) + 1e-3
        for i in range(len(x)):
            if i in spans:
                a, b = spans[i]
                p = net._softmax((weight[a:b] @ logs[a:b] / weight[a:b].sum())[None])[0]
                names.append(net.languages[int(p.argmax())])
                scores.append(float(p.max()))
            else:
                names.append("und")
                scores.append(0.0)
        yield {k: batch.column(k) for k in ("doc_id", "held_out", *keep)} | {"lang_pred": names, "score": scores}

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text", *(k for k in keep if k != "text"))
    kinds = "".join(f", `{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return by_batches(rows, run, f"doc_id long, held_out boolean{kinds}, lang_pred string, score double")


def identify(df: DataFrame) -> DataFrame:
    """Train on df and predict all of it."""
    return predict(df, train(df))
