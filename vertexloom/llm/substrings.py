"""Removal of repeated passages, by seed and extend on winnowed anchors.

Seeds: the least hash of the runs of SEED words in a window of LENGTH words is the window's anchor. Equal windows have equal anchors, so two documents that
share a passage of LENGTH words share an anchor; joining on anchors leaves only the documents and places where that can be. Extension: from a shared anchor, a
match reaches both ways over the windows that chose it; a window extends the match if a document with a smaller id has the same words, which is settled by a
minimum per window, not by pairs of documents, so a passage in n documents costs n rows. The joined windows are the maximal repeats. Of documents with equal
texts only the one with the least id goes through this; the others repeat it as a whole. Aggregates combine before each shuffle, and what follows them are joins
that Spark can split where a key is frequent. What each step finds is written before the next, so its shuffle files can go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, cut, sized, texts
from .words import Block, blocks, rolling_minimum, run_hashes

#: Words of a window (the least length of a repeat) and of a seed.
LENGTH, SEED = 13, 5


def words_of(text: str) -> list[bytes]:
    """Runs of other characters than space and U+0009 to U+000D."""
    return text.encode().split()


def anchors(block: Block, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The places of the windows that lie in one text, and the anchor of each."""
    places = np.flatnonzero(block.inside(length))
    return places, rolling_minimum(run_hashes(block.hashes, seed), length - seed + 1)[places]


def _covered(places: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of n words the windows that start at these places cover."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, places, 1)
    np.add.at(step, np.minimum(places + length, n), -1)
    return np.cumsum(step[:-1]) > 0


def _keyed(df: DataFrame) -> DataFrame:
    """df with __id and __hash; __hash tells texts with the same id apart."""
    return df.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__hash", F.xxhash64("text"))


def _low(hashes: list[int]) -> np.ndarray:
    return np.array(hashes, np.int64) << 32


def repeated_windows(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """__id, __copy and __places (array<long>) of the documents (of _keyed()) that repeat something of one with a smaller id.

    __copy is true if the whole text is such a one's text (then __places is null); else the low 32 bits of a place are the first word of a repeated window, the high
    ones the low ones of __hash: rows that share an id but not a text share a list.
    """
    ids = docs.where(F.col("__id").isNotNull() & F.col("text").isNotNull())

    def seeds(batch: pa.RecordBatch):
        ids, runs, known = [], [], batch.column("__id").to_numpy(zero_copy_only=False)
        for block in blocks(texts(batch)):
            places, found = anchors(block, length, seed)
            if len(places):
                doc = block.text_of(places)
                fresh = np.r_[True, (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])]
                found, doc = found[fresh], doc[fresh]
                edge = np.r_[0, np.flatnonzero(np.diff(doc)) + 1, len(doc)]
                for a, b in zip(edge, edge[1:], strict=False):
                    own = np.unique(found[a:b])  # once for each text: what a text has twice isn't shared
                    runs.append(own.view(np.int64))
                    ids.append(np.full(len(own), known[doc[a]]))
        if runs:
            yield {"seed": pa.array(np.concatenate(runs)), "__id": pa.array(np.concatenate(ids))}

    found = by_batches(ids.select("__id", "text"), seeds, "seed long, __id long")
    shared = found.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    shared = cut(shared)  # read from a table, it leaves Spark free to split frequent seeds in the join
    marked = cut(found.join(shared, "seed").groupBy("__id").agg(F.collect_set("seed").alias("__seeds")), shared)

    whole = ids.select("__id", F.unhex(F.md5("text")).alias("md5"))
    firsts = cut(whole.groupBy("md5").agg(F.min("__id").alias("first"), F.max("__id").alias("last")).where(F.col("first") < F.col("last")).drop("last"))
    several = whole.groupBy("__id").agg(F.min("md5").alias("a"), F.max("md5").alias("b")).where(F.col("a") < F.col("b"))
    # a broadcast, or a join whose frequent digests Spark can split
    copies = whole.join(sized(firsts), "md5").where(F.col("first") < F.col("__id")).groupBy("__id").agg(F.lit(True).alias("__copy")).join(several, "__id", "left_anti")
    copies = cut(copies, firsts)

    def extend(batch: pa.RecordBatch):
        out = {k: [] for k in ("w1", "w2", "__id", "place")}
        ids, high, known = batch.column("__id").to_numpy(zero_copy_only=False), _low(batch.column("__hash").to_pylist()), batch.column("__seeds")
        for block in blocks(texts(batch)):
            places, found = anchors(block, length, seed)
            if not len(places):
                continue
            doc = block.text_of(places)
            keep, edge = np.zeros(len(places), bool), np.r_[0, np.flatnonzero(np.diff(doc)) + 1, len(doc)]
            for a, b in zip(edge, edge[1:], strict=False):
                keep[a:b] = np.isin(found[a:b], known[int(doc[a])].values.to_numpy(zero_copy_only=False).view(np.uint64))
            places, doc = places[keep], doc[keep]
            if len(places):
                out["w1"].append(run_hashes(block.hashes, length, 1)[places].view(np.int64))
                out["w2"].append((run_hashes(block.hashes, length, 2)[places] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                out["__id"].append(ids[doc])
                out["place"].append(high[doc] | (places - block.bounds[doc - block.first]))
        if out["w1"]:
            yield {k: pa.array(np.concatenate(x)) for k, x in out.items()}

    near = docs.select("__id", "__hash", "text").join(marked.join(copies, "__id", "left_anti"), "__id")
    windows = by_batches(near, extend, "w1 long, w2 int, __id long, place long")
    first = windows.groupBy("w1", "w2").agg(F.min("__id").alias("first"), F.max("__id").alias("last")).where(F.col("first") < F.col("last")).drop("last")
    first = cut(first)
    again = windows.join(first, ["w1", "w2"]).where(F.col("first") < F.col("__id")).groupBy("__id").agg(F.collect_set("place").alias("__places"))
    return cut(again.join(copies, "__id", "full"), marked, copies, first)


def _joined(df: DataFrame, length: int, seed: int) -> DataFrame:
    """df's columns, __id, __hash, and what repeated_windows() has. Where an id stands for several texts, none counts as a copy as a whole."""
    docs = _keyed(df)
    return docs.join(repeated_windows(docs, length, seed), "__id", "left")


def _gone(batch: pa.RecordBatch, length: int) -> list[tuple[list[bytes], np.ndarray | None]]:
    """The words of each text, and which of them go (None: none)."""
    out = []
    for text, key, copy, places in zip(texts(batch), batch.column("__hash").to_pylist(), batch.column("__copy").to_pylist(), batch.column("__places"), strict=True):
        words, gone = words_of(text), None
        if copy:
            gone = np.full(len(words), len(words) >= length)
        elif places.is_valid:
            p = places.values.to_numpy(zero_copy_only=False)
            p = p[p >> 32 == (_low([key])[0] >> 32)] & 0xFFFFFFFF
            gone = _covered(p, len(words), length)
        out.append((words, gone))
    return out


def _kept(words: list[bytes], gone: np.ndarray | None) -> list[bytes]:
    return words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def maximal_repeats(df: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, start, end (in words, end exclusive): the passages that removal takes from a document, each as long as repeated windows join up."""

    def run(batch: pa.RecordBatch):
        out = {"doc_id": [], "start": [], "end": []}
        for doc, (_, gone) in zip(batch.column("__id").to_pylist(), _gone(batch, length), strict=True):
            edge = np.flatnonzero(np.diff((np.zeros(1) if gone is None else gone).astype(np.int8), prepend=0, append=0))
            out["doc_id"] += [doc] * (len(edge) // 2)
            out["start"] += edge[::2].tolist()
            out["end"] += edge[1::2].tolist()
        yield out

    return by_batches(_joined(df, length, seed), run, "doc_id long, start long, end long")


def digest(df: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    A null or empty text has no words and the digest of nothing. Rows with the same doc_id don't count as sources of one another, so equal rows fare alike;
    a row without doc_id keeps all words and is no source. Further columns are not read.
    """

    def run(batch: pa.RecordBatch):
        n, kept, sha = [], [], []
        for words, gone in _gone(batch, length):
            n.append(len(words))
            kept.append(0 if gone is None else int(gone.sum()))
            sha.append(hashlib.sha256(b" ".join(_kept(words, gone))).hexdigest())
        yield {"doc_id": batch.column("__id"), "n_words": n, "n_removed": kept, "kept_sha256": sha}

    return by_batches(_joined(df.select("doc_id", "text"), length, seed), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(df: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """df with the kept words of text, joined by one space; a text from which nothing goes, or that is null, stays as it is. Columns and rows stay, whatever the columns' names."""
    names = [f.name for f in df.schema]

    def run(batch: pa.RecordBatch):
        out = [x if gone is None or not gone.any() else b" ".join(_kept(words, gone)).decode() for x, (words, gone) in zip(batch.column("text").to_pylist(), _gone(batch, length), strict=True)]
        yield dict(zip(names, batch.column("row").flatten(), strict=True)) | {"text": out}

    rows = df.select("doc_id", "text", F.struct(*(F.col(f"`{k}`") for k in names)).alias("row"))
    return by_batches(_joined(rows, length, seed), run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))


#: DuckDB SQL for digest() over the table documents.
ORACLE = r"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + 12] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
r AS (SELECT g.doc_id, list_distinct(flatten(list(range(g.i, g.i + 13)))) AS gone FROM g JOIN f USING (g) WHERE f.first < g.doc_id GROUP BY g.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [x[1] FOR x IN list_zip(w, range(1, len(w) + 1)) IF NOT list_contains(gone, x[2])] END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
