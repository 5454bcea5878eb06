"""Nearest neighbours by randomly rotated one-bit codes in inverted lists.

Each vector belongs to the list of its nearest centre. Its residual from there, rotated at random, is kept as one bit per dimension, with its length and the inner product
of the unit residual with its code; all vectors are coded once, into a written table. From packed bits and these scalars alone, the inner product of a query with a vector
is estimated, with an error that they bound; only vectors whose bound on the distance beats the tenth best found so far are held against the query on the original numbers.

Queries probe lists in two rounds: first a few whose centres are nearest, which gives a distance that the ten nearest don't exceed, then all others that can hold a vector
within that distance, by the triangle inequality over centre and greatest residual. Probes and vectors meet in groups of one list; large lists and crowds of queries are
dealt into lots of bounded size. Neither queries nor vectors pass the driver, only the sample that centres are fitted on and a row of figures for each list.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batches, cut

#: Vectors that centres are fitted on, in all; a list for so many of them at least; most lists of a dimension; width of the error bound in deviations.
SAMPLE, LEAST, LISTS, WIDTH, SEED = 32_768, 16, 1024, 3.5, 5
#: Lists of the first round; vectors and queries of a group; vectors that are estimated, and pairs that are held against each other, at a time.
FIRST, VECTORS, QUERIES, STEP, PAIRS = 8, 16_384, 4096, 512, 1 << 16
#: The most frequent dimensions, which are searched by codes; vectors of all others are joined by their dimension.
DIMS = 64


@dataclass
class Coder:
    """A rotation of dimensions padded to whole bytes, and centres."""

    rotation: np.ndarray
    centres: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Coder:
        """Centres by k-means over the sample, as many as it allows; without one, the origin."""
        r, dim = np.random.default_rng(SEED), sample.shape[1]
        wide = -(-dim // 8) * 8
        q = np.linalg.qr(r.standard_normal((wide, wide)))[0][:dim]
        c = sample[r.permutation(len(sample))[: max(1, min(lists, len(sample) // LEAST))]] if len(sample) else np.zeros((1, dim))
        for _ in range(8 if len(sample) else 0):
            near = _squares(sample, c).argmin(1)
            order = np.argsort(near, kind="stable")
            some, first = np.unique(near[order], return_index=True)
            c = c.copy()
            c[some] = np.add.reduceat(sample[order], first) / np.bincount(near, minlength=len(c))[some, None]
        return cls(q, c)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each vector: its list, the packed signs of its rotated residual, the residual's length, and <unit residual, code>."""
        near = _squares(x, self.centres).argmin(1)
        y = (x - self.centres[near]) @ self.rotation
        size = np.linalg.norm(y, axis=1)
        along = np.abs(y).sum(1) / np.sqrt(y.shape[1]) / np.where(size > 0, size, 1)
        return near, np.packbits(y > 0, axis=1), size, np.where(size > 0, along, 1)

    def estimate(self, queries: np.ndarray, place: int, codes: np.ndarray, sizes: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates [query, vector] of the squared distances to vectors of a list, and how far off they may be."""
        y = ((queries - self.centres[place]) @ self.rotation).astype(np.float32)
        dim, own = y.shape[1], np.linalg.norm(y, axis=1)
        signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
        dot = y @ signs.T / np.float32(np.sqrt(dim))
        off = 2 * WIDTH * sizes * np.sqrt(np.maximum(1 - along**2, 0) / max(1, dim - 1)) / along
        return own[:, None] ** 2 + sizes**2 - 2 * dot * (sizes / along), own[:, None] * off + 1e-5 * (own[:, None] + sizes) ** 2


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Distances of rows, summed dimension by dimension in double precision."""
    total = np.zeros(len(queries))
    for k in range(queries.shape[1]):
        d = queries[:, k] - vectors[:, k]
        total += d * d
    return np.sqrt(total)


class Search:
    """The k best found so far for each of some queries, of which none is further than its bound."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int):
        self.ids, self.queries, self.bound, self.k = ids, queries, bound, k
        self.score, self.found = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def scan(self, coder: Coder, place: int, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, sizes: np.ndarray, along: np.ndarray) -> None:
        """Vectors x of one list."""
        for at in range(0, len(ids), STEP):
            k = slice(at, at + STEP)
            guess, off = coder.estimate(self.queries, place, codes[k], sizes[k], along[k])
            # the k-th least upper bound of this step's ids is a bound too, one more being the query itself
            high = _by_id(ids[k], guess + off)
            high = np.partition(high, self.k, 1)[:, self.k] if high.shape[1] > self.k else np.full(len(guess), np.inf)
            worst = np.minimum(np.minimum(self.score[:, -1], self.bound) ** 2, np.maximum(high, 0)) * (1 + 1e-9)
            q, r = np.nonzero(guess - off <= worst[:, None])
            for a in range(0, len(q), PAIRS):
                self._rerank(q[a : a + PAIRS], ids[k][r[a : a + PAIRS]], x[k][r[a : a + PAIRS]])

    def _rerank(self, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        score = exact(self.queries[q], x)
        better = (self.ids[q] != ids) & (score <= self.score[q, -1])
        old, place = np.nonzero(np.isfinite(self.score))
        q, ids, score = np.r_[old, q[better]], np.r_[self.found[old, place], ids[better]], np.r_[self.score[old, place], score[better]]
        order = np.lexsort((score, ids, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.r_[True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])][: len(q)]  # of rows with the same id the nearest
        q, ids, score = q[first], ids[first], score[first]
        order = np.lexsort((ids, score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, np.arange(len(self.ids)))[q]
        top = rank < self.k
        self.score[q[top], rank[top]], self.found[q[top], rank[top]] = score[top], ids[top]


def _by_id(ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The least value [query, id] of each id's columns."""
    order = np.argsort(ids, kind="stable")
    own = ids[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return values if len(first) == len(ids) else np.minimum.reduceat(values[:, order], first, axis=1)


def valid(df: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the vectors that take part: not null or empty, all finite, not all zero, and with an id."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    return rows.where(F.coalesce(finite & some, F.lit(False)))


def _matrix(column: pa.ListArray | pa.ChunkedArray, dim: int) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_dim(column: pa.ListArray) -> list[tuple[int, np.ndarray]]:
    """Each length of the column's lists, and the places that have it."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    return [(int(d), np.flatnonzero(n == d)) for d in np.unique(n)]


def _coders(rows: DataFrame) -> tuple[dict[int, Coder], list[int]]:
    """A coder for each of the most frequent dimensions, and these dimensions."""
    count = {r.n: r["count"] for r in rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(DIMS).collect()}
    if not count:
        return {}, []
    rate = min(1.0, SAMPLE / sum(count.values()))
    some = rows.where(F.size("embedding").isin(list(count)) & (F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 20)) < int((1 << 20) * rate))).select("embedding").limit(2 * SAMPLE)
    sample = sorted(r[0] for r in some.collect())
    of = {d: np.array([x for x in sample if len(x) == d], float).reshape(-1, d) for d in count}
    return {d: Coder.fit(of[d], min(LISTS, max(1, round(n**0.5 / 4)))) for d, n in count.items()}, list(count)


def encode(rows: DataFrame, coders: Broadcast) -> DataFrame:
    """dim, list, slot (a number that deals a list's vectors), vec_id, code, size, along and embedding of rows of valid() whose dimension has a coder."""

    def run(batch: pa.RecordBatch):
        for dim, at in _by_dim(batch.column("embedding")):
            part = batch.take(pa.array(at))
            near, codes, size, along = coders.value[dim].encode(_matrix(part.column("embedding"), dim))
            yield {"dim": [dim] * len(at), "list": near, "slot": np.arange(len(at)), "vec_id": part.column("vec_id"), "code": [c.tobytes() for c in codes], "size": size, "along": along, "embedding": part.column("embedding")}

    return by_batches(rows, run, "dim int, list int, slot int, vec_id long, code binary, size double, along double, embedding array<double>")


def _probes(queries: DataFrame, coders: Broadcast, far: dict[tuple[int, int], float] | None) -> DataFrame:
    """dim, list, query_id, own and bound of each list that a query probes: the FIRST nearest, or (far: greatest residual of each list) the others that can hold something within bound."""

    def run(batch: pa.RecordBatch):
        for dim, at in _by_dim(batch.column("own")):
            part = batch.take(pa.array(at))
            d = np.sqrt(_squares(_matrix(part.column("own"), dim), coders.value[dim].centres))
            first = np.zeros(d.shape, bool)
            np.put_along_axis(first, np.argsort(d, axis=1, kind="stable")[:, :FIRST], True, 1)
            if far is not None:
                size = np.array([far.get((dim, c), -np.inf) for c in range(d.shape[1])])  # an empty list holds nothing
                first = ~first & (d * (1 - 1e-9) - size <= part.column("bound").to_numpy()[:, None])
            q, c = np.nonzero(first)
            yield {"dim": [dim] * len(q), "list": c, **{k: part.column(k).take(pa.array(q)) for k in ("query_id", "own", "bound")}}

    return by_batches(queries, run, "dim int, list int, query_id long, own array<double>, bound double")


def _meet(index: DataFrame, probes: DataFrame, sizes: dict[tuple[int, int], int], coders: Broadcast, k: int) -> DataFrame:
    """query_id, vec_id and score of the best k of each group of probes and vectors of a list."""
    spark = index.sparkSession
    asked = {(r.dim, r.list): r.n for r in probes.groupBy("dim", "list").agg(F.count("*").alias("n")).collect()}  # a row a list
    plan = spark.createDataFrame([(d, c, -(-sizes[d, c] // VECTORS), -(-n // QUERIES)) for (d, c), n in asked.items() if (d, c) in sizes], "dim int, list int, lots int, crowds int")
    lots = F.broadcast(plan)  # at most LISTS rows a dimension
    key = ["dim", "list", "lot", "crowd"]
    left = index.join(lots, ["dim", "list"]).withColumn("lot", F.pmod(F.xxhash64("slot", "vec_id"), "lots")).withColumn("crowd", F.explode(F.expr("sequence(0L, crowds - 1L)")))
    right = probes.join(lots, ["dim", "list"]).withColumn("crowd", F.pmod(F.xxhash64("query_id"), "crowds")).withColumn("lot", F.explode(F.expr("sequence(0L, lots - 1L)")))

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if vectors.num_rows and queries.num_rows:
            dim, place = vectors.column("dim")[0].as_py(), vectors.column("list")[0].as_py()
            number = lambda t, c: t.column(c).to_numpy()
            search = Search(number(queries, "query_id"), _matrix(queries.column("own"), dim), number(queries, "bound"), k)
            codes = np.frombuffer(b"".join(vectors.column("code").to_pylist()), np.uint8).reshape(vectors.num_rows, -1)
            search.scan(coders.value[dim], place, number(vectors, "vec_id"), _matrix(vectors.column("embedding"), dim), codes, number(vectors, "size"), number(vectors, "along"))
            q, r = np.nonzero(np.isfinite(search.score))
            out = [search.ids[q], search.found[q, r], search.score[q, r]]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, out), strict=True)))

    return left.drop("lots", "crowds", "slot").groupBy(*key).cogroup(right.drop("lots", "crowds").groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest ids of each query, ties to the smaller."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest other vectors of each one whose vec_id is divisible by `every`.

    Vectors of different dimensions aren't compared. Ties go to the smaller vec_id; rows with the same vec_id are copies of one vector, which the rows of the same id
    never find, and the nearest of which counts once; as a query, the least of them stands for all of a dimension. Empty tables and tables without queries give no rows.
    Further columns are not read.
    """
    spark, rows = df.sparkSession, valid(df)
    coders, dims = _coders(rows)
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = spark.sparkContext.broadcast(coders)
    index = cut(encode(rows.where(F.size("embedding").isin(dims)), sent))
    lists = index.groupBy("dim", "list").agg(F.count("*").alias("n"), F.max("size").alias("far")).collect()  # at most LISTS rows a dimension
    sizes, far = {(r.dim, r.list): r.n for r in lists}, {(r.dim, r.list): r.far for r in lists}
    queries = cut(index.where(F.col("vec_id") % every == 0).groupBy("dim", F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("own")))
    first = cut(_probes(queries.withColumn("bound", F.lit(float("inf"))), sent, None))
    near = cut(_meet(index, first, sizes, sent, k), first)
    kth = _best(near, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    second = cut(_probes(queries.join(kth, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), sent, far), queries)
    found = near.unionByName(_meet(index, second, sizes, sent, k))
    if len(dims) == DIMS:
        found = found.unionByName(_joined(rows.where(~F.size("embedding").isin(dims)), every))
    return _best(found, k)


def _joined(rows: DataFrame, every: int) -> DataFrame:
    """Exact distances of all queries and vectors of the same dimension."""
    rows = cut(rows.withColumn("n", F.size("embedding")))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"), "n").agg(F.min("embedding").alias("own"))
    squares = F.zip_with("own", "embedding", lambda a, b: (a - b) * (a - b))
    return rows.join(queries, "n").where("query_id <> vec_id").select("query_id", "vec_id", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)).alias("score"))


#: DuckDB SQL for nearest() over the table embeddings, by brute force.
ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) > 0 AND list_bool_and([isfinite(e) FOR e IN embedding]) AND list_bool_or([e <> 0 FOR e IN embedding])),
s AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(q.x, v.x)], lambda a, b: a + b)) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM s) WHERE rank <= 10
"""
