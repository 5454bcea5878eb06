"""Near duplicates by ProbMinHash: weighted word shingles, banding, exact verification and connected components.

A document is the multiset of its runs of SHINGLE lower-cased words. Each shingle sends Poisson arrivals at a rate of its count; an arrival goes to a random
component of the signature, which keeps its earliest, and a shingle stops when its time passes the latest component. Two signatures agree in a component with the
probability Jaccard similarity. Bands of ROWS components make buckets. In a bucket all are held against its least member, which costs a row for each member. Buckets that
then still span several components are settled exactly, every member against every other of another component, in blocks of bounded size. Pairs are verified by the exact
similarity of whole texts. Equal texts are one node all along. Only a pair that is alike but shares no bucket is missed; no bucket is cut off, whatever its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, cut, discard, free_name, sized, texts
from .words import blocks, mix, run_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Components of a signature; at 0.8, bands of 4 miss a pair with probability (1 - 0.8^4)^20 < 3e-5.
SIZE, ROWS = 80, 4
BANDS = SIZE // ROWS
#: Members on one side of a block of the exact settlement, and shingles that are multiplied at a time.
LOT, SLAB = 512, 4096


def shingles(batch: list[str], size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and counts of each text's shingles; a text of fewer words has one, of all its words."""
    out = []
    for block in blocks([x.lower() for x in batch]):
        runs = run_hashes(block.hashes, size)
        for a, b in zip(block.bounds, block.bounds[1:], strict=False):
            own = runs[a : b - size + 1] if b - a >= size else run_hashes(block.hashes[a:b], int(b - a), 100 + int(b - a)) if b > a else runs[:0]
            out.append(np.unique(own, return_counts=True))
    return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """A row of `size` shingle hashes for each non-empty multiset (empty ones: zeros)."""
    n = len(sets)
    first, best = np.full(n * size, np.inf), np.zeros(n * size, np.uint64)
    row = np.repeat(np.arange(n), [len(h) for h, _ in sets])
    if not len(row):
        return best.reshape(n, size)
    h, w, t, turn = np.concatenate([h for h, _ in sets]), np.concatenate([c for _, c in sets]).astype(np.float64), np.zeros(len(row)), 0
    while len(h):
        u = (mix(h, 1000 + 2 * turn) >> np.uint64(11)).astype(np.float64) / 2**53
        t = t - np.log1p(-u) / w
        at = row * size + (mix(h, 1001 + 2 * turn) % np.uint64(size)).astype(np.int64)
        np.minimum.at(first, at, t)
        won = t == first[at]
        best[at[won]] = h[won]
        alive = t < first.reshape(n, size).max(1)[row]
        h, w, t, row, turn = h[alive], w[alive], t[alive], row[alive], turn + 1
    return best.reshape(n, size)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The sum over shared elements d of 1 / sum over all elements e of max(a[e] / a[d], b[e] / b[d])."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1].astype(float), b[1].astype(float)
    only = np.delete(x, i).sum(), np.delete(y, j).sum()
    kinds, count = np.unique(np.stack([x[i], y[j]]), axis=1, return_counts=True)
    total = 0.0
    for (p, q), n in zip(kinds.T, count, strict=True):
        total += n / (only[0] / p + only[1] / q + (count * np.maximum(kinds[0] / p, kinds[1] / q)).sum())
    return float(total)


def _keyed(df: DataFrame) -> DataFrame:
    """doc_id, text and key: a digest of the lower-cased text, null where the text is null or has no word."""
    some = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(some, F.unhex(F.md5(F.lower("text")))).alias("key"))


def sign(rows: DataFrame) -> DataFrame:
    """doc_id, key and buckets (array<long>, null without a key) of every row of _keyed()."""

    def run(batch: pa.RecordBatch):
        some = batch.column("key").is_valid().to_numpy(zero_copy_only=False)
        z = signatures(shingles([x for x, k in zip(texts(batch), some, strict=True) if k]))
        band = np.zeros((len(z), BANDS), np.uint64)
        for k in range(ROWS):
            band = mix(band + z[:, k::ROWS], k)
        band = mix(band + np.arange(BANDS, dtype=np.uint64), ROWS)
        ends = np.r_[0, np.cumsum(some * BANDS)].astype(np.int32)
        yield {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "buckets": pa.ListArray.from_arrays(pa.array(ends), pa.array(band.view(np.int64).ravel()), mask=pa.array(~some))}

    return by_batches(rows, run, "doc_id long, key binary, buckets array<long>")


def _sets(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """key, hashes and counts: the shingles of the texts whose key is in keys (a table of cut()), once for equal texts."""

    def run(batch: pa.RecordBatch):
        sets = shingles(texts(batch))
        at = pa.array(np.r_[0, np.cumsum([len(h) for h, _ in sets])].astype(np.int32))
        flat = lambda k, kind: np.concatenate([x[k] for x in sets] or [np.zeros(0, kind)]).astype(kind)
        yield {"key": batch.column("key"), "hashes": pa.ListArray.from_arrays(at, pa.array(flat(0, np.uint64).view(np.int64))), "counts": pa.ListArray.from_arrays(at, pa.array(flat(1, np.int32)))}

    known = rows.select("key", "text").join(sized(keys), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))  # equal keys, equal texts but for case
    return by_batches(known, run, "key binary, hashes array<long>, counts array<int>")


def _arrays(batch: pa.RecordBatch | pa.Table, side: str = "") -> list[tuple[np.ndarray, np.ndarray]]:
    return [(h.values.to_numpy(), c.values.to_numpy()) for h, c in zip(batch.column(f"hashes{side}"), batch.column(f"counts{side}"), strict=True)]


def verify(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those pairs (a, b) whose texts have a similarity of threshold or more; pairs and sets are tables of cut()."""
    side = lambda x: sets.select(F.col("key").alias(x), F.col("hashes").alias(f"hashes_{x}"), F.col("counts").alias(f"counts_{x}"))

    def run(batch: pa.RecordBatch):
        ok = [probability_jaccard(x, y) >= threshold for x, y in zip(_arrays(batch, "_a"), _arrays(batch, "_b"), strict=True)]
        yield {k: batch.column(k).filter(pa.array(ok, pa.bool_())) for k in ("a", "b")}

    return by_batches(side("a").join(sized(pairs), "a").join(side("b"), "b"), run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """key and label (the least key of its component) of all ends of links, by least labels of neighbours and of labels in turn."""
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b"))
    near = cut(links.select(F.explode(ends).alias("e")).select("e.a", "e.b").distinct())  # both ways, and each end with itself
    labels = cut(near.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "key"))
    while True:
        known = sized(labels)
        low = near.join(known.withColumnRenamed("key", "b"), "b").groupBy("a").agg(F.min("label").alias("new"), F.min(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("old"))
        jump = known.select(F.col("key").alias("new"), F.col("label").alias("next"))
        step = cut(low.join(jump, "new").select(F.col("a").alias("key"), F.least("new", "next").alias("label"), "old"), labels)
        labels = step
        if not step.where("label <> old").limit(1).count():
            discard(near)
            return step.select("key", "label")


def classes_of(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """key and label of the texts that have near duplicates; rows as _keyed() gives them, signed a written sign() of them."""
    rows = rows.where("key IS NOT NULL")
    once = cut(signed.where("key IS NOT NULL").groupBy("key").agg(F.first("buckets").alias("buckets")))
    member = once.select("key", F.explode("buckets").alias("bucket"))
    centres = cut(member.groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("last")).where(F.col("a") < F.col("last")).select("bucket", "a"))
    # only members of buckets with several texts matter from here on
    crowd = cut(member.join(sized(centres), "bucket").select("bucket", "a", "key"), once, centres)
    keys = cut(crowd.select("key").distinct())
    sets = cut(_sets(rows, keys), keys)
    pairs = cut(crowd.where(F.col("a") < F.col("key")).select("a", F.col("key").alias("b")).distinct())
    links = cut(verify(pairs, sets), pairs)
    labels = components(links)
    rest = cut(_settled(crowd, labels, sets))
    if rest.limit(1).count():
        labels = components(links.union(rest))
    for x in (crowd, sets, links, rest):
        discard(x)
    return labels


def _settled(crowd: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join all components with a pair of THRESHOLD or more in a common bucket.

    A bucket's members are dealt into lots by a hash, and each pair of lots is a group of its own; those of the bucket's commonest label are only held against the rest, as they
    are joined already. Of buckets with the same members one counts. Where many stay apart, the work grows with their pairs, as any exact answer needs; a group stays bounded.
    """
    own = cut(crowd.join(sized(labels), "key", "left").select("bucket", "key", F.coalesce("label", "key").alias("label")))
    kinds = own.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("last"), F.bit_xor(F.xxhash64("key")).alias("print"))
    size = kinds.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("kinds"), F.min("least").alias("least"), F.max("last").alias("last"), F.bit_xor("print").alias("print"))
    mixed = size.where("kinds > 1 AND n > 2").groupBy("n", "least", "last", "print").agg(F.min(F.struct("bucket", "most")).alias("m"))  # the two of a pair have been compared
    few, lots = F.col("n") <= LOT, lambda n: F.ceil(n / LOT).cast("int")
    mixed = cut(mixed.select("m.bucket", F.when(~few, F.col("m.most.label")).alias("main"), F.when(few, 1).otherwise(lots(F.col("n") - F.col("m.most.n"))).alias("rest"), F.when(few, 0).otherwise(lots(F.col("m.most.n"))).alias("mains")))
    is_main = F.coalesce(F.col("label") == F.col("main"), F.lit(False))
    at = F.pmod(F.xxhash64("key", "bucket"), F.when(is_main, F.col("mains")).otherwise(F.col("rest"))).cast("int") + F.when(is_main, F.col("rest")).otherwise(0)
    member = own.join(sized(mixed), "bucket").select("bucket", "key", "label", at.alias("lot"), F.when(is_main, F.col("rest")).otherwise(F.col("rest") + F.col("mains")).alias("others"))
    member = member.withColumn("other", F.explode(F.expr("sequence(0, others - 1)"))).select("bucket", F.least("lot", "other").alias("i"), F.greatest("lot", "other").alias("j"), "lot", "key", "label")
    member = cut(member, own, mixed)
    return sets.join(sized(member), "key").groupBy("bucket", "i", "j").applyInArrow(_block, "a binary, b binary").distinct()


def _block(rows: pa.Table) -> pa.Table:
    """Links that join all labels of a group's rows with an alike pair, one from lot i and the other from lot j."""
    lot, keys = rows.column("lot").to_numpy(), rows.column("key").to_pylist()
    labels = np.unique(np.array(rows.column("label").to_pylist(), object), return_inverse=True)[1]
    sets = _arrays(rows)
    left, right = np.flatnonzero(lot == rows.column("i")[0].as_py()), np.flatnonzero(lot == rows.column("j")[0].as_py())
    up, links = list(range(len(keys))), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    if len(left) and len(right):
        maybe = (bounds(sets, left, right) >= THRESHOLD - 1e-3) & (labels[left][:, None] != labels[right])
        for i, j in np.argwhere(maybe):
            x, y = left[i], right[j]
            a, b = root(labels[x]), root(labels[y])
            if a != b and probability_jaccard(sets[x], sets[y]) >= THRESHOLD:
                up[a] = b
                links.append((min(keys[x], keys[y]), max(keys[x], keys[y])))
    return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})


def bounds(sets: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """No less than the probability Jaccard of sets[left] and sets[right] but for rounding; it equals that of sets without repeats.

    With the parts P and Q of both that lie in shared elements, an element's term is at most 1 / (1 / p + (1 - Q) / q) for its parts p and q. As that is concave and
    homogeneous, the sum is at most 1 / (1 / P + 1 / Q - 1).
    """
    row = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    part = np.concatenate([c / c.sum() for _, c in sets]).astype(np.float32)
    col, held = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True, return_counts=True)[1:]
    shared = held[col] > 1  # the others are in no common part
    row, part, col = row[shared], part[shared], (np.cumsum(held > 1) - 1)[col[shared]]
    order = np.argsort(col, kind="stable")
    row, part, col = row[order], part[order], col[order]
    p, q = np.zeros((len(left), len(right)), np.float32), np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, SLAB):
        k = slice(*np.searchsorted(col, [at, at + SLAB]))
        own = np.zeros((len(sets), min(SLAB, int(col[-1]) + 1 - at)), np.float32)
        own[row[k], col[k] - at] = part[k]
        x, y = own[left], own[right]
        p += x @ (y > 0).T.astype(np.float32)
        q += (x > 0).astype(np.float32) @ y.T
    both = p * q
    return both / np.maximum(p + q - both, 1e-9)


def near_duplicates(df: DataFrame) -> DataFrame:
    """doc_id, class_id and class_size of every row: the least doc_id of its group, and the number of rows in it.

    Documents whose text is null or has no word are groups of their own, as is one that resembles none. Rows with the same doc_id and different texts are different
    documents here; a row without doc_id belongs to a group but doesn't name it (null, if no member has an id). Further columns are not read.
    """
    rows = _keyed(df)
    signed = cut(sign(rows))
    labels = classes_of(rows, signed)
    own = cut(signed.where("key IS NOT NULL").join(sized(labels), "key", "left").select("doc_id", F.coalesce("label", "key").alias("label")))
    ids = cut(own.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    alone = signed.where("key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return own.join(ids, "label").select("doc_id", "class_id", "class_size").unionByName(alone)


def keep_one(df: DataFrame) -> DataFrame:
    """df without the documents whose group has a member with a smaller doc_id; rows that share a doc_id stay or go together, rows without one stay. Columns stay, whatever their names."""
    name = free_name(df, "gone")
    gone = cut(near_duplicates(df).where(F.col("class_id") < F.col("doc_id")).select(F.col("doc_id").alias(name)).distinct())
    return df.join(sized(gone), F.col("doc_id") == F.col(name), "left_anti")
