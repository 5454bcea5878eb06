"""Byte-level BPE by dynamic programming over prefixes.

In any byte string, the canonical encoding of each prefix ends in exactly one token. Merges has those tokens' rules; Prefixes keeps that
token for each prefix of a growing byte string, so that appending is exact and costs only the new bytes, any prefix can be read off, and an
edit is encoded anew only until the table agrees with the old one again. encode() does one piece, BpeCodec whole texts.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, by_batches, texts
from .pretokens import splitter

#: Entries of one generation of a worker's caches.
PIECES, PAIRS = 150_000, 300_000
#: Pieces of up to so many bytes share the table of prefixes; longer ones get their own.
SHORT = 64
NEVER = 1 << 40


class Merges:
    """Ranks, and for each token that merges can reach the two tokens it is made from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes = ranks, {i: b for b, i in ranks.items()}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.live: dict[bytes, int] = {}
        self.longest = {}  # by last byte
        self.pairs = Generations(lambda p: self._adjacent(*p), PAIRS)
        self.tails = Generations(self._tail, PAIRS)
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                split = self._tail_tokens(token)
                if split is None or len(split) != 2:
                    continue  # no order of merges ends in this token: only a whole piece can be it
                self.parts[i], self.made[split] = split, i
            else:
                self.parts[i] = None
            self.live[token] = i
            self.longest[token[-1]] = max(self.longest.get(token[-1], 1), len(token))
        self.pairs.clear()  # a larger table has other merges across a border
        self.pairs.old = {}

    def _tail_tokens(self, token: bytes) -> tuple[int, ...] | None:
        """The two tokens that make up token by the rules so far."""
        cut = [(a, b) for k in range(1, len(token)) if (a := self.live.get(token[:k])) is not None and (b := self.live.get(token[k:])) is not None]
        for a, b in cut:
            if self._adjacent(a, b):
                return a, b
        return None

    def _tail(self, prefix: bytes) -> int:
        """The last token of a short prefix; asks only for those shorter prefixes that a token it might end in leaves."""
        live, pairs, tails, n = self.live, self.pairs, self.tails, len(prefix)
        for start in range(max(0, n - self.longest[prefix[-1]]), n):
            t = live.get(prefix[start:])
            if t is not None and (not start or pairs[tails[prefix[:start]], t]):
                return t
        raise ValueError("a byte has no token")

    def _adjacent(self, a: int, b: int) -> bool:
        """Whether a canonical encoding can have b right after a: undo the merges next to the border, the latest first, and see that none across it was due before."""
        parts, made, bar = self.parts, self.made, NEVER
        while True:
            if made.get((a, b), NEVER) < bar:
                return False
            if a > b and parts[a]:
                bar, a = a, parts[a][1]
            elif parts[b]:
                bar, b = b + 1, parts[b][0]  # of two equal merges the left one is done first
            elif parts[a]:
                bar, a = a, parts[a][1]
            else:
                return True


class Prefixes:
    """For each prefix of a byte string the last token of its encoding."""

    def __init__(self, merges: Merges, data: bytes = b""):
        self.merges, self.data, self.last = merges, bytearray(), []
        self.append(data)

    def __len__(self) -> int:
        return len(self.data)

    def _token_at(self, end: int) -> int:
        m, data, last = self.merges, self.data, self.last
        live, pairs = m.live, m.pairs
        for start in range(max(0, end - m.longest.get(data[end - 1], 1)), end):
            t = live.get(bytes(data[start:end]))
            if t is not None and (not start or pairs[last[start - 1], t]):
                return t
        raise ValueError("a byte has no token")

    def append(self, more: bytes) -> None:
        """Exact: equal to encoding the joined bytes from the start."""
        self.data += more
        for end in range(len(self.last) + 1, len(self.data) + 1):
            self.last.append(self._token_at(end))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace data[start:end]; gives the number of prefixes that had to be computed."""
        kept, shift = self.last[end:], len(new) - (end - start)
        self.data[start:end] = new
        del self.last[start:]
        reach, agree, done = max(self.merges.longest.values(), default=1), 0, 0
        for at in range(start + 1, len(self.data) + 1):
            self.last.append(self._token_at(at))
            done += 1
            old = at - shift - end
            agree = agree + 1 if old > 0 and kept[old - 1] == self.last[-1] else 0
            if agree >= reach:  # all that later prefixes look back on is as before
                self.last += kept[old:]
                break
        return done

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first end bytes (all by default)."""
        out, at = [], len(self.data) if end is None else end
        while at:
            t = self.last[at - 1]
            out.append(t)
            at -= len(self.merges.bytes[t])
        return out[::-1]


def encode(merges: Merges, piece: bytes) -> list[int]:
    """The tokens of one piece; a piece that is a token as a whole is that token."""
    if (whole := merges.ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > SHORT:
        return Prefixes(merges, piece).tokens()
    out, tails, sizes = [], merges.tails, merges.sizes
    while piece:
        t = tails[piece]
        out.append(t)
        piece = piece[: -sizes[t]]
    return out[::-1]


class BpeCodec:
    """Encodes and decodes texts by a rank file, split by pattern first."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.merges = Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.split = splitter(pattern)
        self.csv = Generations(lambda p: ",".join(map(str, encode(self.merges, p.encode()))), PIECES)
        self.by_number = Generations(lambda csv: self.decode(map(int, csv.split(","))), PIECES)

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.split(text) for i in self.csv[p].split(",")]

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.merges.bytes.__getitem__, ids))

    def written(self, text: str) -> list[str]:
        """The ids of each piece, joined by commas."""
        return list(map(self.csv.__getitem__, self.split(text)))

    def read(self, written: list[str]) -> bytes:
        return b"".join(map(self.by_number.__getitem__, written))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BpeCodec:
    """One for each worker process."""
    return BpeCodec(path, pattern)


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns keep and ids array<int> of each text. A null or empty text has no ids. A row stays a row; other columns go."""

    def run(batch: pa.RecordBatch):
        c = codec(path, pattern)
        yield {k: batch.column(k) for k in keep} | {"ids": [c.encode(x) for x in texts(batch, text)]}

    return by_batches(df.select(*keep, text), run, ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), "ids array<int>"]))


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns keep and data binary, the bytes that each list of ids stands for; null ids give no bytes."""

    def run(batch: pa.RecordBatch):
        c = codec(path, pattern)
        yield {k: batch.column(k) for k in keep} | {"data": [c.decode(x or []) for x in batch.column(ids).to_pylist()]}

    return by_batches(df.select(*keep, ids), run, ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), "data binary"]))


def round_trip(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text, encoded and decoded in one pass without any shuffle.

    Null and empty texts: no tokens, and the digests of nothing. Equal rows give equal rows; further columns of df are not read.
    """

    def run(batch: pa.RecordBatch):
        c = codec(path, pattern)
        n, ids, data = [], [], []
        for x in texts(batch):
            w = c.written(x)
            joined = ",".join(w)
            n.append(joined.count(",") + bool(w))
            ids.append(hashlib.sha256(joined.encode()).hexdigest())
            data.append(hashlib.sha256(c.read(w)).hexdigest())
        yield {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": data}

    return by_batches(df.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
