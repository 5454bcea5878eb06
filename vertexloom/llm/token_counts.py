"""Token counts through two tiers of pre-token lengths, without a shuffle of pre-tokens.

The first tier holds the pre-tokens that are frequent in a sample of at most 2 * SAMPLE texts, chosen by a hash and split in one task; their lengths in tokens are broadcast as
one string and one byte array of at most FREQUENT entries. All texts are then read once: a worker looks a pre-token up there, then in its own cache of bounded size; only what
both lack is encoded by the library's model. Texts of common Latin letters are split by the standard `re`, all others by the library's own normaliser and splitter, and special
strings are cut out first, so that every pre-token goes through the tiers. The tiers change the speed, never a count.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, by_batches, slices, texts
from .pretokens import word_pieces

#: Texts of the sample; entries of the broadcast table and of one generation of a worker's cache.
SAMPLE, FREQUENT, CACHE = 2048, 20_000, 200_000


class Lengths:
    """The number of tokens of a text by a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.model = self.own.model
        self.special = re.compile("|".join(re.escape(t.content) for t in sorted(self.own.get_added_tokens_decoder().values(), key=lambda t: -len(t.content))) or "(?!)")
        free = iter(range(256, 512))
        self.letters = {b: chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(next(free)) for b in range(256)}
        self.cache = Generations(self.encoded, CACHE)
        self.seen = None

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special strings it holds."""
        parts = self.special.split(text)
        return [p for x in parts for p in self._pieces(x)], len(parts) - 1

    def _pieces(self, text: str) -> list[str]:
        plain = word_pieces(text)
        if plain is None:
            text = self.own.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.own.pre_tokenizer.pre_tokenize_str(text)]
        return plain

    def encoded(self, piece: str) -> int:
        return len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))

    def frequent(self, names: str, sizes: bytes, of: str) -> dict[str, int]:
        if self.seen is None or self.seen[0] != of:
            self.seen = (of, dict(zip(names.split("\n"), sizes, strict=True)) if sizes else {})
        return self.seen[1]


@functools.lru_cache(maxsize=2)
def lengths_of(path: str) -> Lengths:
    return Lengths(path)


def frequent_pieces(df: DataFrame, path: str, frequent: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens of the sample, at most so many; ties go by name."""
    rate = min(1.0, SAMPLE / max(1, df.count()))
    some = df.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(rate * (1 << 30))).select("text").limit(2 * SAMPLE)

    def leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, seen = lengths_of(path), Counter()
        for batch in batches:
            for part in slices(batch):
                for x in texts(part):
                    seen.update(lengths.split(x)[0])
        yield pa.RecordBatch.from_arrays([pa.array([k for _, k in sorted((-n, k) for k, n in seen.items())[:frequent]], pa.string())], ["piece"])

    return [r.piece for r in some.mapInArrow(leaders, "piece string").collect()]


def count_tokens(df: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) of every row.

    A null or empty text has no bytes and no tokens. Equal rows stay apart; a null doc_id stays null; further columns are not read.
    """
    lengths = lengths_of(path)
    names = frequent_pieces(df, path)
    sizes = [min(255, lengths.encoded(x)) for x in names]
    names, sizes = [x for x, n in zip(names, sizes, strict=True) if n < 255], [n for n in sizes if n < 255]
    known = df.sparkSession.sparkContext.broadcast(("\n".join(names), bytes(sizes), uuid.uuid4().hex))

    def run(batch: pa.RecordBatch):
        c = lengths_of(path)
        table = c.frequent(*known.value)
        cache, n_bytes, n_tokens = c.cache, [], []
        for x in texts(batch):
            n_bytes.append(len(x.encode()))
            pieces, specials = c.split(x)
            n_tokens.append(specials + sum(n if (n := table.get(w)) is not None else cache[w] for w in pieces))
        yield {"doc_id": batch.column("doc_id"), "n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": [n > limit for n in n_tokens]}

    return by_batches(df.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
