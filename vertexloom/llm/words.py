"""Words as 64-bit hashes, and hashes of runs of words, for many texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes that one step hashes; a text that is longer goes in slices that end at white space.
SLICE = 1 << 17
_ODD, _BASE = np.uint64(0x9E3779B97F4A7C15), 0xD1342543DE82EF95 | 2
_SOLID = np.ones(256, np.int8)
_SOLID[[32, 9, 10, 11, 12, 13]] = 0
_BYTE = np.random.default_rng(64).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scatter the bits of 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _ODD * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


_UP, _DOWN = _powers(_BASE, SLICE), _powers(pow(_BASE, -1, 1 << 64), SLICE)


def _hash_slice(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of data: a sum over bytes, of a random number for the byte times a power for its place in the word."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(_SOLID[raw], prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(raw)
    up, down = (_UP, _DOWN) if n <= SLICE else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
        return starts, mix((total[ends] - total[starts]) * down[starts])


def _slices(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            found = [x for c in b" \t\n\v\f\r" if (x := data.find(bytes([c]), end - 1, end + 4096)) >= 0]
            while not found and end < len(data):  # a very long word stays whole
                end += 4096
                found = [x for c in b" \t\n\v\f\r" if (x := data.find(bytes([c]), end - 1, end + 4096)) >= 0]
            end = min(found) + 1 if found else len(data)
        yield at, data[at:end]
        at = end


@dataclass
class Block:
    """Hashes of the words of some consecutive texts; text i of the batch has the words bounds[i - first] to bounds[i - first + 1]."""

    first: int
    hashes: np.ndarray
    bounds: np.ndarray

    def text_of(self, places: np.ndarray) -> np.ndarray:
        """The number in the batch of the text that a word belongs to."""
        return self.first + np.searchsorted(self.bounds, places, "right") - 1

    def inside(self, length: int) -> np.ndarray:
        """For each run of length words, whether it lies in one text."""
        n = len(self.hashes) - length + 1
        if n <= 0:
            return np.zeros(0, bool)
        out = np.ones(n, bool)
        for b in self.bounds[1:-1]:
            out[max(0, b - length + 1) : b] = False
        return out


def blocks(texts: list[str]) -> Iterator[Block]:
    """All texts in order, in blocks of about SLICE bytes."""
    held, size, first = [], 0, 0
    for i, x in enumerate(texts):
        raw = x.encode()
        if held and size + len(raw) > SLICE:
            yield _block(held, first)
            held, size, first = [], 0, i
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield _block(held, first)


def _block(held: list[bytes], first: int) -> Block:
    ends = np.cumsum([len(x) + 1 for x in held])
    starts, hashes = [], []
    for at, data in _slices(b"\n".join(held)):
        s, h = _hash_slice(data)
        starts.append(s + at)
        hashes.append(h)
    if not hashes:
        return Block(first, np.empty(0, np.uint64), np.zeros(len(held) + 1, np.int64))
    return Block(first, np.concatenate(hashes), np.r_[0, np.searchsorted(np.concatenate(starts), ends)])


def run_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of n consecutive words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    factor, out = np.uint64(int(mix(np.array([seed], np.uint64))[0]) | 1), np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out *= factor
            out += h[k : k + m]
    return mix(out, seed)


def rolling_minimum(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive numbers, by doubling."""
    if len(x) < n:
        return x[:0]
    size = 1
    while size * 2 <= n:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x
