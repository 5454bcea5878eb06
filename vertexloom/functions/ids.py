"""Columns over vertex ids: owners, and draws that a seed fixes on every run and every partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def owner(vertex: str | Column, parts: int) -> Column:
    """The part that a vertex belongs to: its id modulo the number of parts."""
    return F.pmod(vertex, F.lit(parts))


def scattered(seed: int, *of: str | Column) -> Column:
    """A number below 2^60 from the MD5 digest of the seed and further columns, joined by colons, which any SQL engine can repeat."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in of))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def draw(seed: int, n: int | Column, *of: str | Column) -> Column:
    """A number in [0, n) by scattered()."""
    return F.pmod(scattered(seed, *of), F.lit(n) if isinstance(n, int) else n)
