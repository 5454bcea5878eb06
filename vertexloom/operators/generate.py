"""Graphs made from ranges."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.ids import draw
from ..graph import Graph


def grid(spark: SparkSession, width: int, height: int, directed: bool = False, diagonals: bool = False) -> Graph:
    """Vertex i + width * j with edges to the right and down (and back, if undirected), and on request one to the lower right."""
    v = spark.range(width * height)
    x, y = F.col("id") % width, F.floor(F.col("id") / width)
    right = v.where(x < width - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = v.where(y < height - 1).select(F.col("id").alias("src"), (F.col("id") + width).alias("dst"))
    e = right.union(down)
    if not directed:
        e = e.union(e.select("dst", "src"))
    if diagonals:
        e = e.union(v.where((x < width - 1) & (y < height - 1)).select("id", F.col("id") + width + 1))
    return Graph(v, e)


def chain(spark: SparkSession, n: int, cycle: bool = False) -> Graph:
    e = spark.range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return Graph(spark.range(n), e.union(spark.range(1).select(F.lit(n - 1).cast("long"), F.lit(0).cast("long"))) if cycle and n else e)


def empty(spark: SparkSession, n: int) -> Graph:
    return Graph(spark.range(n), spark.range(0).select(F.col("id").alias("src"), F.col("id").alias("dst")))


def random(spark: SparkSession, n: int, least: int, most: int, seed: int = 0) -> Graph:
    """Each vertex draws an out-degree in [least, most] and that many targets, all by draws from the seed; repeats of a target count once."""
    d = draw(seed, most - least + 1, "id") + least
    e = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), d)).alias("k")).where("k > 0")
    return Graph(spark.range(n), e.select("src", draw(seed, n, "src", "k").alias("dst")).distinct())
