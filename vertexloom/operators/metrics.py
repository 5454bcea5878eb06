"""Counts, degrees, distributions and locality: partial and final aggregates in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import draw, owner
from ..graph import Graph


def vertex_count(g: Graph, keep: Column | None = None) -> DataFrame:
    return g.vertices.where(F.lit(True) if keep is None else keep).agg(F.count("*").alias("vertices"))


def edge_count(g: Graph) -> DataFrame:
    return g.edges.agg(F.count("*").alias("edges"))


def summary(g: Graph) -> DataFrame:
    """vertices, edges and the average out-degree (0 without vertices)."""
    return vertex_count(g).crossJoin(edge_count(g)).withColumn("average", F.coalesce(F.try_divide("edges", "vertices"), F.lit(0.0)))  # one row each


def out_degrees(g: Graph) -> DataFrame:
    d = g.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return g.vertices.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def max_degree(g: Graph, keep: Column | None = None) -> DataFrame:
    """The vertex with most out-edges, the least id of equals; (-1, -1) if there is none."""
    best = out_degrees(g).where(F.lit(True) if keep is None else keep).agg(F.min(F.struct(-F.col("degree"), "id")).alias("b"))
    return best.select(F.coalesce(F.col("b.id"), F.lit(-1)).alias("id"), F.coalesce(-F.col("b.col1"), F.lit(-1)).alias("degree"))


def distribution(df: DataFrame, value: str) -> DataFrame:
    """value and the number of rows that have it."""
    return df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))


def degree_distribution(g: Graph) -> DataFrame:
    return distribution(out_degrees(g), "degree")


def neighbourless(g: Graph) -> DataFrame:
    """The number of vertices without out-edges."""
    return g.vertices.join(g.edges, F.col("id") == F.col("src"), "left_anti").agg(F.count("*").alias("n"))


def per_part(g: Graph, parts: int) -> DataFrame:
    """Vertices, out-edges and in-edges that belong to each part, id modulo parts being a vertex's part."""
    of = lambda df, key, name: df.select(owner(key, parts).alias("part"), *(F.lit(int(name == x)).alias(x) for x in ("vertices", "out_edges", "in_edges")))
    rows = of(g.vertices, "id", "vertices").union(of(g.edges, "src", "out_edges")).union(of(g.edges, "dst", "in_edges"))
    return rows.groupBy("part").agg(*(F.sum(x).cast("long").alias(x) for x in ("vertices", "out_edges", "in_edges")))


def edge_locality(g: Graph, parts: int) -> DataFrame:
    """Edges whose ends belong to the same part, all edges, and their ratio."""
    same = (owner("src", parts) == owner("dst", parts)).cast("long")
    return g.edges.agg(F.coalesce(F.sum(same), F.lit(0)).alias("local"), F.count("*").alias("total")).withColumn("ratio", F.round(F.try_divide("local", "total"), 6))


def locality_of(g: Graph, parts: DataFrame) -> DataFrame:
    """edge_locality by a table of owners (id, part); ends without an owner share none."""
    end = lambda x: parts.select(F.col("id").alias(x), F.col("part").alias(f"{x}_part"))
    known = g.edges.select("src", "dst").join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    same = F.coalesce(F.col("src_part") == F.col("dst_part"), F.lit(False)).cast("long")
    return known.agg(F.coalesce(F.sum(same), F.lit(0)).alias("local"), F.count("*").alias("total")).withColumn("ratio", F.round(F.try_divide("local", "total"), 6))


def two_cycles(g: Graph) -> DataFrame:
    """Ordered pairs with edges both ways; a self-loop counts once."""
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return g.edges.join(back, ["src", "dst"], "left_semi").agg(F.count("*").alias("n"))


def two_cycles_estimate(g: Graph, factor: int, seed: int = 0) -> DataFrame:
    """The count over a hashed 1/factor of the sources, times factor."""
    some = Graph(g.vertices, g.edges.where(draw(seed, factor, "src") == 0))
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return some.edges.join(back, ["src", "dst"], "left_semi").agg((F.count("*") * factor).alias("n"))


def wide_sets(g: Graph) -> DataFrame:
    """How many neighbour sets need 64-bit ids, and how many bytes 8-byte ids take: the logical side of set types and footprints."""
    own = g.edges.groupBy("src").agg(F.max("dst").alias("most"), F.count("*").alias("n"))
    return own.groupBy((F.col("most") >= 2147483647).alias("wide")).agg(F.count("*").alias("sets"), (F.sum("n") * 8).alias("bytes"))
