"""A graph is two tables: vertices (id) and edges (src, dst), both with any further attribute columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def swapped(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in e.columns if c not in ("src", "dst")))


@dataclass(frozen=True)
class Graph:
    """Edges are directed. In a simple graph (src, dst) is unique; self-loops stay. Derivations give new graphs.

    What is known of a graph spares work: symmetric, that each edge has its reverse; spanned, that all vertices are ends of edges. False says nothing.
    """

    vertices: DataFrame
    edges: DataFrame
    multigraph: bool = False
    symmetric: bool = False
    spanned: bool = False

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None, undirected: bool = False, multigraph: bool = False) -> Graph:
        """Vertices are all ends of edges, and those supplied; rows with a null end are left out."""
        e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).withColumns({k: F.col(k).cast("long") for k in ("src", "dst")})
        ends = e.select(F.explode(F.array("src", "dst")).alias("id"))
        if undirected:
            e = e.unionByName(swapped(e))
        if not multigraph:
            e = e.dropDuplicates(["src", "dst"])
        v = ends.distinct() if vertices is None else ends.unionByName(vertices.select(F.col("id").cast("long"))).distinct()
        return cls(v, e, multigraph, undirected, vertices is None)

    def reverse(self) -> Graph:
        return replace(self, edges=swapped(self.edges))

    def undirected(self) -> Graph:
        e = self.edges.select("src", "dst")
        both = e.union(e.select("dst", "src"))
        return replace(self, edges=both if self.multigraph else both.distinct(), symmetric=True)

    def adjacency(self) -> DataFrame:
        """id and its sorted neighbours; vertices without any have an empty array."""
        own = self.edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))
        return self.vertices.join(own, F.col("id") == F.col("src"), "left").select("id", F.coalesce("neighbours", F.array().cast("array<long>")).alias("neighbours"))

    def in_adjacency(self) -> DataFrame:
        """id and the sorted sources of its in-edges: a view of the same edges, so nothing is kept twice or gets out of step."""
        return self.reverse().adjacency()

    def neighbours(self, vertex: int) -> DataFrame:
        return self.edges.where(F.col("src") == vertex).select(F.col("dst").alias("id"))

    def with_vertices(self, more: DataFrame) -> Graph:
        return replace(self, vertices=self.vertices.unionByName(more.select("id")).distinct(), spanned=False)

    def with_edges(self, more: DataFrame) -> Graph:
        return Graph.from_edges(self.edges.select("src", "dst").unionByName(more.select("src", "dst")), self.vertices, multigraph=self.multigraph)

    def without_edges(self, gone: DataFrame) -> Graph:
        """All occurrences of the given pairs go; vertices stay."""
        return replace(self, edges=self.edges.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti"), symmetric=False, spanned=False)

    def with_neighbours(self, new: DataFrame, of: DataFrame) -> Graph:
        """The out-edges of the vertices in `of` are replaced by those in new."""
        rest = self.edges.select("src", "dst").join(of.select(F.col("id").alias("src")), "src", "left_anti")
        return Graph.from_edges(rest.unionByName(new.select("src", "dst")), self.vertices, multigraph=self.multigraph)

    def induced(self, keep: Column) -> Graph:
        """The vertices that fulfil keep, with their attributes, and the edges between them."""
        v = self.vertices.where(keep)
        ids = v.select("id")
        e = self.edges.join(ids, self.edges["src"] == ids["id"], "left_semi")
        return replace(self, vertices=v, edges=e.join(ids, e["dst"] == ids["id"], "left_semi"), spanned=False)

    def contract(self, label: DataFrame) -> Graph:
        """Ends replaced by their label (id, label; itself where there is none), without self-loops and repeats."""
        e = self.edges.select("src", "dst")
        for end in ("src", "dst"):
            to = label.select(F.col("id").alias(end), F.col("label").alias("__to"))
            e = e.join(to, end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
        v = self.vertices.select("id").join(label.select("id", "label"), "id", "left").select(F.coalesce("label", "id").alias("id")).distinct()
        return Graph(v, e.where("src <> dst").distinct())
