"""Attributed graphs: projections, triplets, lookups, and vertex programs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.loop import beside, kept, settle_counting, until_still


def map_vertices(g: Graph, value: Column, name: str = "value") -> DataFrame:
    return g.vertices.select("id", value.alias(name))


def search(g: Graph, keep: Column) -> DataFrame:
    return g.vertices.where(keep).select("id")


def triplets(g: Graph, attribute: str) -> DataFrame:
    """src, dst and the attribute of both ends."""
    end = lambda x: g.vertices.select(F.col("id").alias(x), F.col(attribute).alias(f"{x}_{attribute}"))
    return g.edges.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst").select("src", "dst", f"src_{attribute}", f"dst_{attribute}")


def edge_attribute(g: Graph, values: DataFrame, default: Column) -> DataFrame:
    """src, dst, attr of every edge; what has no value gets the default."""
    return g.edges.select("src", "dst").join(values.select("src", "dst", "attr"), ["src", "dst"], "left").select("src", "dst", F.coalesce("attr", default).alias("attr"))


def set_edge_attribute(values: DataFrame, new: DataFrame) -> DataFrame:
    """values (src, dst, attr) with new ones in the place of old ones, or beside them; where new has several for an edge, the greatest counts."""
    new = new.groupBy("src", "dst").agg(F.max("attr").alias("attr"))
    return values.join(new, ["src", "dst"], "left_anti").unionByName(new)


def set_vertex_attribute(g: Graph, new: DataFrame, name: str, default: Column | None = None) -> Graph:
    """g whose vertices have the attribute `name` of new (id, attr; the greatest of several), and elsewhere keep what they had, or get the default where they had none.

    Ids that are no vertices of g are left out.
    """
    new = new.groupBy("id").agg(F.max("attr").alias("__new"))
    old = F.col(f"`{name}`") if name in g.vertices.columns else F.lit(None)
    value = F.coalesce("__new", old) if default is None else F.coalesce("__new", old, default)
    return replace(g, vertices=g.vertices.join(new, "id", "left").withColumn(name, value).drop("__new"))


def has_edge(g: Graph, pairs: DataFrame) -> DataFrame:
    """src, dst of each given pair and whether it is an edge."""
    e = g.edges.select("src", "dst", F.lit(True).alias("is_edge")).distinct()
    return pairs.select("src", "dst").join(e, ["src", "dst"], "left").withColumn("is_edge", F.coalesce("is_edge", F.lit(False)))


def extreme(values: DataFrame, value: str, greatest: bool = True, keep: Column | None = None) -> DataFrame:
    """The row (id, value) with the greatest or least value among those that fulfil keep, the least id of equals; empty without rows."""
    some = values.where(F.col(value).isNotNull()).where(F.lit(True) if keep is None else keep)
    return some.select("id", value).orderBy(F.desc(value) if greatest else F.asc(value), "id").limit(1)


def _visit(df: DataFrame, visit: Callable) -> int:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                visit(row)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return df.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def for_each_vertex(g: Graph, visit: Callable[[dict], None]) -> int:
    """Call visit in the workers with a dict of each vertex's columns, and return how many there were. A task that is repeated visits its rows again."""
    return _visit(g.vertices, visit)


def for_each_edge(g: Graph, visit: Callable[[dict], None], values: DataFrame | None = None) -> int:
    """The same for edges, with their attribute (src, dst, attr of values; null where unset) if values are given."""
    return _visit(g.edges if values is None else edge_attribute(g, values, F.lit(None)), visit)


def for_each_triplet(g: Graph, attribute: str, visit: Callable[[dict], None]) -> int:
    """The same for edges with the attribute of both ends."""
    return _visit(triplets(g, attribute), visit)


def pregel(g: Graph, start: Column, send: Column, combine: Callable[[Column], Column], apply: Column, most: int | None = None, listen=None) -> DataFrame:
    """id and value of a vertex program.

    start is over id. In a superstep each vertex whose value changed sends the column send (over value, src, dst) along its out-edges; messages for a vertex are combined by an aggregate and
    apply (over value and message; message is null without mail) gives its next value. It ends when no value changes.
    """
    edges = kept(g.edges, "src")
    first, total = settle_counting(g.vertices.select("id", start.alias("value"), F.lit(True).alias("fresh")))

    def step(s: DataFrame, n: int) -> DataFrame:
        sent = beside(s.where("fresh").select(F.col("id").alias("src"), "value"), n)
        mail = edges.join(sent, "src").select("dst", send.alias("message")).groupBy(F.col("dst").alias("id")).agg(combine(F.col("message")).alias("message"))
        new = s.join(beside(mail, total), "id", "left").select("id", "value", apply.alias("new"))
        return new.select("id", F.col("new").alias("value"), (~F.col("new").eqNullSafe(F.col("value"))).alias("fresh"))

    out = until_still(first, step, "fresh", total, most, listen)
    edges.unpersist()
    return out.select("id", "value")
