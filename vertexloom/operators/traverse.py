"""Breadth-first search from any number of sources, shortest paths, walks: one join and one aggregate a superstep, over the frontier only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import draw, scattered
from ..graph import Graph
from ..plans.loop import beside, kept, numbered, settle, settle_counting


def bfs_from(g: Graph, sources: DataFrame, neighbour_if: Column | None = None, expand_if: Column | None = None, most: int | None = None, listen=None) -> DataFrame:
    """source, id, dist, pred for every vertex reached from each source (sources: id).

    Conditions are over id: neighbour_if says which neighbours may be reached, expand_if from which vertices the search goes on; a source is always reached. pred is the least
    vertex of the level before (null at the source). Unreached vertices have no row. listen gets each depth and its frontier.
    """
    yes = F.lit(True)
    edges = kept(g.edges.select("src", F.col("dst").alias("id")).where(yes if neighbour_if is None else neighbour_if), "src")
    front, n = settle_counting(sources.select(F.col("id").alias("source"), "id", F.lit(0).cast("long").alias("dist"), F.lit(None).cast("long").alias("pred")).distinct())
    seen, total, depth = front, n, 0
    while n and (most is None or depth < most):
        depth += 1
        sent = front.where(yes if expand_if is None else expand_if).select("source", F.col("id").alias("src"))
        step = edges.join(beside(sent, n), "src").groupBy("source", "id").agg(F.min("src").alias("pred"))
        fresh = step.join(beside(seen.select("source", "id"), total), ["source", "id"], "left_anti")
        front, n = settle_counting(fresh.select("source", "id", F.lit(depth).cast("long").alias("dist"), "pred"))
        seen, total = seen.union(front), total + n
        if depth % 8 == 0:
            seen = settle(seen)
        if listen:
            listen(depth, front)
    edges.unpersist()
    return seen


def bfs(g: Graph, source: int, neighbour_if: Column | None = None, expand_if: Column | None = None, most: int | None = None, listen=None) -> DataFrame:
    """id, dist, pred from one source."""
    one = g.vertices.sparkSession.range(1).select(F.lit(source).cast("long").alias("id"))
    return bfs_from(g, one, neighbour_if, expand_if, most, listen).drop("source")


def rounds(reached: DataFrame) -> int:
    """How many vertices a queue would take out: all that were reached."""
    return reached.count()


def farthest(reached: DataFrame) -> DataFrame:
    """The vertex with the greatest distance, the least id of equals."""
    return reached.agg(F.min(F.struct((-F.col("dist")).alias("d"), "id")).alias("x")).select(F.col("x.id").alias("id"), (-F.col("x.d")).alias("dist"))


def visit_order(reached: DataFrame) -> DataFrame:
    """place, id, dist: the order in which a queue that takes neighbours by id meets whole levels, so by distance, then id."""
    return numbered(reached.select("id", "dist"), "dist", "id", name="place").select("place", "id", "dist")


def shortest_path(reached: DataFrame, target: int) -> list[int]:
    """The vertices from the source to target along predecessors, by pointer doubling: jobs follow the logarithm of the path's length; only the path itself comes to the driver."""
    source = F.col("pred").isNull() | ((F.col("pred") == -1) & (F.col("dist") == 0))
    jumps = [settle(reached.select("id", F.when(~source, F.col("pred")).alias("up")))]
    path = jumps[0].where(F.col("id") == target).select("id", F.lit(0).cast("long").alias("hops"))
    if not path.limit(1).count():
        raise ValueError(f"vertex {target} was not reached")
    while jumps[-1].where((F.col("id") == target) & F.col("up").isNotNull()).limit(1).count():
        last = jumps[-1]
        further = last.select(F.col("id").alias("up"), F.col("up").alias("next"))
        jumps.append(settle(last.join(further, "up", "left").select("id", F.col("next").alias("up"))))
    for k in reversed(range(len(jumps))):
        on = jumps[k].join(F.broadcast(path), "id").where("up IS NOT NULL").select(F.col("up").alias("id"), (F.col("hops") + (1 << k)).alias("hops"))  # no longer than the path
        path = settle(path.union(on).distinct())
    return [r.id for r in path.orderBy(F.desc("hops")).collect()]


def shortest_distances(g: Graph, source: int, weight: str | None = None) -> DataFrame:
    """id, dist, pred by relaxation; without a weight column each edge counts 1. The source has pred -1; of equal distances the least predecessor."""
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    edges = kept(g.edges.select("src", "dst", w.alias("w")), "src")
    start = F.lit(0).cast("double" if weight else "long")
    best, n = settle_counting(g.vertices.sparkSession.range(1).select(F.lit(source).cast("long").alias("id"), start.alias("dist"), F.lit(-1).cast("long").alias("pred")))
    front, total = best, n
    while n:
        sent = beside(front.select(F.col("id").alias("src"), "dist"), n)
        more = edges.join(sent, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("pred"))).alias("new"))
        both = more.join(beside(best, total), "id", "left")
        better = F.col("dist").isNull() | (F.col("new.dist") < F.col("dist")) | ((F.col("new.dist") == F.col("dist")) & (F.col("new.pred") < F.col("pred")) & (F.col("pred") >= 0))
        front, n = settle_counting(both.where(better).select("id", F.col("new.dist").alias("dist"), F.col("new.pred").alias("pred")))
        best, total = settle_counting(best.join(beside(front.select("id"), n), "id", "left_anti").union(front))
    edges.unpersist()
    return best


def random_walk(g: Graph, sources: DataFrame, steps: int, seed: int = 0, neighbour_if: Column | None = None) -> DataFrame:
    """id and visits: each row of sources (id, and a number `walker` of its own, given out here if it lacks one) is a walker that makes so many visits, the first at its source.

    From each it moves along the out-edge that a draw from seed, walker and step chooses among the vertex's, in the order of targets, independently of all other walkers;
    it ends at sinks and where the condition, over id, fails. Edges are looked up by their number, so a hub's edges are never gathered, however many walkers meet there.
    """
    edges = numbered(g.edges.select("src", "dst"), "src", "dst").persist()
    of = edges.groupBy(F.col("src").alias("id")).agg(F.min("n").alias("first"), F.count("*").alias("degree")).persist()
    at, n = settle_counting(sources.select("id", "walker") if "walker" in sources.columns else sources.select("id", F.monotonically_increasing_id().alias("walker")))
    visits = at.groupBy("id").agg(F.count("*").alias("n"))
    for step in range(1, steps):
        moved = of.join(beside(at, n), "id").select("walker", (F.col("first") + draw(seed, F.col("degree"), "walker", F.lit(step))).alias("n"))
        there = edges.join(beside(moved, n), "n").select(F.col("dst").alias("id"), "walker")
        at, n = settle_counting(there.where(F.lit(True) if neighbour_if is None else neighbour_if))
        visits = visits.union(at.groupBy("id").agg(F.count("*").alias("n")))
    out = settle(visits.groupBy("id").agg(F.sum("n").alias("visits")))
    edges.unpersist()
    of.unpersist()
    return out


def pick_vertices(g: Graph, n: int, seed: int = 0) -> DataFrame:
    """n vertices of the whole graph, those with the least number by the seed."""
    return g.vertices.select("id").orderBy(scattered(seed, "id"), "id").limit(n)
