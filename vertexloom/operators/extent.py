"""Eccentricity and diameter. Searches run for many sources in one loop, so the number of jobs follows the depth, not the number of sources; eccentricities of components that
one task can hold take no loop at all."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.ids import draw
from ..graph import Graph
from ..plans.loop import beside, settle, settle_counting
from .components import labelled
from .inside import OPEN, REFINED, assigned, farthest as farthest_inside, farthest_from_given, refiner
from .metrics import max_degree
from .traverse import bfs, bfs_from, farthest, pick_vertices, shortest_path

#: Rows (source, vertex) that a search may hold at a time.
BUDGET = 50_000_000
#: Components of up to LOCAL edges are searched by one task, about CROWD vertices and edges at once.
LOCAL, CROWD = 20_000, 100_000


def _lots(some: DataFrame, rows: int, budget: int) -> Iterator[DataFrame]:
    """The ids of some, whose searches hold so many rows, in parts by a hash that each stay in the budget."""
    lots = max(1, -(-rows // budget))
    for lot in range(lots):
        yield some.where(F.pmod(F.xxhash64("id"), F.lit(lots)) == lot) if lots > 1 else some


@dataclass(frozen=True)
class _Parts:
    """A graph by the weight of its components. The light ones are rows (bucket, label, id, dst, ways), whole components by the bucket: pairs, and vertices that are alone (dst is null)."""

    rows: DataFrame
    heavy: Graph | None
    sizes: DataFrame | None  # label and size of the heavy components
    labels: DataFrame | None  # id and label of their vertices
    total: int  # and how many these are

    def pairs(self) -> DataFrame:
        return self.rows.where("dst IS NOT NULL")

    def vertices(self) -> DataFrame:
        """bucket, label and id of the light ones."""
        return self.rows.select("bucket", "label", "id").union(self.pairs().select("bucket", "label", "dst")).distinct()


def _parts(g: Graph, keep: Column | None, local: int | None) -> _Parts:
    inner = g if keep is None else g.induced(keep)
    ends = inner.edges.select("src", "dst")
    if inner.symmetric:  # half of the edges say it all
        pairs = ends.where("src < dst").distinct().withColumn("ways", F.lit(3))
    else:
        pairs = ends.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.expr("IF(src < dst, 1, 2)").alias("ways"))
        pairs = pairs.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.bit_or("ways").alias("ways"))
    pairs, m = settle_counting(pairs)
    pairs, large, k = labelled(pairs, m, LOCAL if local is None else local)
    alone, n = settle_counting((ends.where("src = dst").select(F.col("src").alias("id")) if inner.spanned else inner.vertices.select("id")).distinct())
    if n:
        alone, n = settle_counting(alone.join(pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).hint("merge"), "id", "left_anti"))
    none = lambda kind: F.lit(None).cast(kind)
    light = (pairs.join(beside(large, k), "label", "left_anti") if k else pairs).withColumnRenamed("src", "id")
    bucket = F.pmod(F.xxhash64("label"), F.lit(-(-(3 * m + n) // CROWD) or 1)).alias("bucket")  # a pair is two edges and, in a sparse graph, about a vertex
    rows = (light.union(alone.select("id", "id", none("long"), none("int"))) if n else light).select(bucket, "label", "id", "dst", "ways")
    if not k:
        return _Parts(rows, None, None, None, 0)
    those = settle(pairs.join(beside(large, k), "label"))
    along, back = those.where("ways <> 2").select("src", "dst"), those.where("ways <> 1").select("dst", "src")
    labels, total = settle_counting(those.select("label", F.col("src").alias("id")).union(those.select("label", "dst")).distinct())
    return _Parts(rows, Graph(labels.select("id"), settle(along.union(back))), settle(labels.groupBy("label").agg(F.count("*").alias("size"))), labels, total)


def _eccentricity(p: _Parts, budget: int, sources: DataFrame | None = None) -> DataFrame:
    if sources is None:
        rows, search = p.rows, farthest_inside
    else:
        sources, n = settle_counting(sources.select("id").distinct())
        some = p.vertices().join(beside(sources, n), "id", "left_semi")
        rows, search = p.pairs().union(some.select("bucket", "label", "id", F.lit(None).cast("long"), F.lit(None).cast("int"))), farthest_from_given
    out = rows.groupBy("bucket").applyInArrow(search, "id long, ecc long")
    if p.heavy is None:
        return out
    some = p.heavy.vertices if sources is None else p.heavy.vertices.join(beside(sources, n), "id", "left_semi")
    held = p.labels.join(some, "id").groupBy("label").agg(F.count("*").alias("n")).join(p.sizes, "label").agg(F.sum(F.col("n") * F.col("size"))).first()[0]
    for lot in _lots(some, held or 0, budget):
        out = out.union(settle(bfs_from(p.heavy, lot).groupBy(F.col("source").alias("id")).agg(F.max("dist").alias("ecc"))))
    return out


def eccentricity(g: Graph, keep: Column | None = None, budget: int = BUDGET, sources: DataFrame | None = None, local: int | None = None) -> DataFrame:
    """id and ecc, the greatest distance to a vertex it reaches, of all vertices (or of sources) that fulfil keep; a search doesn't leave those.

    Components of up to `local` edges (LOCAL) are searched each by one task. Vertices of the others are searched in lots; what a search holds is its component, not the graph.
    """
    return _eccentricity(_parts(g, keep, local), budget, sources)


class _Bounds:
    """low and up of all vertices, by searches. A vertex whose bounds meet is assigned.

    A search of depth e at distance d gives max(d, e - d) <= ecc <= e + d. Each search is from the open vertex of a component that promises most (greatest upper and least lower
    bounds in turn, degrees at the start). What hangs on an assigned vertex by its only edge is assigned with one more, if that vertex has another neighbour.
    Light components take one search at a time, each within its task; of the heavy ones the `batch` most promising vertices of all are searched together, or fewer if rows would exceed the budget.
    """

    def __init__(self, p: _Parts, batch: int, budget: int = BUDGET, listen=None):
        self.p, self.listen, self.turn, self.told = p, listen, 0, {}
        zero, none = F.lit(0).cast("long").alias("low"), F.lit(None).cast("long").alias("up")
        self.light, self.light_ends = None, {}
        self.heavy = None
        if p.heavy is not None:
            self.batch = max(1, min(batch, budget // p.total))
            pairs = p.heavy.edges
            degree = pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
            self.heavy = settle(degree.select("id", "degree", zero, none))  # none is alone
            leaf = self.heavy.where("degree = 1").select(F.col("id").alias("leaf"))
            self.hangs = settle(pairs.join(leaf, pairs["src"] == leaf["leaf"]).select("leaf", F.col("dst").alias("id")).join(self.heavy.where("degree > 1").select("id"), "id"))

    def state(self) -> DataFrame:
        """id, low, up (null: not known yet) and light, of all vertices, once light ones were refined."""
        all_ = self.light.select("id", "low", "up", F.lit(True).alias("light"))
        return all_ if self.heavy is None else all_.union(self.heavy.select("id", "low", "up", F.lit(False)))

    def ends(self) -> list[dict]:
        """What _ends says of the light components, as they were last refined, and of the heavy ones."""
        return [self.light_ends, {} if self.heavy is None else self.heavy.agg(*_ends()).first().asDict()]

    def refine_light(self, least: int, greatest: int) -> None:
        """Until no open vertex of a light component has a lower bound of `least` or less, or an upper one of `greatest` or more."""
        none = F.lit(None).cast("long")
        rows = (self.p.rows if self.light is None else self.p.pairs()).withColumns({"low": none, "up": none})
        if self.light is not None:
            rows = rows.union(self.light.select("bucket", "label", "id", none, none.cast("int"), "low", "up"))
        seen = Observation()
        out = settle(rows.groupBy("bucket").applyInArrow(refiner(least, greatest), REFINED).observe(seen, *_ends()))
        self.light_ends = seen.get
        self.light = out.where("turn IS NULL").select("bucket", "label", "id", "low", "up")
        if self.listen:
            what = ("lower", "upper", "assigned", "pruned")
            self.told = {r.turn: {c: r[c] for c in what} for r in out.where("turn IS NOT NULL").groupBy("turn").agg(*(F.sum(c).alias(c) for c in what)).collect()}

    def refine_heavy(self) -> None:
        """One round of searches in the heavy components."""
        state, turn, total = self.heavy, self.turn, self.p.total
        order = [F.desc("degree")] if not turn else [F.desc_nulls_first("up"), F.desc("degree")] if turn % 2 else [F.asc("low"), F.desc("degree")]
        pick = settle(state.where(_OPEN).orderBy(*order, "id").limit(self.batch).select("id"))
        reach = settle(bfs_from(self.p.heavy, pick).select("source", "id", "dist"))
        depth = reach.groupBy("source").agg(F.max("dist").alias("e"))
        bound = reach.join(beside(depth, self.batch), "source").groupBy("id").agg(F.max(F.greatest("dist", F.col("e") - F.col("dist"))).alias("l"), F.min(F.col("e") + F.col("dist")).alias("u"))
        new = state.join(beside(bound, total), "id", "left").select("id", "degree", F.greatest("low", "l").alias("low"), F.least("up", "u").alias("up"), F.col("low").alias("low_was"), F.col("up").alias("up_was"))
        new = settle(new)
        sure = self.hangs.join(beside(new.where("low = up").select("id", F.col("low").alias("ecc")), total), "id").select(F.col("leaf").alias("id"), (F.col("ecc") + 1).alias("ecc"))
        done = new.join(beside(sure, total), "id", "left").withColumn("pruned", F.col("ecc").isNotNull() & (F.col("up").isNull() | (F.col("low") < F.col("up"))))
        done = settle(done.select("id", "degree", F.coalesce("ecc", "low").alias("low"), F.coalesce("ecc", "up").alias("up"), "low_was", "up_was", "pruned"))
        self.heavy, self.turn = done.select("id", "degree", "low", "up"), turn + 1
        if self.listen:
            count = lambda x: F.count_if(F.expr(x))
            c = done.agg(count("NOT pruned AND low > low_was").alias("lower"), count("NOT pruned AND NOT up <=> up_was").alias("upper"), count("NOT pruned AND low = up AND (up_was IS NULL OR low_was < up_was)").alias("assigned"), count("pruned").alias("pruned"))
            inside = self.told.pop(turn + 1, {})
            self.listen(turn + 1, {k: v + inside.get(k, 0) for k, v in c.first().asDict().items()})


_OPEN = "(up IS NULL OR low < up)"


def _ends() -> list[Column]:
    """Over vertices (low is null in other rows): the least lower, greatest upper and greatest lower bound, and the first two of the open ones."""
    up, open_ = F.coalesce("up", F.lit(OPEN)), F.expr(_OPEN) & F.col("low").isNotNull()
    ends = {"low": F.min("low"), "up": F.max(F.when(F.col("low").isNotNull(), up)), "high": F.max("low"), "open_low": F.min(F.when(open_, F.col("low"))), "open_up": F.max(F.when(open_, up))}
    return [x.alias(k) for k, x in ends.items()]


def bounded_eccentricity(g: Graph, batch: int = 64, keep: Column | None = None, listen=None, local: int | None = None) -> DataFrame:
    """id and ecc of an undirected graph (of the part whose vertices fulfil keep, over id) by bounds, until they meet everywhere.

    listen gets the round and a dict of what it did: bounds refined (lower, upper), vertices assigned by their bounds, and vertices pruned, that is assigned from their only neighbour.
    """
    p = _parts(g, keep, local)
    bounds = _Bounds(p, batch, listen=listen)
    if listen:
        bounds.refine_light(-1, 0)
    while bounds.heavy is not None and bounds.heavy.where(_OPEN).limit(1).count():
        bounds.refine_heavy()
    for turn in sorted(bounds.told):
        listen(turn, bounds.told[turn])
    if listen:
        return bounds.state().select("id", F.col("low").alias("ecc"))
    light = p.rows.groupBy("bucket").applyInArrow(assigned, "id long, ecc long")  # nobody asks what searches did: only their result goes on
    return light if p.heavy is None else light.union(bounds.heavy.select("id", "low"))


def hybrid_distribution(g: Graph, share: float, seed: int = 0, batch: int = 64, keep: Column | None = None, budget: int = BUDGET, listen=None, local: int | None = None) -> DataFrame:
    """value and n: a distribution of eccentricities that is exact at centre and periphery, and elsewhere estimated from a share of the vertices.

    Bounds are refined only until no open vertex has the least lower or the greatest upper bound of all. With the least lower bound of open vertices less one (L) and their
    greatest upper bound plus one (R), assigned vertices of L or less, or of R or more, are counted exactly. Of all others a share is drawn by the seed, searched from where
    not yet assigned, and counted 1 / share times each (rounded). With a share of 1 everything is exact. The number searched goes to listen.
    """
    p = _parts(g, keep, local)
    bounds = _Bounds(p, batch, budget)
    bounds.refine_light(-1, OPEN)  # a first search of each component
    while True:
        parts = bounds.ends()
        of = lambda f, k: f((x[k] for x in parts if x.get(k) is not None), default=None)  # noqa: E731, B023
        low, up = of(min, "low"), of(max, "up")
        light, heavy = (x.get("open_low") is not None and (x["open_low"] == low or x["open_up"] == up) for x in parts)
        if light:
            bounds.refine_light(low, of(max, "high"))  # the greatest of all is no less than the greatest lower bound
        elif heavy:
            bounds.refine_heavy()
        else:
            break
    state, low, up = bounds.state(), of(min, "open_low"), of(max, "open_up")
    inside = F.lit(False) if low is None else F.expr(_OPEN) | F.col("low").between(low, up)
    exact = state.where(~inside).select(F.col("low").alias("value"), F.lit(1).cast("long").alias("n"))
    drawn, n = settle_counting(state.where(inside).where(draw(seed, 1 << 30, "id") < round(share * (1 << 30))), _OPEN)
    searched = drawn.where(_OPEN).select("id")
    found = _eccentricity(p, budget, searched).select(F.col("ecc").alias("value")) if n else searched.select(F.col("id").alias("value"))
    if listen:
        listen(n)
    weight = F.lit(round(1 / share)).cast("long").alias("n")
    rows = exact.union(drawn.where(f"NOT {_OPEN}").select("low", weight)).union(found.select("value", weight))
    return rows.groupBy("value").agg(F.sum("n").alias("n"))


def farthest_hops(g: Graph, start: int | None = None, keep: Column | None = None, listen=None) -> list[tuple[int, int]]:
    """From the vertex of greatest degree, hop to the farthest vertex as long as the distance grows; the last distance is a lower bound of the diameter."""
    at, out = max_degree(g).first().id if start is None else start, []
    while True:
        f = farthest(bfs(g, at, keep)).first()
        if f.id is None or f.dist <= (out[-1][1] if out else 0):
            return out
        out.append((f.id, f.dist))
        if listen:
            listen(len(out), *out[-1])
        at = f.id


def two_sweeps(g: Graph, source: int, keep: Column | None = None) -> int:
    """The middle of a shortest path from source to a farthest vertex."""
    reached = settle(bfs(g, source, keep))
    path = shortest_path(reached, farthest(reached).first().id)
    return path[len(path) // 2]


def diameter(g: Graph, source: int, keep: Column | None = None, listen=None, budget: int = BUDGET) -> tuple[int, int]:
    """The diameter of the source's component in an undirected graph, and the number of searches after the first.

    Layers go from the outermost inwards, each in batches that stay in the budget. Vertices at distance d or less are no more than 2 d apart, so it ends as soon as that is reached,
    within a layer too. listen gets each batch's layer, the diameter so far and the searches so far.
    """
    reached, total = settle_counting(bfs(g, source, keep))
    low = layer = reached.agg(F.max("dist")).first()[0]
    searches = 0
    while layer > 0 and low < 2 * layer:
        some, n = settle_counting(reached.where(F.col("dist") == layer).select("id"))
        for lot in _lots(some, n * total, budget):
            if low >= 2 * layer:
                break
            lot, m = settle_counting(lot)
            searches += m
            low = max(low, bfs_from(g, lot, keep).agg(F.max("dist")).first()[0] or 0)
            if listen:
                listen(layer, low, searches)
        layer -= 1
    return low, searches


def diameter_from_random(g: Graph, seed: int = 0, keep: Column | None = None, listen=None) -> tuple[int, int]:
    """The same from the middle of a path from a random vertex."""
    return diameter(g, two_sweeps(g, pick_vertices(g, 1, seed).first().id, keep), keep, listen)
