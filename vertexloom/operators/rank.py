"""PageRank and local clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.loop import beside, kept, settle
from .metrics import out_degrees


def page_rank(g: Graph, damping: float = 0.85, steps: int = 30, own_share: bool = False) -> DataFrame:
    """id and rank after so many updates.

    Standard: ranks start at 1/N, sinks spread theirs evenly. With own_share, a vertex with out-edges gets (1 - d) + d * (sum of what comes in + its own rank / out-degree), from 0;
    sinks stay at 0 and nothing is normalised.
    """
    deg = out_degrees(g).repartition("id").persist()
    n = deg.count()
    edges = kept(g.edges.select("src", "dst"), "src")
    r = settle(deg.withColumn("rank", F.lit(0.0 if own_share else 1 / max(1, n))))
    for _ in range(steps):
        share = r.where("degree > 0").select(F.col("id").alias("src"), (F.col("rank") / F.col("degree")).alias("share"))
        got = edges.join(beside(share, n), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        got = r.join(beside(got, n), "id", "left").withColumn("got", F.coalesce("got", F.lit(0.0)))
        if own_share:
            new = F.when(F.col("degree") > 0, (1 - damping) + damping * (F.col("got") + F.col("rank") / F.col("degree"))).otherwise(0.0)
        else:
            got = got.crossJoin(F.broadcast(r.agg(F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("rank"))), F.lit(0.0)).alias("lost"))))  # one row
            new = (1 - damping) / max(1, n) + damping * (F.col("got") + F.col("lost") / max(1, n))
        r = settle(got.select("id", "degree", new.alias("rank")))
    edges.unpersist()
    deg.unpersist()
    return r.select("id", "rank")


def triangles(g: Graph) -> DataFrame:
    """Triangles of the undirected graph below g, once each: a, b, c and the directions of ab, ac and bc (1: first to second end, 2: back, 3: both).

    Ends are ordered by degree, then id, and a wedge starts at its least end only: a hub that has millions of neighbours starts next to none,
    and all wedges together are at most of the order of E ^ 1.5.
    """
    way = F.when(F.col("src") < F.col("dst"), 1).otherwise(2)
    pair = g.edges.where("src <> dst").groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg(F.bit_or(way).alias("way")).persist()
    degree = pair.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    end = lambda k: degree.select(F.col("id").alias(k), F.struct("n", F.col("id").alias("i")).alias(f"o{k}"))
    back = F.when(F.col("way") == 3, 3).otherwise(3 - F.col("way"))
    known = pair.join(end("x"), "x").join(end("y"), "y")
    low = known.select(F.when(F.col("ox") < F.col("oy"), F.struct(F.col("x").alias("u"), F.col("oy").alias("w"), F.col("way").alias("f"))).otherwise(F.struct(F.col("y").alias("u"), F.col("ox").alias("w"), back.alias("f"))).alias("e")).select("e.*")
    low = settle(low)
    pair.unpersist()
    wedge = low.select(F.col("u").alias("a"), F.col("w").alias("b"), F.col("f").alias("ab")).join(low.select(F.col("u").alias("a"), F.col("w").alias("c"), F.col("f").alias("ac")), "a").where(F.col("b") < F.col("c"))
    wedge = wedge.select("a", F.col("b.i").alias("b"), F.col("c.i").alias("c"), "ab", "ac")
    return wedge.join(low.select(F.col("u").alias("b"), F.col("w.i").alias("c"), F.col("f").alias("bc")), ["b", "c"]).select("a", "b", "c", "ab", "ac", "bc")


def clustering(g: Graph) -> DataFrame:
    """id and coefficient: over out-neighbours n of v, the common out-neighbours of v and n other than both, by d (d - 1); 0 where d < 2.

    Both come from triangles: v counts one for each direction of the opposite side, if it has edges to both its ends. A self-loop makes v its own neighbour, with d - 1 in common.
    """
    on = lambda c, bit: F.col(c).bitwiseAND(bit) / bit
    both = lambda c: F.when(F.col(c) == 3, 2.0).otherwise(1.0)
    at = lambda v, t: F.struct(F.col(v).alias("id"), t.alias("t"))
    each = F.array(at("a", on("ab", 1) * on("ac", 1) * both("bc")), at("b", on("ab", 2) * on("bc", 1) * both("ac")), at("c", on("ac", 2) * on("bc", 2) * both("ab")))
    closed = triangles(g).select(F.explode(each).alias("x")).where("x.t > 0").groupBy("x.id").agg(F.sum("x.t").alias("t"))
    loops = g.edges.where("src = dst").select(F.col("src").alias("id"), F.lit(1).alias("loop")).distinct()
    own = F.coalesce("t", F.lit(0.0)) + F.coalesce("loop", F.lit(0)) * (F.col("degree") - 1)
    rate = F.when(F.col("degree") > 1, own / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return out_degrees(g).join(closed, "id", "left").join(loops, "id", "left").select("id", rate.alias("coefficient"))
