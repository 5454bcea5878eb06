"""Connected and strongly connected components; a component's label is its least vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.loop import ROWS, beside, kept, settle, settle_counting, until_still
from .inside import LABELLED, components as components_inside, labelled as labelled_inside

#: Pairs whose components one task finds: some hundred MB of arrays.
WHOLE = 4_000_000


def least_ancestors(g: Graph) -> DataFrame:
    """id and label: the least vertex that reaches it along out-edges (itself included)."""
    edges = kept(g.edges.select("src", "dst").where("src <> dst"), "src")
    start, total = settle_counting(g.vertices.select("id", F.col("id").alias("label"), F.lit(True).alias("fresh")))

    def step(s: DataFrame, n: int) -> DataFrame:
        sent = edges.join(beside(s.where("fresh").select(F.col("id").alias("src"), "label"), n), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("got"))
        return s.join(beside(sent, total), "id", "left").select("id", F.least("label", "got").alias("label"), F.coalesce(F.col("got") < F.col("label"), F.lit(False)).alias("fresh"))

    out = until_still(start, step, "fresh", total)
    edges.unpersist()
    return out.select("id", "label")


def connected(g: Graph) -> DataFrame:
    """id and label of weak components: labels of neighbours and labels of labels in turn, so long paths take few supersteps. What a vertex learns goes to its old label too, so
    that where two regions meet the whole region changes, not only its border.

    Labels that fit a broadcast reach the edges where these lie, and nothing is shuffled; beyond that they are merged with the sorted edges and least ones combine before the
    shuffle. The rows of a giant component that look up one label are a skewed join of two shuffles, which Spark splits.
    """
    ids = g.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    both = kept(g.undirected().edges.where("src <> dst").union(ids), "src")  # each vertex is its own neighbour
    start, total = settle_counting(g.vertices.select("id", F.col("id").alias("label"), F.lit(True).alias("fresh")))
    end, other = ("dst", "src") if total <= ROWS else ("src", "dst")

    def step(s: DataFrame, _: int) -> DataFrame:
        near = both.join(beside(s.select(F.col("id").alias(end), "label"), total), end)
        own = F.min(F.when(F.col("src") == F.col("dst"), F.col("label"))).alias("label")
        low = near.groupBy(F.col(other).alias("id")).agg(F.min("label").alias("low"), own)
        hook = F.when(F.col("low") < F.col("label"), F.struct(F.col("label").alias("id"), "low", F.lit(None).cast("long").alias("label")))
        low = low.select(F.inline(F.array_compact(F.array(F.struct("id", "low", "label"), hook)))).groupBy("id").agg(F.min("low").alias("low"), F.max("label").alias("label"))
        jump = beside(s.select(F.col("id").alias("low"), F.col("label").alias("next")), total)
        return low.join(jump, "low").select("id", F.least("low", "next").alias("label"), (F.least("low", "next") < F.col("label")).alias("fresh"))

    out = until_still(start, step, "fresh", total)
    both.unpersist()
    return out.select("id", "label")


def linked(pairs: DataFrame, m: int, whole: int | None = None) -> tuple[DataFrame, int]:
    """id and label, the least vertex of its component, of all ends of m settled pairs (src, dst), and how many these are.

    More than `whole` pairs (WHOLE) are contracted: each vertex goes to the one of its neighbourhood with the least digest, which is another one each round, and on to where that one goes.
    So rounds don't follow depths or the order of ids, and what lies within a vertex is gone in the next. One task finds the components of what is left.
    """
    least, went = WHOLE if whole is None else whole, []
    while m > least:
        rank = lambda c, turn=len(went): F.xxhash64(c, F.lit(turn))
        near = pairs.select(F.col("src").alias("id"), "dst").union(pairs.select("dst", "src")).groupBy("id").agg(F.min_by("dst", rank("dst")).alias("low"))
        to, n = settle_counting(near.select("id", F.when(rank("low") < rank("id"), F.col("low")).otherwise(F.col("id")).alias("label")))  # of equal digests none goes to the other
        to = settle(to.join(beside(to.select(F.col("id").alias("label"), F.col("label").alias("next")), n), "label").select("id", F.col("next").alias("label")))
        end = lambda c: beside(to.select(F.col("id").alias(c), F.col("label").alias(f"{c}_to")), n)  # noqa: E731, B023
        a, b = F.col("src_to"), F.col("dst_to")
        pairs, m = settle_counting(pairs.join(end("src"), "src").join(end("dst"), "dst").where(a != b).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct())
        went.append((to, n))
    labels, n = settle_counting(pairs.repartition(1).mapInArrow(components_inside, "id long, label long"))
    for to, more in reversed(went):
        to = to.join(beside(labels.select(F.col("id").alias("label"), F.col("label").alias("last")), n), "label", "left")
        labels, n = settle(to.select("id", F.coalesce("last", "label").alias("label"))), more
    if went:
        labels = settle(labels.join(beside(labels.groupBy("label").agg(F.min("id").alias("low")), n), "label").select("id", F.col("low").alias("label")))
    return labels, n


def labelled(pairs: DataFrame, m: int, local: int, whole: int | None = None) -> tuple[DataFrame, DataFrame | None, int]:
    """label, src, dst and ways of m settled pairs (src, dst, ways: 1 along src to dst, 2 back, 3 both); the labels of components of more than `local` edges, and how many these are.

    Where one task finds the components it labels the pairs too, and nothing is joined.
    """
    if m <= (WHOLE if whole is None else whole):
        rows, k = settle_counting(pairs.repartition(1).mapInArrow(labelled_inside, LABELLED).repartition("label"), f"weight > {local}")
        large = rows.where(F.col("weight") > local).select("label").distinct() if k else None
        rows = rows.drop("weight")
    else:
        labels, n = linked(pairs.select("src", "dst"), m, whole)
        rows = settle(pairs.join(beside(labels.withColumnRenamed("id", "src"), n), "src").select("label", "src", "dst", "ways"))
        large = rows.groupBy("label").agg(F.sum(F.bit_count("ways")).alias("weight")).where(F.col("weight") > local).select("label")
    return (rows, None, 0) if large is None else (rows, *settle_counting(large))


def sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("size"))


def largest(labels: DataFrame) -> DataFrame:
    """The label with most vertices, the least of equals."""
    return sizes(labels).agg(F.min(F.struct((-F.col("size")).alias("n"), "label")).alias("x")).select(F.col("x.label").alias("label"), (-F.col("x.n")).alias("size"))


def trim(vertices: DataFrame, edges: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices without a remaining in- or out-edge are components of their own: those, and the vertices and edges that stay.

    A round takes what went in the last one off the degrees of its neighbours, and looks at these only; edges are written anew once, at the end.
    """
    edges = edges.select("src", "dst").persist()
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select("src", F.lit(0), F.lit(1)))
    base, total = settle_counting(vertices.select("id").join(ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o")), "id", "left").fillna(0))
    front, n = settle_counting(base.where("i = 0 OR o = 0").select("id"))
    gone, lost, many, turn = front, None, n, 1
    while n and (most is None or turn < most):
        turn += 1
        by = lambda end: beside(front.select(F.col("id").alias(end)), n)
        off = edges.join(by("src"), "src").select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.join(by("dst"), "dst").select(F.col("src").alias("id"), F.lit(0), F.lit(1)))
        off = off.groupBy("id").agg(F.sum("i").alias("di"), F.sum("o").alias("do"))
        off, near = settle_counting(off.join(beside(gone, many), "id", "left_anti"))
        lost = off if lost is None else lost.union(off)
        touched = lost.join(beside(off.select("id"), near), "id", "left_semi").groupBy("id").agg(F.sum("di").alias("di"), F.sum("do").alias("do"))
        front, n = settle_counting(base.join(beside(touched, near), "id").where("i <= di OR o <= do").select("id"))
        gone, many = gone.union(front), many + n
        if turn % 8 == 0:
            gone, lost = settle(gone), settle(lost.groupBy("id").agg(F.sum("di").alias("di"), F.sum("do").alias("do")))
    gone = settle(gone)
    core = settle(base.select("id").join(beside(gone, many), "id", "left_anti"))
    inner = settle(edges.join(beside(gone.select(F.col("id").alias("src")), many), "src", "left_anti").join(beside(gone.select(F.col("id").alias("dst")), many), "dst", "left_anti").select("src", "dst"))
    edges.unpersist()
    return gone, core, inner


def strongly_connected(g: Graph) -> DataFrame:
    """id and label: trim, then colour by the least vertex that reaches one, then keep of each colour what its root is reached from, until none is left."""
    vertices, edges, done = settle(g.vertices.select("id")), settle(g.edges.select("src", "dst").where("src <> dst").distinct()), None
    while True:
        single, vertices, edges = trim(vertices, edges)
        found = single.select("id", F.col("id").alias("label"))
        done = found if done is None else settle(done.union(found))
        if not vertices.limit(1).count():
            return done
        colour, total = settle_counting(least_ancestors(Graph(vertices, edges)))
        c = lambda end: beside(colour.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")), total)
        inside = kept(edges.join(c("src"), "src").join(c("dst"), "dst").where("src_label = dst_label").select("src", "dst"), "dst")
        front, n = settle_counting(colour.where("id = label"))
        reached, many, turn = front, n, 0
        while n:
            back = inside.join(beside(front.select(F.col("id").alias("dst"), "label"), n), "dst").select(F.col("src").alias("id"), "label").distinct()
            front, n = settle_counting(back.join(beside(reached.select("id"), many), "id", "left_anti"))
            reached, many, turn = reached.union(front), many + n, turn + 1
            if turn % 8 == 0:
                reached = settle(reached)
        reached = settle(reached)
        inside.unpersist()
        done = settle(done.union(reached))
        off = lambda end: beside(reached.select(F.col("id").alias(end)), many)
        vertices = settle(vertices.join(off("id"), "id", "left_anti"))
        edges = settle(edges.join(off("src"), "src", "left_anti").join(off("dst"), "dst", "left_anti").select("src", "dst"))


def compose(left: DataFrame, right: DataFrame) -> DataFrame:
    """id and right's label of left's label (left's own where right has none)."""
    r = right.select(F.col("id").alias("__id"), F.col("label").alias("__label"))
    return left.join(r, F.col("label") == F.col("__id"), "left").select("id", F.coalesce("__label", "label").alias("label"))
