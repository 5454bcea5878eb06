"""The hand graph, sources and snapshots, and properties that must hold between operators."""

import random
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vertexloom import queries
from vertexloom.graph import Graph
from vertexloom.operators import attributes, components, extent, generate, metrics, rank, traverse
from vertexloom.plans import loop
from vertexloom.sources import text
from vertexloom.streaming import edges


@pytest.fixture(scope="module")
def h(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (1, 2), (None, 3)], "src long, dst long")
    return Graph.from_edges(e, spark.createDataFrame([(7,)], "id long"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_hand_graph(h):
    assert rows(metrics.summary(h)) == [(7, 7, 1.0)]
    assert rows(metrics.degree_distribution(h)) == [(0, 1), (1, 5), (2, 1)]
    assert rows(metrics.max_degree(h)) == [(3, 2)]
    assert rows(metrics.neighbourless(h)) == [(1,)]
    assert rows(metrics.two_cycles(h)) == [(3,)]
    assert rows(metrics.edge_locality(h, 2))[0][:2] == (2, 7)
    assert rows(traverse.bfs(h, 1).select("id", "dist")) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert rows(components.connected(h)) == [*((i, 1) for i in range(1, 6)), (6, 6), (7, 7)]
    assert rows(components.strongly_connected(h)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7)]
    assert {c for _, c in rows(rank.clustering(h))} == {0.0}
    u = h.undirected()
    assert [(i, round(c, 6)) for i, c in rows(rank.clustering(u))] == [(1, 1.0), (2, 1.0), (3, 0.333333), (4, 0.0), (5, 0.0), (6, 0.0), (7, 0.0)]
    ecc = [(1, 3), (2, 3), (3, 2), (4, 2), (5, 3), (6, 0), (7, 0)]
    assert rows(extent.eccentricity(u)) == ecc and rows(extent.bounded_eccentricity(u, 1)) == ecc
    assert extent.two_sweeps(u, 1) == 4 and extent.diameter(u, 4)[0] == 3
    assert extent.farthest_hops(u, 3) == [(5, 2), (1, 3)]
    literal = dict(rows(rank.page_rank(h, own_share=True)))
    assert abs(literal[1] - 8703.172154) < 1e-5 and abs(literal[4] - 3065928.860333) < 1e-4 and literal[7] == 0


def test_weighted_paths(spark):
    e = spark.createDataFrame([(1, 2, 5.0), (1, 3, 1.0), (3, 2, 1.0), (2, 4, 1.0)], "src long, dst long, w double")
    g = Graph.from_edges(e)
    assert rows(traverse.shortest_distances(g, 1, "w")) == [(1, 0.0, -1), (2, 2.0, 3), (3, 1.0, 1), (4, 3.0, 2)]
    assert traverse.shortest_path(traverse.bfs(g, 1), 4) == [1, 2, 4]
    with pytest.raises(ValueError, match="not reached"):
        traverse.shortest_path(traverse.bfs(g, 4), 1)


def test_empty_graph(spark):
    g = generate.empty(spark, 0)
    assert rows(metrics.max_degree(g)) == [(-1, -1)] and rows(components.connected(g)) == [] and rows(components.strongly_connected(g)) == [] and rows(rank.page_rank(g, steps=2)) == []


def test_walks_and_clique(spark):
    g = generate.chain(spark, 5, cycle=True)
    assert sum(n for _, n in rows(traverse.random_walk(g, g.vertices, 4))) == 20  # the start is the first of a walker's visits
    clique = Graph.from_edges(spark.range(5).toDF("src").crossJoin(spark.range(5).toDF("dst")).where("src <> dst"))
    assert {c for _, c in rows(rank.clustering(clique))} == {1.0}


def test_sources(spark, tmp_path):
    p = tmp_path / "e.txt"
    p.write_text("# a comment\n1 2\n2\t3 3 1\n\n1 2\n")
    assert rows(text.edge_list(spark, str(p)).edges) == [(1, 2), (2, 3), (3, 1)]
    assert text.edge_list(spark, str(p), multigraph=True).edges.count() == 4 and text.one_vertex(spark, str(p)) == 1
    a = tmp_path / "a.txt"
    a.write_text("1 2 2 3\n4 0\n")
    g = text.adjacency_list(spark, str(a))
    assert rows(g.edges) == [(1, 2), (1, 3)] and rows(g.vertices) == [(1,), (2,), (3,), (4,)]
    t = tmp_path / "t.tsv"
    t.write_text("1\t3000000000\n5\t6\n")
    assert rows(text.profile(spark, str(t))) == [(3000000000, 2, 4, True)]
    assert rows(text.partition_file(spark, str(a)).limit(1)) == [(1, 2)]
    s = str(tmp_path / "snap")
    assert text.load_or_build(spark, str(p), s).edges.count() == 3
    time.sleep(0.05)
    assert text.load_or_build(spark, str(p), s).vertices.agg(F.sum("id")).first()[0] == 6


def test_adjacency_records_over_lines(spark, tmp_path):
    a = tmp_path / "a.txt"
    a.write_text("# header\n1 3 2\n3 4 2 2\n1 1 5 0\n1 1 9\n")
    g = text.adjacency_list(spark, str(a))
    assert rows(g.edges) == [(1, 9), (2, 1), (2, 1)] and rows(g.vertices) == [(1,), (2,), (5,), (9,)]
    b = tmp_path / "b.txt"
    b.write_text("1 2 2 3\n4 0\n1 1 4\n")
    assert rows(text.adjacency_list(spark, str(b)).edges) == [(1, 4)]  # the last record of a source counts


def test_edge_list_report(spark, tmp_path):
    p = tmp_path / "e.txt"
    p.write_text("1 2\n1 2\n2 1\n3 3\n")
    assert rows(text.edge_list_report(spark, str(p))) == [(4, 3, 1)]


def test_clustering_of_directed_edges_and_loops(spark):
    pairs = {(i, j) for i in range(9) for j in range(9) if (i * i + 3 * j) % 4 < 2}
    n = {v: {b for a, b in pairs if a == v} for v in range(9)}
    want = {v: (sum(len((n[v] & n[x]) - {v, x}) for x in n[v]) / (len(n[v]) * (len(n[v]) - 1)) if len(n[v]) > 1 else 0.0) for v in n}
    got = dict(rows(rank.clustering(Graph.from_edges(spark.createDataFrame(sorted(pairs), "src long, dst long"), spark.range(9)))))
    assert set(got) == set(want) and all(abs(got[v] - want[v]) < 1e-12 for v in want)


def test_visit_order_and_lookups(spark, h):
    assert rows(traverse.visit_order(traverse.bfs(h, 1))) == [(0, 1, 0), (1, 2, 1), (2, 3, 2), (3, 4, 3), (4, 5, 4)]
    asked = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    assert rows(attributes.has_edge(h, asked)) == [(1, 2, True), (2, 1, False)]
    values = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, None)], "id long, v long")
    assert rows(attributes.extreme(values, "v")) == [(2, 9)] and rows(attributes.extreme(values, "v", False)) == [(1, 5)]
    assert rows(attributes.extreme(values.where("false"), "v")) == []
    assert rows(h.in_adjacency().where("id = 3")) == [(3, [2])]


def test_edges_of_a_stream_come_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    batch = lambda pairs: spark.createDataFrame(pairs, "src long, dst long").coalesce(1).write.mode("append").parquet(str(src))
    take = lambda: edges.ingest(spark.readStream.schema("src long, dst long").parquet(str(src)), out)
    batch([(1, 2), (1, 2), (None, 3)])
    take()
    batch([(1, 2), (2, 3)])
    take()
    take()
    assert rows(spark.read.parquet(f"{out}/edges")) == [(1, 2), (2, 3)]
    assert rows(edges.ingested(spark, out).vertices) == [(1,), (2,), (3,)]


def test_walkers_at_one_vertex_go_their_own_ways(spark):
    star = Graph.from_edges(spark.range(1, 50).select(F.lit(0).alias("src"), F.col("id").alias("dst")))
    at = dict(rows(traverse.random_walk(star, spark.range(20).select(F.lit(0).cast("long").alias("id")), 2)))
    assert at.pop(0) == 20 and sum(at.values()) == 20 and len(at) > 10


def test_numbers_of_an_edge_list_are_one_stream(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("1\n2 3\n# 9 9\n4\n5 6 7\n8\n")
    (tmp_path / "a" / "y.txt").write_text("10 11 12\n13 14\n")  # the last one has no partner, nor does it get one from another file
    assert rows(text.edge_list(spark, str(tmp_path / "a")).edges) == [(1, 2), (3, 4), (5, 6), (7, 8), (10, 11), (12, 13)]


def test_snapshots_know_their_kind(spark, tmp_path):
    p, s = tmp_path / "e.txt", str(tmp_path / "snap")
    p.write_text("1 2\n1 2\n2 3\n")
    assert text.Snapshot(text.EdgeList(str(p), multigraph=True), s).graph(spark).edges.count() == 3
    assert text.load(spark, s).multigraph
    time.sleep(0.05)
    for how in ({}, {"undirected": True, "multigraph": True}):
        with pytest.raises(ValueError, match="snapshot"):
            text.load_or_build(spark, str(p), s, **how)
    assert rows(text.load_or_build(spark, str(p), s, force=True, undirected=True).edges) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    text.save_result(spark.range(3), s + "r")
    assert text.load_result(spark, s + "r").count() == 3
    a = tmp_path / "a.txt"
    a.write_text("1 1 2\n3 0\n")
    assert rows(text.AdjacencyList(str(a)).graph(spark).vertices) == [(1,), (2,), (3,)]


def brute_distances(pairs, start):
    near, seen, front, depth = {}, {start: 0}, [start], 0
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    while front:
        depth += 1
        front = sorted({y for x in front for y in near.get(x, ())} - seen.keys())
        seen |= dict.fromkeys(front, depth)
    return seen


@pytest.fixture(scope="module")
def web(spark):
    """A tree-like undirected graph with leaves, a few cycles, a pair of its own and a lone vertex."""
    r = random.Random(6)
    some = {(i, r.randrange(max(0, i - 9), i)) for i in range(1, 30)} | {(5, 25), (17, 23), (70, 71), (8, 8)}
    pairs = sorted({(a, b) for a, b in some} | {(b, a) for a, b in some})
    return pairs, Graph.from_edges(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(80,)], "id long"))


@pytest.mark.parametrize("budget", [0, None])
def test_tables_too_large_for_a_broadcast(web, monkeypatch, budget):
    """Loops give the same with merges as with broadcasts."""
    if budget is not None:
        monkeypatch.setattr(loop, "ROWS", budget)
        monkeypatch.setattr(components, "ROWS", budget)
    pairs, g = web
    dist = brute_distances(pairs, 0)
    assert dict(rows(traverse.bfs(g, 0).select("id", "dist"))) == dist
    assert dict(rows(components.connected(g))) == {v: 0 if v in dist else 70 if v in (70, 71) else v for v in [*dist, 70, 71, 80]}
    chain = Graph.from_edges(g.vertices.sparkSession.createDataFrame([(i, i + 1) for i in range(12)] + [(30, 31), (31, 30), (31, 5)], "src long, dst long"))
    gone, core, inner = components.trim(chain.vertices, chain.edges)
    assert rows(gone) == [(i,) for i in range(13)] and rows(core) == [(30,), (31,)] and rows(inner) == [(30, 31), (31, 30)]
    assert len(rows(components.trim(chain.vertices, chain.edges, 2)[0])) == 4
    assert dict(rows(components.strongly_connected(chain))) == {**{i: i for i in range(13)}, 30: 30, 31: 30}


def test_paths_levels_and_expansion(spark, web):
    pairs, g = web
    chain = generate.chain(spark, 40)
    reached = traverse.bfs(chain, 3)
    assert traverse.shortest_path(reached, 39) == list(range(3, 40)) and traverse.shortest_path(reached, 3) == [3] and traverse.rounds(reached) == 37
    assert max(d for _, d in rows(traverse.bfs(chain, 3, expand_if=F.col("id") < 10).select("id", "dist"))) == 7
    dist, seen = brute_distances(pairs, 0), []
    order = rows(traverse.visit_order(traverse.bfs(g, 0, listen=lambda depth, front: seen.append(depth))))
    assert order == [(k, v, d) for k, (d, v) in enumerate(sorted((d, v) for v, d in dist.items()))] and seen == list(range(1, max(dist.values()) + 2))


def test_eccentricities(spark, web):
    pairs, g = web
    far = lambda keep: {v: max(brute_distances([(a, b) for a, b in pairs if keep(a) and keep(b)], v).values()) for v in [*range(30), 70, 71, 80] if keep(v)}
    ecc, told = far(lambda v: True), []
    assert dict(rows(extent.eccentricity(g))) == ecc == dict(rows(extent.eccentricity(g, budget=600)))
    assert dict(rows(extent.bounded_eccentricity(g, 5, listen=lambda turn, did: told.append(did)))) == ecc
    assert sum(x["pruned"] for x in told) > 0 and sum(x["assigned"] + x["pruned"] for x in told) == len(ecc) and all(x["lower"] >= 0 and x["upper"] >= 0 for x in told)
    some = far(lambda v: v % 7 != 3)
    assert dict(rows(extent.bounded_eccentricity(g, 9, F.col("id") % 7 != 3))) == some
    whole = {e: list(ecc.values()).count(e) for e in ecc.values()}
    assert dict(rows(extent.hybrid_distribution(g, 1.0, batch=4))) == whole
    searched = []
    half = dict(rows(extent.hybrid_distribution(g, 0.5, batch=9, listen=searched.append)))
    assert max(half) == max(whole) and half[max(whole)] == whole[max(whole)] and set(half) <= set(whole) and searched[0] < len(ecc)


@pytest.fixture(scope="module")
def crowd(spark):
    """Pairs, eccentricities and the undirected graph of 60 components of 2 to 13 vertices."""
    r, pairs = random.Random(4), set()
    for c in range(60):
        some = r.sample(range(20 * c, 20 * c + 20), 2 + c % 12)
        pairs |= {(v, some[r.randrange(max(0, i - 3), i)]) for i, v in enumerate(some) if i}
    pairs |= {(b, a) for a, b in pairs}
    ecc = {v: max(brute_distances(sorted(pairs), v).values()) for v in {a for a, _ in pairs}}
    return sorted(pairs), ecc, Graph.from_edges(spark.createDataFrame(sorted(pairs), "src long, dst long"))


def jobs(spark, name, f):
    """What f returns, and how many jobs it took."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        return f(), len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def counted(ecc):
    return sorted((e, list(ecc.values()).count(e)) for e in set(ecc.values()))


def test_hybrid_distribution_of_many_components(spark, crowd):
    """A round doesn't take its searches from the whole graph: however many components there are, the jobs don't follow them, and a share of 1 is exact."""
    _, ecc, g = crowd
    searched = []
    whole, n = jobs(spark, "hybrid", lambda: rows(extent.hybrid_distribution(g, 1.0, batch=2, budget=1000, listen=searched.append)))
    assert whole == counted(ecc) and n < 150 and 0 < searched[0] < len(ecc)
    half = dict(rows(extent.hybrid_distribution(g, 0.5, batch=2)))
    assert max(half) == max(ecc.values()) and half[max(half)] == dict(whole)[max(half)] and set(half) <= set(ecc.values())


def test_bounds_of_many_components(spark, crowd):
    """Rounds don't follow the number of components (which took the batch of them in turn)."""
    _, ecc, g = crowd
    told = []
    got, n = jobs(spark, "bounds", lambda: rows(extent.bounded_eccentricity(g, 2, listen=lambda turn, did: told.append(did))))
    assert dict(got) == ecc and n < 100
    assert sum(x["pruned"] for x in told) > 0 and sum(x["assigned"] + x["pruned"] for x in told) == len(ecc)


def test_searches_of_many_components(spark, crowd):
    """Lots follow what searches hold, their components, not the whole graph."""
    _, ecc, g = crowd
    got, n = jobs(spark, "searches", lambda: rows(extent.eccentricity(g, budget=5000)))
    assert dict(got) == ecc and n < 100


def test_components_by_contraction(spark):
    """Pairs that one task may not hold are contracted; neither depth nor the order of ids matters."""
    r = random.Random(9)
    pairs = {(i, i + 1) for i in range(200)} | {(i + 1, i) for i in range(300, 400)} | {(r.randrange(500, 700), r.randrange(500, 700)) for _ in range(120)} | {(900, i) for i in range(800, 860)}
    pairs = sorted((a, b) for a, b in pairs if a != b)
    both = [p for a, b in pairs for p in ((a, b), (b, a))]
    least = {v: min(brute_distances(both, v)) for v in {a for a, _ in both}}
    some = loop.settle(spark.createDataFrame(pairs, "src long, dst long"))
    for whole in (None, 40, 0):
        labels, n = components.linked(some, len(pairs), whole)
        assert dict(rows(labels)) == least and n == len(least)


def test_bounds_take_no_supersteps(spark, crowd):
    """Not for the components either, which took jobs by their depth."""
    _, ecc, g = crowd
    got, n = jobs(spark, "few_bounds", lambda: rows(extent.bounded_eccentricity(g, 2)))
    assert dict(got) == ecc and n < 20


def test_hybrid_distribution_takes_few_jobs(spark, crowd):
    """Where bounds stand is told by what refined them; components take no supersteps."""
    _, ecc, g = crowd
    got, n = jobs(spark, "few_hybrid", lambda: rows(extent.hybrid_distribution(g, 1.0, batch=2)))
    assert got == counted(ecc) and n < 24


def test_distribution_of_bounds_takes_no_supersteps(spark, crowd):
    _, ecc, g = crowd
    got, n = jobs(spark, "few_counted", lambda: rows(metrics.distribution(extent.bounded_eccentricity(g, 2), "ecc")))
    assert got == counted(ecc) and n < 20


def test_pairs_in_parts(spark):
    """Half of a symmetric graph's edges, all of another's: the same parts, whether one task finds the components or they are contracted first. Ends of loops are alone only without a pair."""
    r = random.Random(5)
    one_way = sorted({(a, b) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(30)) if a != b} | {(1, 1), (77, 77)})
    both = sorted({p for a, b in one_way for p in ((a, b), (b, a))})
    g = Graph.from_edges(spark.createDataFrame(one_way, "src long, dst long"))
    u = Graph.from_edges(spark.createDataFrame(one_way, "src long, dst long"), undirected=True)
    some = u.without_edges(spark.createDataFrame([both[0]], "src long, dst long"))
    for graph, edges in ((g, one_way), (u, both), (g.undirected(), both), (some, both[1:]), (u.with_vertices(spark.range(90, 92)), both + [(90, 90), (91, 91)])):
        p, pairs = extent._parts(graph, None, None), {(a, b) for a, b in edges if a != b}
        assert sorted((x, y) for x, y, ways in rows(p.pairs().select("id", "dst", "ways")) for x, y in [(x, y)] * (ways & 1) + [(y, x)] * (ways >> 1)) == sorted(pairs)
        least = {v: min(brute_distances([q for a, b in pairs for q in ((a, b), (b, a))], v)) for v in {v for e in edges for v in e}}
        assert {v: label for label, v in rows(p.vertices().select("label", "id"))} == least
    pairs = loop.settle(u.edges.where("src < dst").selectExpr("src", "dst", "3 AS ways"))
    for local in (0, 4, 100):
        (a, _, k), (b, _, j) = (components.labelled(pairs, 100, local, whole) for whole in (100, 0))
        assert rows(a) == rows(b) and k == j


def test_distribution_of_bounds_keeps_only_results(spark, tmp_path):
    """A star of three is two rows, not one for each vertex and direction, and bounds that nobody listens to aren't written."""
    pairs = spark.createDataFrame([(3 * i, 3 * i + k) for i in range(50) for k in (1, 2)], "src long, dst long")
    g = Graph.from_edges(pairs, undirected=True)
    p = extent._parts(g, None, None)
    assert p.rows.count() == 100
    got, n = jobs(spark, "only_results", lambda: rows(metrics.distribution(extent.bounded_eccentricity(g, 2), "ecc")))
    assert got == [(1, 50), (2, 100)] and n < 12


def test_searches_take_no_supersteps(spark, crowd):
    """Not for the components either, also where only some are searched from."""
    _, ecc, g = crowd
    got, n = jobs(spark, "few_searches", lambda: rows(extent.eccentricity(g)))
    assert dict(got) == ecc and n < 20
    some = sorted(ecc)[::7]
    assert dict(rows(extent.eccentricity(g, sources=spark.createDataFrame([(v,) for v in some], "id long")))) == {v: ecc[v] for v in some}


def test_searches_keep_only_results(spark, crowd):
    """What light components give isn't written before it is asked for, nor are rows of vertices made that pairs have; a source need not be in a pair."""
    _, ecc, g = crowd
    got, n = jobs(spark, "only_searches", lambda: rows(extent.eccentricity(g)))
    assert dict(got) == ecc and n < 11
    u = Graph.from_edges(spark.createDataFrame([(1, 2), (2, 3), (5, 5), (3, 3)], "src long, dst long"), undirected=True)
    assert rows(extent.eccentricity(u)) == [(1, 2), (2, 1), (3, 2), (5, 0)]
    assert rows(extent.eccentricity(u, sources=spark.createDataFrame([(5,), (3,), (8,)], "id long"))) == [(3, 2), (5, 0)]
    assert rows(extent.eccentricity(u, sources=spark.createDataFrame([(2,)], "id long"))) == [(2, 1)]


def test_heavy_and_light_components(spark):
    """The same, whether components are searched within a task or by supersteps."""
    pairs = [p for a, b in ((1, 2), (2, 3), (3, 4), (3, 1), (70, 71)) for p in ((a, b), (b, a))]
    g = Graph.from_edges(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(80,)], "id long"))
    ecc, told = {1: 2, 2: 2, 3: 1, 4: 2, 70: 1, 71: 1, 80: 0}, []
    assert dict(rows(extent.eccentricity(g, budget=12, local=2))) == ecc  # 70 and 71 within a task
    assert dict(rows(extent.bounded_eccentricity(g, 3, listen=lambda turn, did: told.append(did), local=2))) == ecc
    assert sum(x["assigned"] + x["pruned"] for x in told) == len(ecc)
    assert rows(extent.hybrid_distribution(g, 1.0, batch=2, local=0)) == counted(ecc)


def test_diameters_and_listeners(spark, web):
    pairs, g = web
    ecc = {v: max(brute_distances(pairs, v).values()) for v in range(30)}
    batches, hops, steps = [], [], []
    for budget in (extent.BUDGET, 100):
        assert extent.diameter(g, extent.two_sweeps(g, 0), listen=lambda *x: batches.append(x), budget=budget)[0] == max(ecc.values())
    assert batches and all(low >= 2 for _, low, _ in batches)
    one = Graph.from_edges(g.edges.where("src < 30"))
    assert extent.diameter_from_random(one, 5)[0] == max(ecc.values())
    assert extent.farthest_hops(g, 0, listen=lambda *x: hops.append(x)) == [h[1:] for h in hops] != []
    low = attributes.pregel(g, F.col("id"), F.col("value"), F.min, F.least("value", "message"), listen=lambda turn, n: steps.append((turn, n)))
    assert dict(rows(low)) == {v: 0 if v < 30 else 70 if v in (70, 71) else v for v in [*range(30), 70, 71, 80]} and steps[-1][1] == 0


def test_attributes_are_set(spark):
    g = Graph.from_edges(spark.createDataFrame([(1, 2)], "src long, dst long"))
    new = spark.createDataFrame([(1, 5), (1, 7), (9, 9)], "id long, attr long")
    one = attributes.set_vertex_attribute(g, new, "size", F.lit(0))
    assert rows(one.vertices) == [(1, 7), (2, 0)]
    two = attributes.set_vertex_attribute(one, spark.createDataFrame([(2, 3)], "id long, attr long"), "size")
    assert rows(two.vertices) == [(1, 7), (2, 3)]
    values = spark.createDataFrame([(1, 2, 1)], "src long, dst long, attr long")
    assert rows(attributes.set_edge_attribute(values, spark.createDataFrame([(1, 2, 4), (1, 2, 3)], "src long, dst long, attr long"))) == [(1, 2, 4)]


def test_generated_graphs(spark):
    assert rows(generate.grid(spark, 2, 2, directed=True).edges) == [(0, 1), (0, 2), (1, 3), (2, 3)]
    assert len(rows(generate.grid(spark, 3, 2).edges)) == 14
    assert rows(generate.chain(spark, 3).edges) == [(0, 1), (1, 2)] and rows(generate.chain(spark, 0).edges) == []
    degree = dict(rows(metrics.out_degrees(generate.random(spark, 300, 0, 5, seed=4))))
    assert len(degree) == 300 and min(degree.values()) == 0 and 4 <= max(degree.values()) <= 5


def test_two_cycles_estimate_is_of_a_share(spark):
    g = Graph.from_edges(spark.range(400).select(F.col("id").alias("src"), ((F.col("id") + 1) % 400).alias("dst")), undirected=True)
    assert rows(metrics.two_cycles(g)) == [(800,)]
    n = rows(metrics.two_cycles_estimate(g, 4))[0][0]
    assert n % 4 == 0 and abs(n - 800) < 250 and rows(metrics.two_cycles_estimate(g, 1)) == [(800,)]


def test_entry_without_the_text_operators():
    """The graph queries are there when the text operators or what these need can't be imported."""
    code = "import sys; sys.modules['{0}'] = None; import __spark_entry__ as e; n = e.queries(); assert {{'bfs_distance', 'lcc'}} <= set(n) and len(n) > 80; assert {1} or not any(k.startswith('op') for k in n); assert set(e.oracle_sql()) <= set(n)"
    for name, later in (("vertexloom.llm", False), ("corpus_pipeline", False), ("public_tokenizers", False), ("tokenizers", True), ("tiktoken", True)):  # some are needed only by the workers
        done = subprocess.run([sys.executable, "-c", code.format(name, later)], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
        assert not done.returncode, done.stderr


def test_walks_start_at_every_vertex(spark):
    d = "/root/testdata/sf0.001"
    walks = queries.QUERIES["random_walk"](spark, d)
    n = queries.succession(spark, d, True).vertices.count()  # no vertex of an undirected graph is a sink
    assert walks.agg(F.sum("visits")).first()[0] == 5 * n
