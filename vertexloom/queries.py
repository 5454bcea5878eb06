"""The registered queries of the graph engine, over graphs derived from the tables, and DuckDB SQL for their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .operators import attributes, components, extent, generate, metrics, rank, traverse
from .plans.loop import numbered, settle, shared_folder
from .sources import text
from .streaming import edges

PARTS = 4
_SUCC = """SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst
FROM {lineitem}) WHERE dst IS NOT NULL"""
_KIN = """SELECT DISTINCT src, dst FROM (SELECT l_orderkey AS src, lead(l_orderkey) OVER (PARTITION BY {alike} ORDER BY l_shipdate, l_orderkey) AS dst
FROM {lineitem}) WHERE src <> dst"""
#: What lines of one chain of a kinship graph have in common: orders form one large component and hundreds of small ones, or small ones only; both are deep.
WIDE, NARROW = "l_partkey, l_quantity", "l_partkey, l_quantity, l_returnflag"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def succession(spark: SparkSession, sf_dir: str, undirected: bool = False, hold: bool = False) -> Graph:
    """Parts that follow one another in an order, of all lines; for loops, which read it several times, its edges are settled."""
    e = spark.sql(_SUCC.format(lineitem="{lines}"), lines=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return Graph.from_edges(settle(e) if hold else e, undirected=undirected)


def kinship(spark: SparkSession, sf_dir: str, alike: str, undirected: bool = False) -> Graph:
    """Orders that follow one another, by the day a line was shipped, among all lines that are alike. All its queries are loops, so its edges are settled."""
    e = spark.sql(_KIN.format(lineitem="{lines}", alike=alike), lines=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return Graph.from_edges(settle(e), undirected=undirected)


def priced(spark: SparkSession, sf_dir: str) -> Graph:
    """succession of all lines with the parts' sizes as vertex attributes."""
    g = succession(spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("attr"))
    return Graph(g.vertices.join(part, "id", "left").select("id", F.coalesce("attr", F.lit(0)).alias("attr")), g.edges)


def _e(alike: str = "", undirected: bool = False) -> str:
    s = _KIN.format(lineitem="lineitem", alike=alike) if alike else _SUCC.format(lineitem="lineitem")
    return f"e AS (SELECT * FROM ({s}) UNION SELECT dst, src FROM ({s}))" if undirected else f"e AS ({s})"


_V = "v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"
_D = "d AS (SELECT v.id, count(e.src) AS degree FROM v LEFT JOIN e ON v.id = e.src GROUP BY v.id)"


def _bfs(only: str = "", start: str = "(SELECT min(id) FROM v)") -> str:
    return f"b(id, dist) USING KEY (id) AS (SELECT {start} AS id, 0::BIGINT AS dist UNION SELECT e.dst, min(b.dist) + 1 FROM b JOIN e ON e.src = b.id WHERE e.dst NOT IN (SELECT id FROM recurring.b){only} GROUP BY e.dst)"


_PRED = "FROM b LEFT JOIN (SELECT e.dst, p.id, p.dist FROM e JOIN b AS p ON p.id = e.src) AS p ON p.dst = b.id AND p.dist = b.dist - 1 GROUP BY b.id, b.dist"
_REACH = "r(a, b) USING KEY (a, b) AS (SELECT id, id FROM v UNION SELECT DISTINCT r.a, e.dst FROM r JOIN e ON e.src = r.b WHERE (r.a, e.dst) NOT IN (SELECT (a, b) FROM recurring.r))"
#: The least vertex that reaches each one.
_LOW = "l(id, label) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT e.dst, min(l.label) FROM l JOIN e ON e.src = l.id JOIN recurring.l AS k ON k.id = e.dst WHERE l.label < k.label GROUP BY e.dst)"
_ALL = "w(s, id, dist) USING KEY (s, id) AS (SELECT id, id, 0::BIGINT FROM v UNION SELECT DISTINCT w.s, e.dst, w.dist + 1 FROM w JOIN e ON e.src = w.id WHERE (w.s, e.dst) NOT IN (SELECT (s, id) FROM recurring.w)), x AS (SELECT s AS id, max(dist) AS ecc FROM w GROUP BY s)"
#: With predecessors (the least of the level before) and the path from the least vertex to the farthest.
_PATH = f"q AS (SELECT b.id, b.dist, min(p.id) AS pred {_PRED}), path AS (SELECT * FROM (SELECT * FROM q ORDER BY dist DESC, id LIMIT 1) UNION ALL SELECT q.id, q.dist, q.pred FROM path JOIN q ON q.id = path.pred)"


def _draw(seed: int, *of: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(of)})), 1, 15))::BIGINT"


def _with(*parts: str, end: str) -> str:
    return f"WITH RECURSIVE {', '.join(parts)} {end}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(_with(_e(), _V, end="SELECT count(*) AS vertices FROM v"))
def vertex_count(spark, d):
    return metrics.vertex_count(succession(spark, d))


@query(_with(_e(), _V, end="SELECT count(*) AS vertices FROM v WHERE id % 3 = 1"))
def vertex_count_filtered(spark, d):
    return metrics.vertex_count(succession(spark, d), F.col("id") % 3 == 1)


@query(_with(_e(), end="SELECT count(*) AS edges FROM e"))
def edge_count(spark, d):
    return metrics.edge_count(succession(spark, d))


@query(_with(_e(), _V, end="SELECT (SELECT count(*) FROM v) AS vertices, count(*) AS edges, round(count(*) / (SELECT count(*) FROM v), 6) AS average FROM e"))
def avg_degree(spark, d):
    return metrics.summary(succession(spark, d)).withColumn("average", F.round("average", 6))


@query(_with(_e(), _V, _D, end="SELECT id, degree FROM d ORDER BY degree DESC, id LIMIT 1"))
def max_degree(spark, d):
    return metrics.max_degree(succession(spark, d))


@query(_with(_e(), _V, _D, end="SELECT id, degree FROM d"))
def out_degrees(spark, d):
    return metrics.out_degrees(succession(spark, d))


@query(_with(_e(), _V, _D, end="SELECT degree AS value, count(*) AS n FROM d GROUP BY degree"))
def degree_distribution(spark, d):
    return metrics.degree_distribution(succession(spark, d))


@query(_with(_e(), _V, end="SELECT count(*) AS n FROM v WHERE id NOT IN (SELECT src FROM e)"))
def neighborless_count(spark, d):
    return metrics.neighbourless(succession(spark, d))


@query(
    _with(
        _e(),
        _V,
        end=f"SELECT part, sum(a)::BIGINT AS vertices, sum(b)::BIGINT AS out_edges, sum(c)::BIGINT AS in_edges FROM (SELECT id % {PARTS} AS part, 1 AS a, 0 AS b, 0 AS c FROM v UNION ALL SELECT src % {PARTS}, 0, 1, 0 FROM e UNION ALL SELECT dst % {PARTS}, 0, 0, 1 FROM e) GROUP BY part",
    )
)
def edges_vertices_per_part(spark, d):
    return metrics.per_part(succession(spark, d), PARTS)


@query(_with(_e(), end=f"SELECT sum((src % {PARTS} = dst % {PARTS})::INT)::BIGINT AS local, count(*) AS total, round(sum((src % {PARTS} = dst % {PARTS})::INT) / count(*), 6) AS ratio FROM e"))
def edge_locality(spark, d):
    return metrics.edge_locality(succession(spark, d), PARTS)


@query(_with(_e(), end="SELECT count(*) AS n FROM e JOIN e AS f ON e.src = f.dst AND e.dst = f.src"))
def two_cycles(spark, d):
    return metrics.two_cycles(succession(spark, d))


@query(_with(_e(undirected=True), end=f"SELECT count(*) * 4 AS n FROM e JOIN e AS f ON e.src = f.dst AND e.dst = f.src WHERE {_draw(0, 'e.src')} % 4 = 0"))
def two_cycles_estimate(spark, d):
    return metrics.two_cycles_estimate(succession(spark, d, True), 4)


@query(_with(_e(), end="SELECT false AS wide, count(*) AS sets, (sum(n) * 8)::BIGINT AS bytes FROM (SELECT src, count(*) AS n FROM e GROUP BY src)"))
def set_footprint(spark, d):
    return metrics.wide_sets(succession(spark, d))


@query(_with(_e(), end="SELECT dst AS src, src AS dst FROM e"))
def reverse_edges(spark, d):
    return succession(spark, d).reverse().edges.select("src", "dst")


@query(_with(_e(undirected=True), end="SELECT src, dst FROM e"))
def undirected_edges(spark, d):
    return succession(spark, d).undirected().edges


@query(_with(_e(), _V, end="SELECT id, coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst), '') AS neighbours FROM v LEFT JOIN e ON id = src GROUP BY id"))
def adjacency(spark, d):
    return succession(spark, d).adjacency().select("id", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query(_with(_e(), end="SELECT src, dst FROM e WHERE (src + dst) % 5 <> 0"))
def remove_edges(spark, d):
    g = succession(spark, d)
    return g.without_edges(g.edges.where((F.col("src") + F.col("dst")) % 5 == 0)).edges.select("src", "dst")


@query(_with(_e(), end="SELECT src, dst FROM e UNION SELECT range, range + 1 FROM range(50)"))
def add_edges(spark, d):
    return succession(spark, d).with_edges(spark.range(50).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))).edges


@query(_with(_e(), end="SELECT src, dst FROM e WHERE src % 7 <> 0 UNION SELECT DISTINCT src, 1 FROM e WHERE src % 7 = 0"))
def set_neighbours(spark, d):
    g = succession(spark, d)
    own = g.edges.where("src % 7 = 0").select(F.col("src").alias("id")).distinct()
    return g.with_neighbours(own.select(F.col("id").alias("src"), F.lit(1).cast("long").alias("dst")), own).edges


@query(_with(_e(), end="SELECT src, dst FROM e WHERE src % 3 <> 0 AND dst % 3 <> 0"))
def induced_subgraph(spark, d):
    return succession(spark, d).induced(F.col("id") % 3 != 0).edges.select("src", "dst")


@query(_with(_e(), _V, end="SELECT id FROM v WHERE id % 10 = 3"))
def vertex_search(spark, d):
    return attributes.search(succession(spark, d), F.col("id") % 10 == 3)


for _name, _side in (("vertices", "id FROM v"), ("out_edges", "src FROM e"), ("in_edges", "dst FROM e")):
    QUERIES[f"{_name}_per_part"] = lambda spark, d, _name=_name: metrics.per_part(succession(spark, d), PARTS).select("part", _name)
    ORACLES[f"{_name}_per_part"] = _with(_e(), _V, end=f"SELECT x % {PARTS} AS part, count(*) AS {_name} FROM (SELECT {_side.replace(' FROM', ' AS x FROM')}) GROUP BY part")


@query(_with(_e(), end="SELECT dst AS id FROM e WHERE src = (SELECT min(src) FROM e)"))
def neighbors_out(spark, d):
    g = succession(spark, d)
    return g.neighbours(g.edges.agg(F.min("src")).first()[0])


@query(_with(_e(), end="SELECT src AS id FROM e WHERE dst = (SELECT min(src) FROM e)"))
def neighbors_in(spark, d):
    g = succession(spark, d)
    return g.reverse().neighbours(g.edges.agg(F.min("src")).first()[0])


@query(_with(_e(), end="SELECT DISTINCT src // 10 AS src, dst // 10 AS dst FROM e WHERE src // 10 <> dst // 10"))
def contract_edges(spark, d):
    g = succession(spark, d)
    return g.contract(g.vertices.select("id", F.floor(F.col("id") / 10).alias("label"))).edges


@query(_with(_e(), _V, end="SELECT id, (id // 10) // 10 AS label FROM v"))
def compose_labels(spark, d):
    left = succession(spark, d).vertices.select("id", F.floor(F.col("id") / 10).alias("label"))
    right = left.select(F.col("label").alias("id")).distinct().select("id", F.floor(F.col("id") / 10).alias("label"))
    return components.compose(left, right)


_ATTR = "a AS (SELECT v.id, coalesce(p_size, 0)::BIGINT AS attr FROM v LEFT JOIN part ON p_partkey = v.id)"


@query(_with(_e(), _V, _ATTR, end="SELECT id, attr * 2 + id AS value FROM a"))
def map_vertices(spark, d):
    return attributes.map_vertices(priced(spark, d), F.col("attr") * 2 + F.col("id"))


@query(_with(_e(), _V, _ATTR, end="SELECT e.src, e.dst, s.attr AS src_attr, t.attr AS dst_attr FROM e JOIN a AS s ON s.id = e.src JOIN a AS t ON t.id = e.dst"))
def edge_triplets(spark, d):
    return attributes.triplets(priced(spark, d), "attr")


@query(_with(_e(), _V, _ATTR, end="SELECT e.src, e.dst FROM e JOIN a AS s ON s.id = e.src JOIN a AS t ON t.id = e.dst WHERE s.attr > 10 AND t.attr > 10"))
def induced_by_attribute(spark, d):
    return priced(spark, d).induced(F.col("attr") > 10).edges


@query(_with(_e(), end="SELECT src, dst, CASE WHEN src % 2 = 0 THEN src + dst ELSE -1 END AS attr FROM e"))
def edge_attr_lookup(spark, d):
    g = succession(spark, d)
    return attributes.edge_attribute(g, g.edges.where("src % 2 = 0").select("src", "dst", (F.col("src") + F.col("dst")).alias("attr")), F.lit(-1).cast("long"))


@query(_with(_e(), end="SELECT src, dst, CASE WHEN src % 6 = 0 THEN -5 ELSE src + dst END AS attr FROM e WHERE src % 2 = 0"))
def edge_attr_upsert(spark, d):
    even = succession(spark, d).edges.where("src % 2 = 0").select("src", "dst", (F.col("src") + F.col("dst")).alias("attr"))
    return attributes.set_edge_attribute(even, even.where("src % 6 = 0").withColumn("attr", F.lit(-5).cast("long")))


@query(_with(_e(), end="SELECT src, dst, (dst, src) IN (SELECT (src, dst) FROM e) AS is_edge FROM e"))
def edge_exists(spark, d):
    g = succession(spark, d)
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return attributes.has_edge(g, back).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "is_edge")


@query(_with(_e(), _V, _ATTR, end="(SELECT 'greatest' AS which, id, attr FROM a ORDER BY attr DESC, id LIMIT 1) UNION ALL (SELECT 'least', id, attr FROM a WHERE attr > 3 ORDER BY attr, id LIMIT 1)"))
def extreme_values(spark, d):
    v = priced(spark, d).vertices
    most = attributes.extreme(v, "attr").select(F.lit("greatest").alias("which"), "id", "attr")
    return most.unionByName(attributes.extreme(v, "attr", False, F.col("attr") > 3).select(F.lit("least").alias("which"), "id", "attr"))


@query(_with(_e(), _V, _ATTR, end="SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e) AS triplets"))
def visits(spark, d):
    g = priced(spark, d)
    nothing = lambda row: None
    return spark.createDataFrame([(attributes.for_each_vertex(g, nothing), attributes.for_each_edge(g, nothing), attributes.for_each_triplet(g, "attr", nothing))], "vertices long, edges long, triplets long")


# Sources and sinks: the graph is written in the shared folder and read back.


@query(_with(_e(), end="SELECT src, dst FROM e"))
def edge_list_load(spark, d):
    path = shared_folder(spark)
    text.save_text(succession(spark, d), path)
    return text.edge_list(spark, path).edges


@query(_with("s AS (" + _SUCC.format(lineitem="lineitem") + ")", end="SELECT 2 * (SELECT count(*) FROM s) AS parsed, count(*) AS added, 2 * (SELECT count(*) FROM s) - count(*) AS ignored FROM (SELECT src, dst FROM s UNION SELECT dst, src FROM s)"))
def edge_list_counts(spark, d):
    path = shared_folder(spark)
    text.save_text(succession(spark, d), path)
    return text.edge_list_report(spark, path, undirected=True)


@query(_with(_e(), _V, end="SELECT src, dst FROM e UNION ALL SELECT id, NULL FROM v WHERE id NOT IN (SELECT src FROM e)"))
def adj_parse(spark, d):
    path = shared_folder(spark)
    text.save_adjacency(succession(spark, d), path)
    g = text.adjacency_list(spark, path)
    sinks = g.vertices.join(g.edges, F.col("id") == F.col("src"), "left_anti")
    return g.edges.select("src", "dst").union(sinks.select("id", F.lit(None).cast("long")))


@query(_with(_e(), end="SELECT max(greatest(src, dst)) AS max, count(*) AS lines, 2 * count(*) AS numbers, false AS wide FROM e"))
def dataset_profile(spark, d):
    path = shared_folder(spark)
    text.save_text(succession(spark, d), path)
    return text.profile(spark, path)


@query(_with(_e(), _V, end="SELECT sum((src // 100 % 3 = dst // 100 % 3)::INT)::BIGINT AS local, count(*) AS total, round(sum((src // 100 % 3 = dst // 100 % 3)::INT) / count(*), 6) AS ratio FROM e"))
def partition_map_locality(spark, d):
    path, g = shared_folder(spark), succession(spark, d)
    g.vertices.select(F.concat_ws(" ", "id", (F.floor(F.col("id") / 100) % 3).cast("string"))).write.text(path)
    return metrics.locality_of(g, text.partition_file(spark, path))


@query(_with(_e(), end="SELECT src, dst FROM e"))
def snapshot_load(spark, d):
    path = shared_folder(spark)
    text.save(succession(spark, d), path)
    return text.load(spark, path).edges.select("src", "dst")


@query("SELECT l_suppkey AS id, count(DISTINCT l_partkey) AS degree FROM lineitem GROUP BY l_suppkey")
def streamed_degrees(spark, d):
    """Out-degrees of supplier -> part edges that are ingested as a stream of line items; offsets keep both kinds of ids apart."""
    path = shared_folder(spark)
    schema = spark.read.parquet(f"{d}/lineitem.parquet").schema
    lines = spark.readStream.schema(schema).parquet(f"{d}/lineitem.parque[t]")  # a pattern may stand for one file or for a folder of them
    edges.ingest(lines.select(F.col("l_suppkey").alias("src"), (F.lit(1 << 40) + F.col("l_partkey")).alias("dst")), path)
    return metrics.out_degrees(edges.ingested(spark, path)).where(F.col("id") < 1 << 40)


def _least(g: Graph) -> int:
    return g.vertices.agg(F.min("id")).first()[0]


def _from_least(g: Graph, **how) -> DataFrame:
    return traverse.bfs(g, _least(g), **how)


def _deep(spark: SparkSession, d: str) -> Graph:
    return kinship(spark, d, WIDE, True)


@query(_with(_e(undirected=True), _V, _bfs(), end="SELECT id, dist FROM b"))
def bfs_distance(spark, d):
    return _from_least(succession(spark, d, True, hold=True)).select("id", "dist")


@query(_with(_e(WIDE, True), _V, _bfs(), end="SELECT id, dist FROM b"))
def bfs_distance_deep(spark, d):
    return _from_least(_deep(spark, d)).select("id", "dist")


@query(_with(_e(undirected=True), _V, _bfs(), end=f"SELECT b.id, b.dist, min(p.id) AS pred {_PRED}"))
def bfs_predecessor(spark, d):
    return _from_least(succession(spark, d, True, hold=True))


@query(_with(_e(undirected=True), _V, _bfs(" AND e.dst % 4 <> 3"), end="SELECT id, dist FROM b"))
def bfs_filtered(spark, d):
    return _from_least(succession(spark, d, True, hold=True), neighbour_if=F.col("id") % 4 != 3).select("id", "dist")


@query(_with(_e(WIDE, True), _V, _bfs(" AND (b.id % 4 <> 3 OR b.dist = 0)"), end="SELECT id, dist FROM b"))
def bfs_expanding(spark, d):
    """Three of four vertices pass the search on; all may be reached."""
    g = _deep(spark, d)
    least = _least(g)
    return traverse.bfs(g, least, expand_if=(F.col("id") % 4 != 3) | (F.col("id") == least)).select("id", "dist")


@query(_with(_e(WIDE, True), _V, _bfs(), end="SELECT count(*) AS rounds FROM b"))
def bfs_rounds(spark, d):
    return spark.createDataFrame([(traverse.rounds(bfs_distance_deep(spark, d)),)], "rounds long")


@query(_with(_e(WIDE, True), _V, _bfs(), end="SELECT dist AS value, count(*) AS n FROM b GROUP BY dist"))
def distance_distribution(spark, d):
    return metrics.distribution(bfs_distance_deep(spark, d), "dist")


@query(_with(_e(WIDE, True), _V, _bfs(), end="SELECT id, dist FROM b ORDER BY dist DESC, id LIMIT 1"))
def farthest_vertex(spark, d):
    return traverse.farthest(bfs_distance_deep(spark, d))


@query(_with(_e(), _V, _bfs(), end=f"SELECT b.id, b.dist, coalesce(min(p.id), -1) AS pred {_PRED}"))
def sssp_pred(spark, d):
    g = succession(spark, d, hold=True)
    return traverse.shortest_distances(g, _least(g))


@query(_with(_e(WIDE, True), _V, _bfs(), _PATH, end="SELECT dist AS place, id FROM path"))
def shortest_path(spark, d):
    reached = settle(_from_least(_deep(spark, d)))
    path = traverse.shortest_path(reached, traverse.farthest(reached).first().id)
    return spark.createDataFrame([(i, v) for i, v in enumerate(path)], "place long, id long")


@query(_with(_e(WIDE, True), _V, _bfs(), end="SELECT row_number() OVER (ORDER BY dist, id) - 1 AS place, id, dist FROM b"))
def visit_order(spark, d):
    return traverse.visit_order(bfs_distance_deep(spark, d))


_WALK = f"""o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k FROM e), w AS (SELECT 1 AS step, id AS walker, id FROM v
UNION ALL SELECT w.step + 1, w.walker, o.dst FROM w JOIN d ON d.id = w.id JOIN o ON o.src = w.id AND o.k = {_draw(7, "w.walker", "w.step")} % d.degree WHERE w.step < 5 AND d.degree > 0)"""


@query(_with(_e(undirected=True), _V, _D, _WALK, end="SELECT id, count(*)::BIGINT AS visits FROM w GROUP BY id"))
def random_walk(spark, d):
    g = succession(spark, d, True, hold=True)
    return traverse.random_walk(g, g.vertices.select("id", F.col("id").alias("walker")), 5, seed=7)


@query(_with(_e(), _V, end=f"SELECT id FROM v ORDER BY {_draw(3, 'id')}, id LIMIT 20"))
def random_vertices(spark, d):
    return traverse.pick_vertices(succession(spark, d), 20, seed=3)


@query(_with(_e(undirected=True), _V, _LOW, end="SELECT id, label FROM l"))
def cc_labels(spark, d):
    return components.connected(succession(spark, d, hold=True))


def _kin_labels(spark: SparkSession, d: str) -> DataFrame:
    return components.connected(kinship(spark, d, WIDE))


@query(_with(_e(WIDE, True), _V, _LOW, end="SELECT label, count(*) AS size FROM l GROUP BY label"))
def cc_sizes(spark, d):
    return components.sizes(_kin_labels(spark, d))


@query(_with(_e(WIDE, True), _V, _LOW, end="SELECT count(DISTINCT label) AS n FROM l"))
def cc_count(spark, d):
    return _kin_labels(spark, d).agg(F.countDistinct("label").alias("n"))


@query(_with(_e(WIDE, True), _V, _LOW, end="SELECT label, count(*) AS size FROM l GROUP BY label ORDER BY size DESC, label LIMIT 1"))
def cc_largest(spark, d):
    return components.largest(_kin_labels(spark, d))


@query(_with(_e(WIDE, True), _V, _LOW, end="SELECT DISTINCT label FROM l"))
def cc_representatives(spark, d):
    return _kin_labels(spark, d).select("label").distinct()


@query(_with(_e(WIDE), _V, _LOW, end="SELECT id, label FROM l"))
def min_ancestor_labels(spark, d):
    return components.least_ancestors(kinship(spark, d, WIDE))


_SCC = "c AS (SELECT r.a AS id, min(r.b) AS label FROM r JOIN r AS s ON s.a = r.b AND s.b = r.a GROUP BY r.a)"


@query(_with(_e(), _V, _REACH, _SCC, end="SELECT id, label FROM c"))
def scc_labels(spark, d):
    return components.strongly_connected(succession(spark, d, hold=True))


@query(_with(_e(NARROW), _V, _REACH, _SCC, end="SELECT label, count(*) AS size FROM c GROUP BY label"))
def scc_sizes(spark, d):
    return components.sizes(components.strongly_connected(kinship(spark, d, NARROW)))


@query(_with(_e(NARROW), _V, _REACH, _SCC, end="SELECT DISTINCT p.label AS src, q.label AS dst FROM e JOIN c AS p ON p.id = e.src JOIN c AS q ON q.id = e.dst WHERE p.label <> q.label"))
def scc_contract(spark, d):
    g = kinship(spark, d, NARROW)
    return g.contract(settle(components.strongly_connected(g))).edges


# what stays is reached from a cycle and reaches one; loops don't count
@query(_with(_e(NARROW), _V, _REACH, "y AS (SELECT DISTINCT r.a AS id FROM r JOIN r AS s ON s.a = r.b AND s.b = r.a WHERE r.a <> r.b)", end="SELECT id FROM v WHERE id NOT IN (SELECT b FROM r WHERE a IN (SELECT id FROM y)) OR id NOT IN (SELECT a FROM r WHERE b IN (SELECT id FROM y))"))
def scc_trim(spark, d):
    g = kinship(spark, d, NARROW)
    return components.trim(g.vertices, g.edges.where("src <> dst"))[0]


@query(
    _with(
        _e(), _V, _D, "n AS (SELECT count(*) AS n FROM v)",
        "p AS (SELECT 0 AS step, id, degree, 1.0::DOUBLE / n AS rank FROM d, n UNION ALL SELECT p.step + 1, p.id, p.degree, 0.15 / n.n + 0.85 * (coalesce((SELECT sum(q.rank / q.degree) FROM p AS q JOIN e ON e.src = q.id WHERE e.dst = p.id), 0) + coalesce((SELECT sum(q.rank) FROM p AS q WHERE q.degree = 0), 0) / n.n) FROM p, n WHERE p.step < 30)",
        end="SELECT id, round(rank, 9) AS rank FROM p WHERE step = 30",
    )
)
def pagerank(spark, d):
    return rank.page_rank(succession(spark, d, hold=True)).select("id", F.round("rank", 9).alias("rank"))


@query(
    _with(
        _e(), _V, _D,
        "p AS (SELECT 0 AS step, id, degree, 0.0::DOUBLE AS rank FROM d UNION ALL SELECT p.step + 1, p.id, p.degree, CASE WHEN p.degree = 0 THEN 0 ELSE 0.15 + 0.85 * (coalesce((SELECT sum(q.rank / q.degree) FROM p AS q JOIN e ON e.src = q.id WHERE e.dst = p.id), 0) + p.rank / p.degree) END FROM p WHERE p.step < 30)",
        end="SELECT id, round(rank / (1 + abs(rank)), 9) AS rank FROM p WHERE step = 30",
    )
)
def pagerank_own_share(spark, d):
    """Ranks of the own recurrence grow without bounds; the digest is of r / (1 + r)."""
    r = F.col("rank")
    return rank.page_rank(succession(spark, d, hold=True), steps=30, own_share=True).select("id", F.round(r / (1 + F.abs(r)), 9).alias("rank"))


@query(
    _with(
        _e(undirected=True), _V, _D,
        "t AS (SELECT a.src AS id, count(*) AS t FROM e AS a JOIN e AS b ON b.src = a.dst JOIN e AS c ON c.src = a.src AND c.dst = b.dst WHERE b.dst <> a.src AND b.dst <> a.dst GROUP BY a.src)",
        end="SELECT d.id, round(CASE WHEN degree > 1 THEN coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS coefficient FROM d LEFT JOIN t ON t.id = d.id",
    )
)
def lcc(spark, d):
    return rank.clustering(succession(spark, d, True)).select("id", F.round("coefficient", 6).alias("coefficient"))


_PAIRS = (_e(NARROW, True), _V, _ALL)


def _small(spark: SparkSession, d: str) -> Graph:
    return kinship(spark, d, NARROW, True)


@query(_with(*_PAIRS, end="SELECT id, ecc FROM x"))
def eccentricity(spark, d):
    return extent.eccentricity(_small(spark, d))


@query(_with(*_PAIRS, end="SELECT id, ecc FROM x"))
def eccentricity_by_bounds(spark, d):
    return extent.bounded_eccentricity(_small(spark, d), 4096)


@query(_with(*_PAIRS, end="SELECT ecc AS value, count(*) AS n FROM x GROUP BY ecc"))
def ecc_distribution(spark, d):
    return metrics.distribution(eccentricity_by_bounds(spark, d), "ecc")


@query()
def ecc_hybrid_distribution(spark, d):
    """Where its bounds stop depends on the order of searches, and so does what is drawn."""
    return extent.hybrid_distribution(_small(spark, d), 0.25, batch=4096)


@query(_with(*_PAIRS, end="SELECT ecc AS value, count(*) AS n FROM x GROUP BY ecc"))
def ecc_hybrid_whole_share(spark, d):
    """With a share of 1 the distribution is exact."""
    return extent.hybrid_distribution(_small(spark, d), 1.0, batch=4096)


_HUB = "(SELECT id FROM d ORDER BY degree DESC, id LIMIT 1)"


def _hub(g: Graph) -> int:
    return metrics.max_degree(g).first().id


def _centre(g: Graph) -> int:
    return extent.two_sweeps(g, _hub(g))


@query(_with(_e(NARROW, True), _V, _D, _bfs(start=_HUB), _PATH, end="SELECT id FROM path WHERE dist = (SELECT (max(dist) + 1) // 2 FROM path)"))
def two_sweep_center(spark, d):
    return spark.createDataFrame([(_centre(_small(spark, d)),)], "id long")


@query(_with(*_PAIRS, _D, end=f"SELECT max(ecc) AS diameter FROM x WHERE id IN (SELECT id FROM w WHERE s = {_HUB})"))
def diameter(spark, d):
    g = _small(spark, d)
    return spark.createDataFrame([extent.diameter(g, _centre(g))[:1]], "diameter long")


# a layer is one batch here: all its vertices are searched from, and it goes on inwards while twice the layer could be more than what was found
@query(
    _with(
        *_PAIRS, _D, _bfs(start=_HUB), _PATH, "m AS (SELECT id FROM path WHERE dist = (SELECT (max(dist) + 1) // 2 FROM path))",
        "y AS (SELECT w.dist AS layer, count(*) AS n, max(x.ecc) AS far FROM w JOIN x ON x.id = w.id WHERE w.s = (SELECT id FROM m) GROUP BY w.dist)",
        "z AS (SELECT layer, n, greatest((SELECT max(layer) FROM y), coalesce(max(far) OVER (ORDER BY layer DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM y WHERE layer > 0)",
        end="SELECT coalesce(sum(n), 0)::BIGINT AS searches FROM z WHERE low < 2 * layer",
    )
)
def diameter_searches(spark, d):
    g = _small(spark, d)
    return spark.createDataFrame([extent.diameter(g, _centre(g))[1:]], "searches long")


@query(
    _with(
        *_PAIRS, _D,
        "f AS (SELECT s, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY dist DESC, id) AS k FROM w) WHERE k = 1)",
        f"h AS (SELECT 0::BIGINT AS hop, id, dist FROM f WHERE s = {_HUB} AND dist > 0 UNION ALL SELECT h.hop + 1, f.id, f.dist FROM h JOIN f ON f.s = h.id WHERE f.dist > h.dist)",
        end="SELECT hop, id, dist FROM h",
    )
)
def nbfs_increments(spark, d):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(extent.farthest_hops(_small(spark, d)))], "hop long, id long, dist long")


@query("SELECT i + 6 * j AS src, i + 6 * j + 1 AS dst FROM (SELECT a.range AS i, b.range AS j FROM range(6) a, range(4) b) WHERE i < 5 UNION ALL SELECT i + 6 * j, i + 6 * j + 6 FROM (SELECT a.range AS i, b.range AS j FROM range(6) a, range(4) b) WHERE j < 3 UNION ALL SELECT i + 6 * j + 1, i + 6 * j FROM (SELECT a.range AS i, b.range AS j FROM range(6) a, range(4) b) WHERE i < 5 UNION ALL SELECT i + 6 * j + 6, i + 6 * j FROM (SELECT a.range AS i, b.range AS j FROM range(6) a, range(4) b) WHERE j < 3 UNION ALL SELECT i + 6 * j, i + 6 * j + 7 FROM (SELECT a.range AS i, b.range AS j FROM range(6) a, range(4) b) WHERE i < 5 AND j < 3")
def grid(spark, d):
    return generate.grid(spark, 6, 4, diagonals=True).edges


@query("SELECT range AS src, (range + 1) % 400 AS dst FROM range(400)")
def chain(spark, d):
    return generate.chain(spark, 400, cycle=True).edges


@query("SELECT range AS id FROM range(100)")
def empty_graph(spark, d):
    return generate.empty(spark, 100).vertices


@query(f"SELECT DISTINCT src, {_draw(1, 'src', 'k')} % 1000 AS dst FROM (SELECT range AS src, unnest(range(1, 3 + ({_draw(1, 'range')} % 9))) AS k FROM range(1000))")
def random_graph(spark, d):
    return generate.random(spark, 1000, 2, 10, seed=1).edges


@query(_with(_e(), _V, _LOW, end="SELECT id, label AS value FROM l"))
def pregel_min(spark, d):
    return attributes.pregel(succession(spark, d, hold=True), F.col("id"), F.col("value"), F.min, F.least("value", "message"))


@query(_with(_e(), _V, _ATTR, end="SELECT id, CASE WHEN id % 3 = 0 THEN -id ELSE attr END AS attr FROM a"))
def vertex_attr_set(spark, d):
    g = priced(spark, d)
    new = g.vertices.where("id % 3 = 0").select("id", (-F.col("id")).alias("attr"))
    return attributes.set_vertex_attribute(g, new, "attr").vertices.select("id", "attr")


@query(_with(_e(), _V, end="SELECT min(src) AS id FROM e"))
def one_vertex(spark, d):
    path = shared_folder(spark)
    text.save_text(succession(spark, d), path)
    return spark.createDataFrame([(text.one_vertex(spark, path),)], "id long")


@query(_with(_e(), end="SELECT src, dst FROM e"))
def edge_list_stream(spark, d):
    """The edges as one stream of numbers, three to a line, so that every other line ends within a pair."""
    path, g = shared_folder(spark), succession(spark, d)
    order = numbered(g.edges.select("src", "dst"), "src", "dst")
    numbers = order.select(F.explode(F.array(F.struct((F.col("n") * 2).alias("k"), F.col("src").alias("x")), F.struct((F.col("n") * 2 + 1).alias("k"), F.col("dst").alias("x")))).alias("e"))
    lines = numbers.groupBy(F.floor(F.col("e.k") / 3).alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["x"].cast("string")), " ").alias("value"))
    lines.coalesce(1).sortWithinPartitions("line").select("value").write.text(path)  # such a file is sequential by nature
    return text.edge_list(spark, path).edges


@query(_with(_e(undirected=True), end="SELECT src, dst FROM e"))
def snapshot_or_build(spark, d):
    source, path = shared_folder(spark), shared_folder(spark)
    text.save_text(succession(spark, d), source)
    made = text.Snapshot(text.EdgeList(source, undirected=True), path)
    made.graph(spark)
    return made.graph(spark).edges.select("src", "dst")
