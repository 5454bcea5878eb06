"""Edge lists, adjacency lists, partition files, profiles and snapshots."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, row and the numbers x of each line, which in this order are a file's stream of numbers; lines that start with # and empty ones are left out."""
    line = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    line = line.withColumn("t", F.trim(F.regexp_replace("value", r"\s+", " ")))
    numbers = F.when(F.expr("t <> '' AND NOT startswith(t, '#')"), F.transform(F.split("t", " "), lambda n: n.cast("long")))  # a cast must not meet a comment, whatever the order of filters
    return line.select("file", "block", "row", numbers.alias("x")).where("x IS NOT NULL")


def _streamed(lines: DataFrame) -> DataFrame:
    """file and x, the lines of each file in order in one task, which reads them one after the other."""
    return lines.repartition("file").sortWithinPartitions("file", "block", "row").select("file", "x")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src and dst of a stream of numbers; a pair may go on in the next line, but not in the next file."""
    file, rest = None, []
    for batch in batches:
        out = []
        for name, x in zip(batch.column("file").to_pylist(), batch.column("x").to_pylist(), strict=True):
            if name != file:
                file, rest = name, []
            rest += x
            even = len(rest) // 2 * 2
            out += rest[:even]
            rest = rest[even:]
        yield pa.RecordBatch.from_arrays([pa.array(out[::2], pa.int64()), pa.array(out[1::2], pa.int64())], names=["src", "dst"])


def edge_list(spark: SparkSession, path: str, undirected: bool = False, multigraph: bool = False) -> Graph:
    """The numbers of a file, whatever its lines, are pairs of src and dst; a last number without a partner is left out.

    Files with whole pairs in each line are read line by line. Where a pair goes on in the next line the format is sequential: each file is then streamed through one task, in
    the order of its lines.
    """
    lines = _lines(spark, path)
    if lines.where("size(x) % 2 = 1").limit(1).count():
        pairs = _streamed(lines).mapInArrow(_pairs, "src long, dst long")
    else:
        pair = lambda i: F.struct(F.get("x", i * 2).alias("src"), F.get("x", i * 2 + 1).alias("dst"))
        pairs = lines.select(F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1), pair)).alias("e")).select("e.*")
    return Graph.from_edges(pairs, undirected=undirected, multigraph=multigraph)


def edge_list_report(spark: SparkSession, path: str, undirected: bool = False) -> DataFrame:
    """parsed (pairs in the file), added (edges of the simple graph) and ignored (repeats)."""
    every, g = edge_list(spark, path, undirected, multigraph=True), edge_list(spark, path, undirected)
    counts = every.edges.agg(F.count("*").alias("parsed")).crossJoin(g.edges.agg(F.count("*").alias("added")))  # one row each
    return counts.withColumn("ignored", F.col("parsed") - F.col("added"))


#: Whether the numbers of a line are whole records: what is still to come is a source (0), its count (-1) or so many neighbours.
_WHOLE = "aggregate(x, 0L, (need, n) -> CASE need WHEN 0 THEN -1L WHEN -1 THEN n ELSE need - 1 END) = 0"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, place and neighbours of the records of a stream of numbers; a record may go on in the next line, but not in the next file."""
    file, place, rest = None, 0, []

    def done():
        nonlocal rest, place
        at, out = 0, {"src": [], "place": [], "neighbours": []}
        while at + 1 < len(rest) and at + 2 + rest[at + 1] <= len(rest):
            out["src"].append(rest[at])
            out["place"].append(place)
            out["neighbours"].append(rest[at + 2 : at + 2 + rest[at + 1]])
            at, place = at + 2 + rest[at + 1], place + 1
        rest = rest[at:] if at else rest
        return pa.RecordBatch.from_arrays([pa.array(out["src"], pa.int64()), pa.array(out["place"], pa.int64()), pa.array(out["neighbours"], pa.list_(pa.int64()))], names=list(out))

    for batch in batches:
        for name, x in zip(batch.column("file").to_pylist(), batch.column("x").to_pylist(), strict=True):
            if name != file:
                file, rest = name, []
            rest += x
            if len(rest) >= 1 << 16:
                yield done()
        yield done()


def adjacency_list(spark: SparkSession, path: str, undirected: bool = False) -> Graph:
    """Records `src k n1 .. nk`; a vertex with k = 0 exists without edges, repeated neighbours stay, and of several records of a source the last counts.

    Files with a record in each line are read line by line. Where a record goes on in the next line the format is sequential: each such file is streamed through one
    task in the order of its lines, which holds one record at a time.
    """
    line = _lines(spark, path)
    if line.where(f"NOT ({_WHOLE}) OR size(x) <> x[1] + 2").limit(1).count():
        stream = _streamed(line)
        rows = stream.mapInArrow(_records, "src long, place long, neighbours array<long>").select("src", F.struct("place").alias("at"), "neighbours")
    else:
        rows = line.select(F.get("x", F.lit(0)).alias("src"), F.struct("file", "block", "row").alias("at"), F.expr("slice(x, 3, cast(x[1] as int))").alias("neighbours"))
    last = rows.groupBy("src").agg(F.max_by("neighbours", "at").alias("neighbours"))
    return Graph.from_edges(last.select("src", F.explode("neighbours").alias("dst")), last.select(F.col("src").alias("id")), undirected, multigraph=True)


def one_vertex(spark: SparkSession, path: str) -> int:
    """The least source of an edge list."""
    return edge_list(spark, path).edges.agg(F.min("src")).first()[0]


def profile(spark: SparkSession, path: str) -> DataFrame:
    """max (0 at least), lines, numbers and whether ids need 64 bits, of a tab-separated file."""
    line = spark.read.text(path).select(F.size(F.expr("filter(split(value, '\\t'), x -> trim(x) <> '')")).alias("n"), F.expr("array_max(transform(filter(split(value, '\\t'), x -> trim(x) <> ''), x -> cast(trim(x) as bigint)))").alias("m"))
    return line.agg(F.greatest(F.coalesce(F.max("m"), F.lit(0)), F.lit(0)).alias("max"), F.count("*").alias("lines"), F.coalesce(F.sum("n"), F.lit(0)).alias("numbers")).withColumn("wide", F.col("max") > 2147483647)


def partition_file(spark: SparkSession, path: str) -> DataFrame:
    """id and part of each line."""
    return _lines(spark, path).select(F.get("x", F.lit(0)).alias("id"), F.get("x", F.lit(1)).cast("tinyint").alias("part"))


def save_text(g: Graph, path: str) -> None:
    """Lines of `src dst`."""
    g.edges.select(F.concat_ws("\t", "src", "dst")).write.mode("overwrite").text(path)


def save_adjacency(g: Graph, path: str) -> None:
    """Lines of `src k n1 .. nk`, vertices without neighbours included."""
    g.adjacency().select(F.array_join(F.concat(F.array("id", F.size("neighbours").cast("long")), "neighbours"), " ")).write.mode("overwrite").text(path)


def save(g: Graph, path: str, undirected: bool = False) -> None:
    """A Parquet snapshot, which says of what kind its graph is."""
    g.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")
    g.vertices.sparkSession.createDataFrame([(undirected, g.multigraph)], _KIND).coalesce(1).write.mode("overwrite").parquet(f"{path}/kind")


_KIND = "undirected boolean, multigraph boolean"


def load(spark: SparkSession, path: str, undirected: bool | None = None, multigraph: bool | None = None) -> Graph:
    """The graph of a snapshot; a ValueError if it isn't of the kind asked for (None: any)."""
    kind = spark.read.schema(_KIND).parquet(f"{path}/kind").first()
    for name, want in (("undirected", undirected), ("multigraph", multigraph)):
        if want is not None and kind[name] != want:
            raise ValueError(f"the snapshot at {path} has {name}={kind[name]}, not {want}")
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), kind.multigraph)


def save_result(df: DataFrame, path: str) -> None:
    """Any operator's result."""
    df.write.mode("overwrite").parquet(path)


def load_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _changed(spark: SparkSession, path: str) -> int:
    """When the newest file at a path was written, by the file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return max([fs.getFileStatus(p).getModificationTime(), *(x.getModificationTime() for x in fs.listStatus(p))]) if fs.exists(p) else -1


def load_or_build(spark: SparkSession, source: str, snapshot: str, force: bool = False, undirected: bool = False, multigraph: bool = False) -> Graph:
    """The snapshot if it is newer than the source edge list, else the source, which becomes the snapshot. A newer one of another kind is a ValueError."""
    if force or _changed(spark, f"{snapshot}/kind") <= _changed(spark, source):
        save(edge_list(spark, source, undirected, multigraph), snapshot, undirected)
    return load(spark, snapshot, undirected, multigraph)


class Source(Protocol):
    """Where a graph comes from."""

    def graph(self, spark: SparkSession) -> Graph: ...


@dataclass(frozen=True)
class EdgeList:
    path: str
    undirected: bool = False
    multigraph: bool = False

    def graph(self, spark: SparkSession) -> Graph:
        return edge_list(spark, self.path, self.undirected, self.multigraph)


@dataclass(frozen=True)
class AdjacencyList:
    path: str
    undirected: bool = False

    def graph(self, spark: SparkSession) -> Graph:
        return adjacency_list(spark, self.path, self.undirected)


@dataclass(frozen=True)
class Snapshot:
    """A snapshot of an edge list, made anew when that is newer or force says so."""

    source: EdgeList
    path: str
    force: bool = False

    def graph(self, spark: SparkSession) -> Graph:
        return load_or_build(spark, self.source.path, self.path, self.force, self.source.undirected, self.source.multigraph)
