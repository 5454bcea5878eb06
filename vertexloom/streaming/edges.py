"""Edges that keep arriving: a stream is ingested into a Parquet graph, each edge once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


def ingest(stream: DataFrame, path: str, delay: str | None = None) -> None:
    """Append what a stream of src and dst holds now to the edges in path, and remember in path how far it was read.

    Repeats are dropped by keyed state, which is kept in path too; with a delay, over a column ts, state older than that is forgotten, so repeats further apart come twice.
    The file sink writes each batch once, whatever is lost and repeated.
    """
    e = stream.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    if delay:
        e = e.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["src", "dst"])
    else:
        e = e.dropDuplicates(["src", "dst"])
    sink = e.select("src", "dst").writeStream.format("parquet").option("path", f"{path}/edges").option("checkpointLocation", f"{path}/progress")
    sink.trigger(availableNow=True).start().awaitTermination()


def ingested(spark: SparkSession, path: str) -> Graph:
    """The graph of all edges ingested so far."""
    return Graph.from_edges(spark.read.schema("src long, dst long").parquet(f"{path}/edges"))
