"""Driver loops: what a superstep leaves is written, so that plans stay short and a lost executor costs one superstep."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a few numbers that may be broadcast: some MB.
ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """A folder of our own in spark.checkpoint.dir, which all executors share; only where that is unset (tests) a local one. What is in it goes when the session ends."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vertexloom-"))
        own = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
        own.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(own)
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint df in the shared folder."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        shared_folder(df.sparkSession)
    return df.checkpoint()


def settle_counting(df: DataFrame, condition: str = "true") -> tuple[DataFrame, int]:
    """df settled, and how many of its rows fulfil a SQL condition, counted while they are written; a stage that runs twice may count twice, 0 stays exact."""
    seen = Observation()
    df = settle(df.observe(seen, F.count_if(F.expr(condition)).alias("n")))
    return df, seen.get["n"]


def beside(df: DataFrame, n: int) -> DataFrame:
    """df of at most n rows for a join with a large table: broadcast up to ROWS of them, beyond that merged with it, whatever the optimiser guesses of a loop's tables."""
    return F.broadcast(df) if n <= ROWS else df.hint("merge")


def kept(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key, sorted by it and held, for loops that join on it again and again."""
    return df.repartition(key).sortWithinPartitions(key).persist()


def numbered(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """df, settled, with the place (from 0) of each row in the order of columns that identify it: rows are range-partitioned, and places in a partition follow the rows before it."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    rows = settle(rows.withColumns({"__part": F.shiftright(name, 33), name: F.col(name).bitwiseAND((1 << 33) - 1)}))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.select("__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row a partition
    return rows.join(F.broadcast(before), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def until_still(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], changed: str, n: int, most: int | None = None, listen: Callable[[int, int], None] | None = None) -> DataFrame:
    """Repeat step on a settled state, of which n rows fulfil the SQL condition changed, until none does, or `most` times; listen gets the superstep and the number of changed rows."""
    turn = 0
    while n and (most is None or turn < most):
        state, n = settle_counting(step(state, n), changed)
        turn += 1
        if listen:
            listen(turn, n)
    return state
