"""What the text operators share: tables, bounded Arrow batches, written cut points and worker caches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows and bytes of one Arrow batch sent to a Python worker; long texts make the byte limit bind first.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null doc_id counts as held out, so nothing is learnt from it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes (a row that is longer goes alone)."""
    for at in range(0, batch.num_rows, BATCH_ROWS):
        todo = [batch.slice(at, BATCH_ROWS)]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > BATCH_BYTES:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def by_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict]], schema: str) -> DataFrame:
    """Apply fn to Arrow batches of bounded size, cut in the worker; fn gives dicts of columns, each a list or an Arrow array."""
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for out in fn(part):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only where it is unset (tests) one of our own."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="vertexloom-")


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting that holds for the block only."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends here, and a lost executor costs no recomputation.

    The shuffle files behind df are removed as soon as it is written, so that a job of several steps holds those of one step at a time. So are the tables `done` of former
    cuts, which nothing reads any more; what is left goes when the session ends.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/vertexloom-{uuid.uuid4().hex}"
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)
    for old in done:
        discard(old)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the table of a cut() that nothing reads any more."""
    fs, at = _path(df.sparkSession, df._written)
    fs.delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Rows of a few columns (ids, digests) that may be broadcast: some tens of MB at most.
BROADCAST_ROWS = 250_000


def sized(df: DataFrame) -> DataFrame:
    """df of cut(), marked for a broadcast if it has at most BROADCAST_ROWS rows; beyond that Spark joins by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Generations(dict):
    """A worker's cache of at most 2 * cap entries. When cap new ones are in, those become the old generation and the former old one goes; entries in use move up."""

    def __init__(self, make: Callable, cap: int):
        super().__init__()
        self.make, self.cap, self.old = make, cap, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
