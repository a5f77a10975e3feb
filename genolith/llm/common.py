"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: The white space of every contract here: space and \t \n \v \f \r.
WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one where none is set and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if path is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: this cluster names no folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='genolith-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def until_exit(spark: SparkSession, path: str) -> str:
    """``path``, which goes when the driver's JVM ends."""
    where, system = _file_system(spark, path)
    system.deleteOnExit(where)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Delete what lies at ``path``, in whatever store it is."""
    where, system = _file_system(spark, path)
    system.delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts lineage, survives lost executors. Batches for Python
    are small meanwhile. The table goes when the driver ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(until_exit(spark, path))


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            removed(df.sparkSession, path)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z alone. ``lower`` is the fast path and equals it on pure ASCII text."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def second_hash(*cols: Column) -> Column:
    """A 64-bit hash independent of ``xxhash64(*cols)``: the leading literal changes the seed."""
    return F.xxhash64(F.lit("second"), *cols)


def byte_count(kind: DataType, c: Column) -> Column:
    """About how many bytes the value ``c`` of type ``kind`` takes in memory."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
            return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda n, x: n + byte_count(kind.elementType, x)), F.lit(16))
        return F.coalesce(F.size(c), F.lit(0)).cast("long") * 8 + 16
    if isinstance(kind, StructType):
        return reduce(lambda x, y: x + y, [byte_count(f.dataType, c[f.name]) for f in kind], F.lit(16).cast("long"))
    return F.lit(8).cast("long")


#: The most bytes that are broadcast.
BROADCAST_BYTES = 16_000_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` to be broadcast if its rows take at most ``most`` bytes, which is summed up first; else as it is, to be joined by
    shuffle. ``df`` is computed twice: it should be a written table or come from small ones."""
    row = reduce(lambda x, y: x + y, [byte_count(f.dataType, F.col(f"`{f.name}`")) for f in df.schema], F.lit(16).cast("long"))
    size = df.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; component = smallest reachable node.

    Alternating large-star and small-star steps: each is a pre-aggregated minimum and a join, no step gathers a
    node's neighbours in one row, and the edge list never grows beyond its input. Each round's edges are written, and those
    before them go. Ends when all that is left are stars: every node has one edge to a lesser one, or edges from greater ones alone.
    """

    def stars(links: DataFrame) -> DataFrame:
        """links (u, v): v > m goes to m, where m is the least of u and its v's."""
        least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return links.join(least, "u")

    def ended(e: DataFrame) -> bool:
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("s")).select("s.*")
        return ends.groupBy("x").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).filter("down > 1 or (down > 0 and up > 0)").isEmpty()

    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "edges")
    while not ended(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stars(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = stars(large).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u != v").distinct()
        before, e = e, written(small, "edges")
        discard(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def conjunction(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)


#: Bytes of an Arrow batch of texts, about (one row at least), as texts may be very long.
BATCH = "4m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches hold about BATCH in here; then the session's own setting holds again."""
    before = spark.conf.get(_BATCH_SETTING)
    spark.conf.set(_BATCH_SETTING, BATCH)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold about BATCH from now on: for plans that are run by the caller."""
    df.sparkSession.conf.set(_BATCH_SETTING, BATCH)
    return df


def release() -> None:
    """Gives freed memory back to the system: Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
