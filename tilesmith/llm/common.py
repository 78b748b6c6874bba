"""Shared helpers: tables in the shared scratch folder, checked broadcasts, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast a side only if it has at most this many rows (of a few fixed-size columns).
BROADCAST_ROWS = 2_000_000


#: Rows of an Arrow batch. Spark's default of 10,000 whole texts is tens of MB, several times over in each task.
ARROW_ROWS = 1000


def released(run):
    """An Arrow mapper that gives its memory back to the system at the end of a partition.

    Python workers outlive their tasks; without it each holds on to the most it ever needed.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder. Where the session has Spark's default Arrow batch, it is cut to ARROW_ROWS rows."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local master gets a folder of its own; a cluster is refused, since a
    machine-local folder would not be seen by the other executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/tilesmith"


def fresh(df: DataFrame, name: str) -> str:
    """name, or with underscores before it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. The driver deletes what is there when it ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    The driver deletes it when it ends, if ``dropped`` hasn't before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing will read again."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit, else df for a shuffle join.

    df should be a written table, as it is counted here.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps, each written to the shared folder, until the
    edge set no longer changes. Nodes without an edge have no row. Nothing is collected but
    two numbers a round.
    """

    def hooked(e: DataFrame, both: bool) -> DataFrame:
        if both:  # each node's larger neighbours hang on its smallest neighbour
            n = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = n.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            return n.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a > b in every row: the smaller neighbours of a, and a, hang on the smallest
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        return e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))

    def clean(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = written(clean(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "edges")
    before = state(e)
    while before[0]:
        new = written(clean(hooked(clean(hooked(e, True)), False)), "edges")
        after = state(new)
        dropped(e)
        e = new
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
