"""What the operators of this subpackage share: tables cut from their lineage, and id labels of graphs."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or for a local master a new temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tessera-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """df written once to the shared folder and read back: its lineage ends there and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Arrow batches of fewer rows for the session, unless it has chosen a number: rows of whole texts are large, and the JVM holds
    a batch outside of its heap while it grows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """What this worker no longer needs goes back to the system; the next task that it serves may need little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with give_back() after it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def discard(df: DataFrame) -> None:
    """Deletes the table that materialize() wrote for df, when nothing will read it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("tessera-"):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of ids or id pairs to broadcast at most: 16 MB. Larger sides are shuffled.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it was counted and found small enough; for tables written before, whose count is cheap."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (a, b): component is the smallest node reachable.

    Every round each node takes its least neighbour for parent, pointers double until they reach the roots, and the edges
    shrink to those between roots: components at least halve in number. Nodes and edges stay distributed; the driver sees
    counts. Loops, repeated edges and both directions of one count once; an end that is null joins nothing; nodes without
    edges to others aren't in the result, and no edges give no rows. Other columns aren't read. Tables of rounds gone by are deleted.
    """
    tied = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs, labels = materialize(tied(edges.select("a", "b")), "edges"), None
    while not pairs.isEmpty():
        ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("up")), F.struct(F.col("b").alias("node"), F.col("a").alias("up")))).alias("e")).select("e.*")
        parents = materialize(ends.groupBy("node").agg(F.min("up").alias("up")), "parents")
        while True:
            above = small(parents.where("node <> up").select(F.col("node").alias("up"), F.col("up").alias("top")))
            jumped = materialize(parents.join(above, "up", "left").select("node", "up", F.coalesce("top", "up").alias("top")), "parents")
            discard(parents)
            parents = jumped.select("node", F.col("top").alias("up"))
            if jumped.where("up <> top").isEmpty():
                break
        moved = parents.where("node <> up")
        if labels is None:
            labels = parents.withColumnRenamed("up", "component")
        else:
            step = small(moved.select(F.col("node").alias("component"), "up"))
            old, labels = labels, materialize(labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
            discard(old)
        a, b = (small(moved.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))) for c in "ab")
        met = pairs.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b"))
        old, pairs = pairs, materialize(tied(met), "edges")
        discard(old)
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")) if labels is None else labels
