"""Shared pieces of the training-data operators: tables, staging, batching, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; bounds a worker's memory.
BLOCK_BYTES = 1 << 20


_held: dict[str, dict] = {}


def _give_back() -> None:
    """Return freed memory to the machine: a worker lives on after its task, and would keep its largest size."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which has no such call


def claim(owner: str) -> dict:
    """What a worker keeps for ``owner`` between tasks (models, caches); what others kept is let go, so a
    worker that serves several operators in turn holds one operator's memory at a time."""
    others = [x for x in _held if x != owner]
    for name in others:
        del _held[name]
    if others:
        _give_back()
    return _held.setdefault(owner, {})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local one is set only where none is configured and Spark runs on this
    machine alone; on a cluster, whose tasks could not read it, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later reads don't recompute it,
    and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when the query ends; for steps whose results are written and
    whose DataFrames are not run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", owner: str = "", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``size`` bytes of text, and their texts as UTF-8 (null: empty)."""
    claim(owner)
    for batch in batches:
        texts = batch.column(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
        at = 0
        while at < len(ends):
            done = int(ends[at - 1]) if at else 0
            n = max(1, int(np.searchsorted(ends, done + size, side="right")) - at)
            part = batch.slice(at, n)
            yield part, [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]
            at += n


def joined(texts: list[bytes], before: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, each after ``before``, and where each one's part starts."""
    sizes = np.array([len(x) + len(before) for x in texts], dtype=np.int64)
    return np.frombuffer(b"".join(before + x for x in texts) if before else b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b): component is the smallest node reachable.

    Alternates large-star and small-star (Kiveris et al. 2014) until nothing changes, O(log^2 n) rounds;
    each round ends in the shared folder, so lineage stays short and nothing is collected.
    """
    spark = edges.sparkSession
    now = staged(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now = staged(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == last:
            break
        last = state
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
