"""Helpers shared by the training-data operators: scratch tables, components, hashing."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.scratch import folder
from loomgraph.operators import graphs


class Scratch:
    """Tables written to the shared folder, so that later stages survive lost executors.

    A table is a plain Parquet folder under a unique name. ``drop`` removes those that no
    returned DataFrame reads any more.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{folder(spark)}/loomgraph/{purpose}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_column(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t if t is not None else "" for t in batch.column(name).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``step`` rows, so that few of their texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def row_function(
    f: Callable[[pa.RecordBatch], dict[str, object]], schema: pa.Schema, step: int = 512
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` over slices of at most ``step`` rows, so that output never piles up beside a whole batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                made = f(batch.slice(at, step))
                yield pa.RecordBatch.from_arrays([made[x.name] if isinstance(made[x.name], pa.Array) else pa.array(made[x.name], type=x.type) for x in schema], schema=schema)

    return run


_held: dict[str, Callable[[], None]] = {}


def begin(work: str, release: Callable[[], None] | None = None) -> None:
    """Tells a Python worker what it works on now; what other work holds in memory goes.

    Spark hands a worker on from operator to operator, and each keeps tables of words.
    """
    gone = [k for k in _held if k != work]
    for k in gone:
        _held.pop(k)()
    if gone:
        gc.collect()
        pa.default_memory_pool().release_unused()
    if release:
        _held[work] = release


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply) that spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges(a, b)``; component is the smallest node reachable."""
    return graphs.connected_components(edges.select(F.col("a").alias("from"), F.col("b").alias("to")))
