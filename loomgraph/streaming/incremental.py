"""Incremental counterparts (an extension): duplicates within a watermark, edge weights per window, upserts of nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import duplicate_key


def distinct_nodes(stream: DataFrame, name: str, at: str, late: str = "1 hour", clean: Callable[[Column], Column] = duplicate_key) -> DataFrame:
    """The first node of each cleaned name within the watermark; state is dropped behind it."""
    return stream.withColumn("key", clean(F.coalesce(F.col(name), F.lit("")))).withWatermark(at, late).dropDuplicatesWithinWatermark(["key"])


def windowed_weights(stream: DataFrame, at: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, from, to, edgeType, weight) of a stream of edges."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), "from", "to", "edgeType").agg(F.count("*").alias("weight"))


def upsert(stream: DataFrame, folder: str, key: str, checkpoint: str):
    """Keeps one row a key in a table: each batch is merged with the table into a new version, then swapped in.

    Versions are named by batch, so a batch that runs twice writes the same version.
    """
    from loomgraph.sources.readers import exists

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{folder}/v{number - 1}"
        rows = batch if not exists(spark, before) else spark.read.parquet(before).unionByName(batch)
        cols = [c for c in rows.columns if c != key]
        rows.groupBy(key).agg(*[F.first(c, True).alias(c) for c in cols]).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()
