"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset and the master is local (tests), a local folder is made and set.

    On several machines a local folder is a different one for each, and a table read back
    from it lacks what others wrote, so there the setting is asked for.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = local_folder(spark.sparkContext.master)
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def local_folder(master: str) -> str:
    """A new folder of this machine for a master on this machine alone; refused for any other."""
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir is unset; under the master {master} it must name a folder that all machines share")
    return "file://" + tempfile.mkdtemp(prefix="loomgraph-")


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a table written now."""
    path = f"{folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes the files of tables from ``stored`` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            spark = df.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
