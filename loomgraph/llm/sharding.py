"""Sharding by extendible hashing, in DataFrame operations only.

A document's hash is the first 60 bits of the MD5 of its key. A shard is a prefix of those
bits; a shard over its byte limit splits on the next bit, others stay as they are. The
splits are found on sums of bytes per prefix (the directory), never on the texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch

#: Bits of a hash.
BITS = 60


def hash_bits(key: Column) -> Column:
    """60 hash bits of a key as a long; null hashes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def assign_shards(df: DataFrame, limit_bytes: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, depth, shard_id, shard_bytes, shard_docs) of every row.

    ``shard_id`` is the prefix with a leading one bit: unique over all depths. A shard is
    closed at the least depth where its bytes are within the limit or where all its rows
    have one hash (a single document over the limit, or rows that repeat a key), which no
    further bit can split. Null texts have 0 bytes; an empty table has no shards.
    """
    scratch = Scratch(df.sparkSession, "sharding")
    rows = df.select(df[key].alias("key"), F.coalesce(F.octet_length(df[text]), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(df[key]).alias("h"))
    active, at, turn, done = scratch.save(rows, "rows-0"), 0, 0, None
    total = active.agg(F.sum("n_bytes")).first()[0] or 0
    step = min(20, max(2, math.ceil(math.log2(max(1, total / limit_bytes))) + 2))
    while True:
        turn += 1
        to = min(BITS, at + step)
        cell = F.expr(f"shiftright(h, {BITS - to})")
        cells = scratch.save(
            active.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"), F.min("h").alias("low"), F.max("h").alias("high")),
            f"cells-{turn}",
        )
        # Every cell counts towards its prefix at each depth from here to its own.
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(at), F.lit(to)))).withColumn("prefix", F.expr(f"shiftright(cell, {to} - depth)"))
        sums = levels.groupBy("depth", "prefix").agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), (F.min("low") == F.max("high")).alias("one")
        ).where((F.col("shard_bytes") <= limit_bytes) | F.col("one") | (F.col("depth") == BITS))
        closed = levels.select("cell", "depth", "prefix").join(sums, ["depth", "prefix"]).groupBy("cell").agg(
            F.min_by(F.struct("depth", "prefix", "shard_bytes", "shard_docs"), "depth").alias("s")
        )
        directory = scratch.save(closed.select("cell", "s.*"), f"directory-{turn}")
        placed = active.withColumn("cell", cell).join(directory, "cell").select(
            "key", "n_bytes", F.col("depth").cast("int").alias("depth"), F.expr("shiftleft(1L, cast(depth as int)) + prefix").alias("shard_id"), "shard_bytes", "shard_docs"
        )
        done = placed if done is None else done.unionByName(placed)
        if to == BITS or cells.join(directory, "cell", "left_anti").limit(1).count() == 0:
            return done.withColumnRenamed("key", key)
        # Only rows of shards still over the limit go on to further bits.
        active = scratch.save(active.withColumn("cell", cell).join(directory.select("cell"), "cell", "left_anti").drop("cell"), f"rows-{turn}")
        at = to


def write_shards(df: DataFrame, folder: str, limit_bytes: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes the rows of ``df`` into one Parquet folder per shard and returns the assignment."""
    shards = assign_shards(df, limit_bytes, text, key)
    once = shards.select(F.col(key).alias("_key"), "shard_id").distinct()
    df.join(once, df[key].eqNullSafe(F.col("_key"))).drop("_key").repartition("shard_id").write.partitionBy("shard_id").parquet(folder)
    return shards


#: DuckDB's form of ``assign_shards``; {limit} is the byte limit.
SQL = """
WITH k AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT d, h >> (60 - d)::INT AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs, min(h) = max(h) AS one
  FROM k CROSS JOIN range(0, 61) AS r(d) GROUP BY 1, 2
), g AS (
  SELECT u.h, min(s.d) AS depth
  FROM (SELECT DISTINCT h FROM k) u CROSS JOIN range(0, 61) AS r(d)
  JOIN s ON s.d = r.d AND s.prefix = u.h >> (60 - r.d)::INT
  WHERE s.shard_bytes <= {limit} OR s.one OR s.d = 60 GROUP BY u.h
)
SELECT k.doc_id, k.n_bytes, g.depth::INT AS depth, (1::BIGINT << g.depth::INT) + s.prefix AS shard_id, s.shard_bytes, s.shard_docs
FROM k JOIN g USING (h) JOIN s ON s.d = g.depth AND s.prefix = k.h >> (60 - g.depth)::INT
"""
