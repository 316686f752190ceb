"""Representation quality: alignment, uniformity, pair sampling, context windows, macro-F1."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import arrays
from loomgraph.functions.scratch import stored


def macro_f1(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row (f1): the mean of the classes' F1, from counts per (label, prediction)."""
    counts = df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    sides = counts.select(F.col("y").alias("k"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), "n").unionAll(counts.select("p", F.lit(0), "n"))
    by = sides.groupBy("k").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    return by.agg(F.avg(2.0 * F.col("tp") / F.col("n")).alias("f1"))


#: Items of a bucket in which partners are sought.
BUCKET_ROWS = 4096


def _dealt(df: DataFrame, key: str, label: str, k: int, seed: int, within: bool) -> DataFrame:
    """(a, label, bucket): items in buckets of BUCKET_ROWS or so, of one label each if ``within``, else large enough that other labels come up."""
    rows = df.select(F.col(key).alias("a"), F.col(label).alias("label")).where("label IS NOT NULL")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    h = F.xxhash64("a", F.lit(seed))
    if within:
        return rows.join(counts.select("label", F.greatest(F.lit(1), F.floor(F.col("n") / BUCKET_ROWS)).alias("_k")), "label").select("a", "label", F.pmod(h, F.col("_k")).alias("bucket"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("top")).first()
    buckets = max(1, min(total.n // BUCKET_ROWS, (total.n - total.top) // (16 * k)))
    return rows.withColumn("bucket", F.pmod(h, F.lit(buckets)))


def same_label_pairs(df: DataFrame, key: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """(a, label, b): ``k`` partners with the same label for each item, all others where there are fewer.

    Partners are the next ones around a bucket in a seeded order. Labels are split over
    buckets, so one label may be any share of the rows. Keys are distinct.
    """
    dealt = _dealt(df, key, label, k, seed, True)
    w = Window.partitionBy("label", "bucket")
    placed = dealt.withColumn("r", F.row_number().over(w.orderBy(F.xxhash64("a", F.lit(seed + 1)), "a")) - 1).withColumn("n", F.count("*").over(w))
    asked = placed.where("n > 1").select("a", "label", "bucket", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n") - 1).cast("int")), lambda i: F.pmod(F.col("r") + i, F.col("n")))).alias("r"))
    return asked.join(placed.select("label", "bucket", "r", F.col("a").alias("b")), ["label", "bucket", "r"]).select("a", "label", "b")


def different_label_pairs(df: DataFrame, key: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """(a, b): ``k`` partners with another label for each item, all of its bucket's where there are fewer.

    In a bucket items stand label by label around a circle; an item's partners are some of
    those outside its label's arc. Buckets grow where one label holds most rows.
    """
    dealt = _dealt(df, key, label, k, seed, False)
    whole, arc = Window.partitionBy("bucket"), Window.partitionBy("bucket", "label")
    h = F.xxhash64("a", F.lit(seed + 1))
    placed = dealt.withColumn("r", F.row_number().over(whole.orderBy("label", h, "a")) - 1).withColumn("n", F.count("*").over(whole))
    placed = placed.withColumn("m", F.count("*").over(arc)).withColumn("end", F.max("r").over(arc) + 1).withColumn("h", h)
    others = F.col("n") - F.col("m")
    steps = F.transform(F.sequence(F.lit(0), F.least(F.lit(k), others).cast("int") - 1), lambda i: F.pmod(F.col("end") + F.pmod(F.col("h") + i, others), F.col("n")))
    asked = placed.where("n > m").select("a", "bucket", F.explode(steps).alias("r"))
    return asked.join(placed.select("bucket", "r", F.col("a").alias("b")), ["bucket", "r"]).select("a", "b")


#: Rows of a matrix of pairs; the parts that vectors are dealt to; the most rows of a part, beyond which there are more parts.
TILE_ROWS, MOST_PARTS, PART_ROWS = 1024, 32, 65_536


def _parts(rows: int) -> int:
    """Parts of a table of vectors: a tile each while those are few, so that what is sent grows with the rows, not their square."""
    return max(1, min(-(-rows // TILE_ROWS), MOST_PARTS), -(-rows // PART_ROWS))


def label_alignment_uniformity(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(alignment, uniformity) over all pairs: equal labels for the one, different labels for the other.

    Alignment comes from sums a label, as the squared distances of n unit vectors add up to
    n^2 less the squared length of their sum; no pairs are formed. Uniformity compares
    parts of vectors tile by tile as matrices, a pair of parts one task's work; sums come
    back. Each vector is sent once a part, so parts are few (``_parts``).
    Vectors are of one dimension, and rows without vector or label don't count.
    """
    rows = vectors.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
    unit = stored(rows.select(F.col(key).alias("k"), F.col(label).alias("label"), arrays.unit(F.transform(vector, lambda x: x.cast("double"))).alias("v")))
    sums = unit.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    by = sums.groupBy("label").agg(F.first("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("s2"))
    same = by.agg((F.sum(F.col("n") * F.col("n") - F.col("s2")) / F.sum(F.col("n") * (F.col("n") - 1) / 2)).alias("alignment"))
    parts = _parts(unit.count())
    part = F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int")
    spread = unit.withColumn("p", part).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    blocks = spread.select(F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), (F.col("p") <= F.col("q")).alias("left"), (F.col("p") >= F.col("q")).alias("right"), F.xxhash64("label").alias("label"), "v")

    def compared(block: pd.DataFrame) -> pd.DataFrame:
        x, y = block[block["left"]], block[block["right"]]
        if x.empty or y.empty:
            return pd.DataFrame({"s": [0.0], "n": [0]})
        (v, k), (w, l) = ((np.stack(z["v"]), z["label"].to_numpy()) for z in (x, y))
        total, count = 0.0, 0
        for a in range(0, len(v), TILE_ROWS):
            for b in range(0, len(w), TILE_ROWS):
                other = k[a : a + TILE_ROWS, None] != l[None, b : b + TILE_ROWS]
                total += float(np.exp(4 * (v[a : a + TILE_ROWS] @ w[b : b + TILE_ROWS].T) - 4).sum(where=other))
                count += int(other.sum())
        half = 2 if block["i"].iloc[0] == block["j"].iloc[0] else 1  # a part against itself holds each pair twice
        return pd.DataFrame({"s": [total / half], "n": [count // half]})

    apart = blocks.groupBy("i", "j").applyInPandas(compared, "s double, n long").agg(F.log(F.sum("s") / F.sum("n")).alias("uniformity"))
    return same.crossJoin(apart)  # a row each


def alignment_uniformity(pairs: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(alignment, uniformity) over ``pairs(a, b, same)``: mean squared distance of pairs alike, log mean exp(-2 d^2) of others."""
    v = vectors.select(F.col(key).alias("_k"), arrays.unit(F.transform(vector, lambda x: x.cast("double"))).alias("_v"))
    joined = pairs.join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b").withColumn("d2", arrays.squared_distance(F.col("va"), F.col("vb")))
    return joined.agg(F.avg(F.when(F.col("same"), F.col("d2"))).alias("alignment"), F.log(F.avg(F.when(~F.col("same"), F.exp(-2 * F.col("d2"))))).alias("uniformity"))


def label_index(df: DataFrame, label: str) -> DataFrame:
    """(label, index): sorted distinct labels numbered from 0; the window sees labels, not rows."""
    return df.select(label).distinct().withColumn("index", F.row_number().over(Window.orderBy(label)) - 1)


def context_window(df: DataFrame, words: str, start: str, end: str, k: int, to: str = "context") -> DataFrame:
    """Adds the words of [start - k, end + k) of an array."""
    low = F.greatest(F.col(start) - k, F.lit(0))
    return df.withColumn(to, F.slice(F.col(words), (low + 1).cast("int"), (F.col(end) + k - low).cast("int")))


def masked_features(df: DataFrame, words: str, start: str, end: str, size: int, mask: str = "[MASK]", pad: str = "[PAD]") -> DataFrame:
    """Adds ``tokens`` (entity masked, padded) and ``attention`` for a window of words."""
    w = F.concat(F.slice(words, F.lit(1), F.col(start)), F.array(F.lit(mask)), F.slice(words, F.col(end) + 1, F.greatest(F.size(words) - F.col(end), F.lit(0))))
    return df.withColumn("tokens", arrays.padded(w, size, pad)).withColumn("attention", arrays.padded(F.transform(w, lambda x: F.lit(1)), size, 0))
