"""Edge weights, degrees and the threshold heuristic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weight_edges(edges: DataFrame, label: str = "edgeType", weight: str | None = None, weighted: bool = True) -> DataFrame:
    """Sum of weights (or 1 a row) per (from, to, label); 1 everywhere if not ``weighted``."""
    total = F.sum(F.col(weight) if weight else F.lit(1)) if weighted else F.lit(1)
    return edges.groupBy("from", "to", label).agg((total if weighted else F.first(total)).alias("weight"))


def weighted_graph(edges: DataFrame, label: str = "edgeType", up_weight: bool = False, above: float = 0) -> DataFrame:
    """(from, to, label, multiplicity, weight): multiplicity, with both ends' degrees added if ``up_weight``; kept if over ``above``.

    A degree counts distinct triples, so it follows the first aggregation and sees few rows.
    """
    triples = edges.groupBy("from", "to", label).agg(F.count("*").alias("multiplicity"))
    if not up_weight:
        return triples.withColumn("weight", F.col("multiplicity")).where(F.col("weight") > above)
    out = triples.groupBy(F.col("from").alias("node")).agg(F.count("*").alias("n_out"))
    into = triples.groupBy(F.col("to").alias("node")).agg(F.count("*").alias("n_in"))
    degree = out.join(into, "node", "full_outer").select("node", (F.coalesce("n_out", F.lit(0)) + F.coalesce("n_in", F.lit(0))).alias("degree"))
    source, target = degree.toDF("from", "d_from"), degree.toDF("to", "d_to")
    made = triples.join(source, "from", "left").join(target, "to", "left").withColumn("weight", F.col("multiplicity") + F.col("d_from") + F.col("d_to"))
    return made.where(F.col("weight") > above).select("from", "to", label, "multiplicity", "weight")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): times a node is an end of an edge."""
    return edges.select(F.col("from").alias("node")).unionAll(edges.select("to")).groupBy("node").agg(F.count("*").alias("degree"))


def weight_threshold(weights: DataFrame, limit: float = 5.0) -> DataFrame:
    """One row (threshold): the largest weight whose jump in cumulative share is over ``limit`` medians, else that of the largest jump.

    Weights are aggregated first; no window is needed: a jump in the cumulative share is the
    weight's own share of the mass; the least weight has none before it.
    """
    by = weights.groupBy("weight").agg(F.sum("weight").alias("mass"))
    total = by.agg(F.sum("mass").alias("total"), F.min("weight").alias("first"))
    jumps = by.join(F.broadcast(total)).where("weight > first").select("weight", (F.col("mass") / F.col("total")).alias("jump"))
    median = jumps.agg(F.median("jump").alias("median"))
    found = jumps.join(F.broadcast(median)).agg(
        F.max(F.when(F.col("jump") / F.col("median") > limit, F.col("weight"))).alias("over"), F.max_by("weight", F.struct("jump", "weight")).alias("widest")
    )
    return found.select(F.coalesce("over", "widest").alias("threshold"))
