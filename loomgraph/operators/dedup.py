"""Exact duplicates of nodes under a normalised key, and rewriting edges to what is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import duplicate_key


def duplicate_groups(nodes: DataFrame, name: str = "displayName", node: str = "nodeID", others: tuple[str, ...] = ("nodeType",), clean: Callable[[Column], Column] = duplicate_key) -> DataFrame:
    """Groups of two or more nodes equal in ``others`` and in the cleaned name: key, kept (least id), size.

    Nulls count as blanks. Members are not gathered: a group of any size is three numbers.
    """
    key = clean(F.coalesce(F.col(name), F.lit("")))
    same = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in others]
    return nodes.groupBy(key.alias("key"), *same).agg(F.min(node).alias("kept"), F.count("*").alias("size")).where("size > 1")


def mappings(nodes: DataFrame, name: str = "displayName", node: str = "nodeID", others: tuple[str, ...] = ("nodeType",), clean: Callable[[Column], Column] = duplicate_key) -> DataFrame:
    """(old, new) for every node that a group's least id replaces."""
    groups = duplicate_groups(nodes, name, node, others, clean)
    keyed = nodes.select(F.col(node).alias("old"), clean(F.coalesce(F.col(name), F.lit(""))).alias("key"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in others])
    return keyed.join(groups, ["key", *others]).where("old <> kept").select("old", F.col("kept").alias("new")).distinct()


def remap_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends replaced where the mapping has them, each once."""
    columns = edges.columns
    for end in ("from", "to"):
        m = mapping.select(F.col("old").alias(end), F.col("new").alias("_new"))
        edges = edges.join(m, end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    return edges.select(*columns).distinct()


def merge_nodes(nodes: DataFrame, mapping: DataFrame, node: str = "nodeID") -> DataFrame:
    """Nodes without those that a mapping replaces."""
    return nodes.join(mapping.select(F.col("old").alias(node)).distinct(), node, "left_anti")


def remove_duplicates(nodes: DataFrame, edges: DataFrame, **how: object) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after one round of duplicate removal."""
    mapping = mappings(nodes, **how)
    return merge_nodes(nodes, mapping, how.get("node", "nodeID")), remap_edges(edges, mapping)


def drop_named(nodes: DataFrame, names: list[str], name: str = "displayName") -> DataFrame:
    """Nodes whose name is not among those given."""
    return nodes.where(~F.coalesce(F.col(name), F.lit("")).isin(names))
