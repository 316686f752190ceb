"""Writers: graphs by type, null-dropping JSON lines, audit tables, months, DOT statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_empty_columns(df: DataFrame) -> DataFrame:
    """Without columns that are null or '' in every row; one pass over the table."""
    counts = df.agg(*[F.count(F.when(F.col(f"`{c}`").cast("string") != "", 1)).alias(c) for c in df.columns]).first()
    return df.select(*[f"`{c}`" for c in df.columns if counts[c]])


def save_by_type(df: DataFrame, folder: str, type_column: str = "nodeType", mode: str = "overwrite") -> None:
    """JSON lines in one folder a type; null fields are left out, so a column that is null for all of a type is not in its files."""
    df.repartition(F.col(type_column), F.spark_partition_id() % 8).write.mode(mode).option("ignoreNullFields", True).partitionBy(type_column).json(folder)


def save_local_graph(name: str, folder: str, combined=None, ner=None, srl=None) -> str:
    """JSON lines of a document's graph under ``{folder}/{name}_local_graph_{kind}_{edges,nodes}``; gives the kind that was saved."""
    from loomgraph.operators.views import local_parts

    kind, tables = local_parts(combined, ner, srl)
    for part, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", True).json(f"{folder}/{name}_local_graph_{kind}_{part}")
    return kind


def save_topics(documents: DataFrame, shares: DataFrame, terms: DataFrame, folder: str, model=None) -> None:
    """Topic results: ``document_topics`` (documents with one column a topic) and ``topic_terms`` by topic as CSV, and the model.

    ``shares(key, topic, p)`` and ``terms(topic, term, weight)``; the number of topics is a parameter of the model, so the pivot is narrow.
    """
    numbers = [r.topic for r in shares.select("topic").distinct().orderBy("topic").collect()]  # one row a topic
    wide = shares.groupBy("key").pivot("topic", numbers).agg(F.first("p"))
    key = documents.columns[0]
    documents.join(wide.withColumnRenamed("key", key), key, "left").write.mode("overwrite").csv(f"{folder}/document_topics", header=True, escape='"')
    terms.repartition("topic").sortWithinPartitions("topic", F.desc("weight"), "term").write.mode("overwrite").partitionBy("topic").csv(f"{folder}/topic_terms", header=True, escape='"')
    if model is not None:  # topics x terms numbers, a row a term
        rows = [(t, model.alpha[:, i].tolist(), model.information[:, i].tolist()) for i, t in enumerate(model.terms)]
        terms.sparkSession.createDataFrame(rows, "term string, alpha array<double>, information array<double>").write.mode("overwrite").parquet(f"{folder}/topic_model")


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str, mode: str = "overwrite") -> None:
    save_by_type(nodes, f"{folder}/nodes", "nodeType", mode)
    save_by_type(edges, f"{folder}/edges", "edgeType", mode)


def append_json(df: DataFrame, folder: str) -> None:
    df.write.mode("append").option("ignoreNullFields", True).json(folder)


def append_log(df: DataFrame, folder: str) -> None:
    """Blacklists and merge logs."""
    df.write.mode("append").csv(folder, header=True)


def save_months(df: DataFrame, folder: str, seconds: Column) -> None:
    """Parquet by month of an epoch column; months of different years meet, as readers of the layout expect."""
    df.withColumn("month", F.month(F.timestamp_seconds(seconds))).write.mode("overwrite").partitionBy("month").parquet(folder)


def cached(spark, folder: str, make) -> DataFrame:
    """A saved result if there is one, else a new one, saved."""
    from loomgraph.sources.readers import exists

    if not exists(spark, f"{folder}/_SUCCESS"):
        make().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def dot_lines(nodes: DataFrame, edges: DataFrame, most: float = 5.0) -> DataFrame:
    """One DOT statement a row: nodes with labels, edges with pen widths in proportion to capped weights."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(f"`{c}`"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    n = nodes.select(F.concat(quoted("nodeID"), F.lit(" [label="), quoted("displayName"), F.lit("];")).alias("line"))
    e = edges.select(F.concat(quoted("from"), F.lit(" -> "), quoted("to"), F.lit(" [penwidth="), F.format_number(F.least(F.col("weight"), F.lit(most)), 2), F.lit("];")).alias("line"))
    return n.unionByName(e)
