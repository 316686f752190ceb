"""Tables behind pictures: histograms, pen widths, cluster colours; and local graph views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import highlight
from loomgraph.operators.windows import global_ids


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, n): equal-width bins from least to greatest value, empty ones left out."""
    bounds = df.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    at = F.least(F.floor((F.col(column) - F.col("_a")) / width), F.lit(bins - 1)).cast("int")
    counted = df.where(F.col(column).isNotNull()).join(F.broadcast(bounds)).groupBy(at.alias("bin"), "_a", "_b").agg(F.count("*").alias("n"))
    return counted.select("bin", (F.col("_a") + F.col("bin") * width).alias("low"), (F.col("_a") + (F.col("bin") + 1) * width).alias("high"), "n")


def styled(edges: DataFrame, most: float, scale: float = 1.0, cap: str = "red", plain: str = "black") -> DataFrame:
    """Edges with ``penwidth`` (weight up to ``most``, scaled) and a ``colour`` that tells capped ones."""
    capped = F.col("weight") > most
    return edges.withColumn("penwidth", F.least(F.col("weight").cast("double"), F.lit(float(most))) * scale).withColumn("colour", F.when(capped, cap).otherwise(plain))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight, both): one row a pair; ``both`` if it is linked in either direction."""
    a, b = F.least("from", "to"), F.greatest("from", "to")
    return edges.groupBy(a.alias("a"), b.alias("b")).agg(F.sum("weight").alias("weight"), (F.count_distinct("from") > 1).alias("both"))


def srl_graph(triples: DataFrame, top: int | None = None) -> DataFrame:
    """(from, to, label, weight) from role triples (arg0, verb, arg1), articles stripped; the heaviest ``top`` of them."""
    from loomgraph.functions.text import strip_articles

    g = triples.groupBy(strip_articles(F.col("arg0")).alias("from"), strip_articles(F.col("arg1")).alias("to"), F.lower("verb").alias("label")).agg(F.count("*").alias("weight"))
    return g.orderBy(F.desc("weight"), "from", "to", "label").limit(top) if top else g


def collapse(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """Edges between mentions with each replaced by its cluster's earliest mention: ``mentions(mention, cluster, position)``."""
    first = mentions.groupBy("cluster").agg(F.min_by("mention", F.struct("position", "mention")).alias("name"))
    names = mentions.select("mention", "cluster").distinct().join(first, "cluster").groupBy("mention").agg(F.min("name").alias("name"))
    for end in ("from", "to"):
        edges = edges.join(names.toDF(end, "_n"), end, "left").withColumn(end, F.coalesce("_n", end)).drop("_n")
    return edges.groupBy("from", "to").agg(F.sum("weight").alias("weight"))


#: Colours of clusters, by number (fixed values).
PALETTE = tuple(str(i) for i in range(1, 9))


def community_graph(edges: DataFrame, clusters: DataFrame, floor: float = 0.6, scale: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a similarity graph: nodes with a colour a cluster, largest first, edges with a pen width over ``floor``.

    Colours repeat after the palette's eight.
    """
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    numbered = global_ids(sizes.withColumn("_less", -F.col("n")), ["_less", "cluster"], "number")
    colour = F.element_at(F.array(*map(F.lit, PALETTE)), (F.pmod("number", F.lit(len(PALETTE))) + 1).cast("int"))
    nodes = clusters.join(numbered, "cluster").select("node", "cluster", colour.alias("colour"))
    return nodes, edges.withColumn("penwidth", (F.col("weight") - floor) * scale)


def topic_graph(links: DataFrame, terms: DataFrame, n: int = 20, low: float = 8.0, high: float = 32.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a topic graph whose nodes hold their terms.

    ``links(a, b, weight)`` joins topics, ``terms(topic, term, weight)`` says what they are about.
    Nodes are the topics and, as words inside them, the ``n`` heaviest terms of each with a font size
    between ``low`` and ``high`` by weight within the topic; ``inside`` names the topic that a word stands
    in. Edges keep their weights as pen widths.
    """
    from loomgraph.operators.topics import top_terms

    best = top_terms(terms, n)
    bounds = best.groupBy("topic").agg(F.min("weight").alias("_a"), F.max("weight").alias("_b"))
    share = F.when(F.col("_b") > F.col("_a"), (F.col("weight") - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(1.0)
    words = best.join(bounds, "topic").select(F.concat_ws("/", F.col("topic").cast("string"), "term").alias("node"), F.col("term").alias("label"), (low + (high - low) * share).alias("size"), F.col("topic").cast("string").alias("inside"))
    ends = links.select(F.col("a").alias("topic")).unionAll(links.select("b")).unionAll(terms.select("topic")).distinct()
    topics_ = ends.select(F.col("topic").cast("string").alias("node"), F.col("topic").cast("string").alias("label"), F.lit(float(high)).alias("size"), F.lit(None).cast("string").alias("inside"))
    return topics_.unionByName(words), links.select(F.col("a").cast("string").alias("from"), F.col("b").cast("string").alias("to"), F.col("weight").alias("penwidth"))


def keyword_rows(texts: DataFrame, colours: dict[str, str], text: str = "text", background: bool = True, ignore_case: bool = True) -> DataFrame:
    """Adds ``html``: every keyword in its colour, as background or as letters; one text, a list or a keyed table are rows alike."""
    c = F.col(text)
    for word, colour in colours.items():
        c = highlight(c, [word], f"{'background-color' if background else 'color'}:{colour}", ignore_case)
    return texts.withColumn("html", c)


def local_parts(combined: tuple[DataFrame, DataFrame] | None, ner: tuple[DataFrame, DataFrame] | None, srl: DataFrame | None) -> tuple[str, dict[str, DataFrame]]:
    """(name, tables) of the local graph to save: the combined one if there is one, else entities, else roles; none is ('', {})."""
    if combined is not None:
        return "combined", dict(zip(("edges", "nodes"), combined))
    if ner is not None:
        return "ner", dict(zip(("edges", "nodes"), ner))
    return ("srl", {"edges": srl}) if srl is not None else ("", {})
