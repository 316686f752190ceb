"""From raw links to typed nodes and edges, and the relational steps between."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.functions.scratch import stored
from loomgraph.functions.text import country


#: Rows that a task gathers by key, about; elements of two bags up to which they are compared within their row.
TASK_ROWS, SMALL_BAGS = 250_000, 1000


def endpoints(edges: DataFrame) -> DataFrame:
    """(node, type) of every end of an edge, each once."""
    return edges.select(F.col("from").alias("node"), F.col("fromNodeType").alias("type")).union(edges.select("to", "toNodeType")).distinct()


def mapped(c: Column, table: dict[str, str]) -> Column:
    """A CASE over a small table; null for other values."""
    return reduce(lambda w, kv: w.when(c == kv[0], kv[1]), list(table.items())[1:], F.when(c == next(iter(table)), table[next(iter(table))]))


def rename_types(edges: DataFrame, names: dict[str, str]) -> DataFrame:
    return edges.withColumn("edgeType", F.coalesce(mapped(F.col("edgeType"), names), "edgeType"))


def flip(edges: DataFrame, node_type: str) -> DataFrame:
    """Edges that point to a node type turned round, with their types."""
    turn = F.col("toNodeType") == node_type
    swap = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a)).alias(a)
    return edges.select(swap("from", "to"), swap("to", "from"), "edgeType", swap("fromNodeType", "toNodeType"), swap("toNodeType", "fromNodeType"))


def touched(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are an end of an edge.

    Ends are dealt by their number, and not broadcast on a guess of their bytes: names
    compress well, so parts of equal bytes would hold many millions.
    """
    ends = edges.select(F.col("from").alias("nodeID")).union(edges.select("to"))
    return nodes.join(ends.repartition(1 + 2 * edges.count() // TASK_ROWS, "nodeID").distinct().hint("merge"), "nodeID", "left_semi")


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with at least one end among nodes: two left joins with marks, no union of copies."""
    marked = nodes.select("nodeID").distinct().withColumn("_in", F.lit(True))
    for end in ("from", "to"):
        edges = edges.join(marked.toDF(end, f"_{end}"), end, "left")
    return edges.where("_from OR _to").drop("_from", "_to")


def constrained(df: DataFrame, above: dict[str, float]) -> DataFrame:
    """Rows that are strictly above every limit."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k) > v for k, v in above.items()], F.lit(True)))


def with_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the types of both ends, null where a node is unknown."""
    t = nodes.select("nodeID", "nodeType")
    return edges.join(t.toDF("from", "fromType"), "from", "left").join(t.toDF("to", "toType"), "to", "left").select("from", "to", "fromType", "toType")


def both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends exist."""
    ids = nodes.select("nodeID").distinct()
    return edges.join(ids.toDF("from"), "from", "left_semi").join(ids.toDF("to"), "to", "left_semi")


def natural_join(a: DataFrame, b: DataFrame, keys: list[str], suffix: str = "_new") -> DataFrame:
    """Inner join on keys; the right side's clashing columns get a suffix."""
    return a.join(b.withColumnsRenamed({c: c + suffix for c in b.columns if c not in keys and c in a.columns}), keys)


def consolidate(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Distinct values of each column per key, always as arrays."""
    return df.groupBy(*keys).agg(*[F.collect_set(c).alias(c) for c in columns])


def multiset(df: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """Sizes of the intersection, union and difference of two bags per key, '' and nulls left out; no row for empty bags.

    Bags of up to SMALL_BAGS elements whose key does not repeat are compared within their
    row; only the others are exploded and counted by key and element.
    """
    again = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key, F.lit(True).alias("_again"))
    full = lambda bag: F.coalesce(F.filter(bag, lambda x: x != ""), F.array().cast("array<string>"))
    bags = df.select(key, full(a).alias("a"), full(b).alias("b")).join(again, key, "left")
    apart = F.col(key).isNotNull() & F.col("_again").isNull() & (F.size("a") + F.size("b") <= SMALL_BAGS)

    many = bags.where(~apart)
    one = many.select(key, F.explode("a").alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(many.select(key, F.explode("b"), F.lit(0), F.lit(1)))
    counts = one.groupBy(key, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    grouped = counts.groupBy(key).agg(F.sum(F.least("a", "b")).alias("common"), F.sum(F.greatest("a", "b")).alias("either"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("only"))

    times = lambda bag, v: F.size(F.filter(bag, lambda x: x == v))
    shared = F.aggregate(F.array_intersect("a", "b"), F.lit(0), lambda n, v: n + F.least(times("a", v), times("b", v)))
    few = bags.where(apart & (F.size("a") + F.size("b") > 0)).select(key, shared.cast("long").alias("common"), F.size("a").cast("long").alias("_a"), F.size("b").cast("long").alias("_b"))
    return few.select(key, "common", (F.col("_a") + F.col("_b") - F.col("common")).alias("either"), (F.col("_a") - F.col("common")).alias("only")).unionAll(grouped)


# --- raw links ---

_ID = {
    "Paper": lambda p: F.when(F.try_variant_get(p, "$.origin", "string").isNotNull(), F.concat(F.coalesce(F.try_variant_get(p, "$.origin", "string"), F.lit("")), F.coalesce(F.try_variant_get(p, "$.origin_id", "string"), F.lit("")))).otherwise(F.try_variant_get(p, "$", "string")),
    "Scientist": lambda p: F.coalesce(F.try_variant_get(p, "$.origin_id", "string"), F.concat(F.lit("Scientist"), F.try_variant_get(p, "$.name", "string")), F.lit("REMOVE ME")),
}


def node_id(payload: Column, kind: Column) -> Column:
    """The id of a payload: by type a composed key, else its name, else the payload itself."""
    named = F.coalesce(F.try_variant_get(payload, "$.name", "string"), F.try_variant_get(payload, "$", "string"))
    return F.when(kind == "Paper", _ID["Paper"](payload)).when(kind == "Scientist", _ID["Scientist"](payload)).otherwise(named)


def restructure_links(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from raw links whose ends are JSON text: an object, a string, or a list of them.

    Lists are exploded. Institutions come out of scientists' payloads, with ``Belongs To``
    edges to them and ``Located At`` edges to their countries; ids of institutions are name
    and address together, on nodes and edges alike. Sentinels and blanks are dropped.
    Payloads are parsed once: what is read of them is written to a table, and institutions
    stand there once a scientist.
    """
    flat = links
    for end in ("from", "to"):
        flat = flat.withColumn("_v", F.try_parse_json(F.col(end))).withColumn("_many", F.ltrim(F.col(end), F.lit(" \t\n\r")).startswith("["))
        many = F.when(F.col("_many"), F.try_variant_get("_v", "$", "array<variant>")).otherwise(F.array("_v"))
        flat = flat.withColumn(end, F.explode_outer(many)).drop("_v", "_many")
    kinds = {"from": F.col("fromNodeType"), "to": F.col("toNodeType")}
    title = lambda e: F.coalesce(F.try_variant_get(e, "$.title", "string"), F.try_variant_get(e, "$.name", "string"))
    at = lambda e, k: F.when(k == "Scientist", F.try_variant_get(e, "$.institutions", "array<struct<name:string,address:string>>"))
    read = [c.alias(f"{e}_{name}") for e, k in kinds.items() for name, c in (("id", node_id(F.col(e), k)), ("title", title(e)), ("at", at(e, k)))]
    ids = flat.select("edgeType", "fromNodeType", "toNodeType", *read)
    good = stored(ids.where(F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & ~F.col("from_id").isin("", "REMOVE ME") & ~F.col("to_id").isin("", "REMOVE ME")))
    ends = good.select(F.col("from_id").alias("nodeID"), F.col("from_title").alias("title"), F.col("fromNodeType").alias("nodeType"), F.col("from_at").alias("at")).unionAll(good.select("to_id", "to_title", "toNodeType", "to_at"))
    plain = ends.select("nodeID", F.coalesce("title", "nodeID").alias("displayName"), "nodeType")
    inst = ends.where("nodeType = 'Scientist'").select("nodeID", F.explode("at").alias("i")).select("nodeID", "i.name", "i.address").distinct()
    inst = inst.select("nodeID", F.concat(F.coalesce("name", F.lit("")), F.coalesce("address", F.lit(""))).alias("inst"), "name", country(F.col("address")).alias("country")).where("inst <> ''")
    inst = stored(inst)
    institutions = inst.select(F.col("inst").alias("nodeID"), F.col("name").alias("displayName"), F.lit("Institution").alias("nodeType"))
    places = inst.where("country <> ''").select(F.col("country").alias("nodeID"), F.col("country").alias("displayName"), F.lit("Location").alias("nodeType"))
    all_nodes = plain.unionByName(institutions).unionByName(places).groupBy("nodeID", "nodeType").agg(F.min("displayName").alias("displayName")).select("nodeID", "displayName", "nodeType")
    links_ = good.select(F.col("from_id").alias("from"), F.col("to_id").alias("to"), "edgeType", "fromNodeType", "toNodeType")
    belongs = inst.select(F.col("nodeID").alias("from"), F.col("inst").alias("to"), F.lit("Belongs To").alias("edgeType"), F.lit("Scientist").alias("fromNodeType"), F.lit("Institution").alias("toNodeType"))
    located = inst.where("country <> ''").select(F.col("inst").alias("from"), F.col("country").alias("to"), F.lit("Located At").alias("edgeType"), F.lit("Institution").alias("fromNodeType"), F.lit("Location").alias("toNodeType"))
    all_edges = flip(rename_types(links_, schema.EDGE_RENAMES), "Funding Agency").unionByName(belongs).unionByName(located)
    return all_nodes, all_edges.distinct()


def single_valued(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose array columns hold exactly one element each, which takes the array's place in lower case."""
    kept = df.where(reduce(lambda a, b: a & b, [F.coalesce(F.size(c), F.lit(-1)) == 1 for c in columns], F.lit(True)))
    return kept.withColumns({c: F.lower(F.element_at(c, 1)) for c in columns})
