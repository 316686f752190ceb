"""Queries for sources, projections, filters, joins, aggregations, windows, sorts and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.scratch import folder
from loomgraph.operators import dedup, etl, tables, weights, windows
from loomgraph.plans.registry import query, table
from loomgraph.sources import readers, writers

EDGES_SQL = (
    "(SELECT 'C' || o_custkey AS \"from\", 'O' || o_orderkey AS \"to\", 'Placed' AS \"edgeType\", 'Customer' AS \"fromNodeType\", 'Order' AS \"toNodeType\" FROM orders "
    "UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'Located At', 'Customer', 'Nation' FROM customer "
    "UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'Located At', 'Supplier', 'Nation' FROM supplier "
    "UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'Part Of', 'Nation', 'Region' FROM nation)"
)
NODES_SQL = (
    "(SELECT 'C' || c_custkey AS \"nodeID\", c_name AS \"displayName\", 'Customer' AS \"nodeType\" FROM customer UNION ALL SELECT 'S' || s_suppkey, s_name, 'Supplier' FROM supplier "
    "UNION ALL SELECT 'N' || n_nationkey, n_name, 'Nation' FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name, 'Region' FROM region)"
)
TRADE_SQL = (
    "(SELECT 'N' || c_nationkey AS \"from\", 'N' || s_nationkey AS \"to\", l_returnflag AS \"edgeType\" FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"
)


def _id(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def edges(s: SparkSession, d: str) -> DataFrame:
    """Typed edges: orders placed, places of customers and suppliers, regions of nations."""
    kinds = (("orders", "C", "o_custkey", "O", "o_orderkey", "Placed", "Customer", "Order"), ("customer", "C", "c_custkey", "N", "c_nationkey", "Located At", "Customer", "Nation"),
             ("supplier", "S", "s_suppkey", "N", "s_nationkey", "Located At", "Supplier", "Nation"), ("nation", "N", "n_nationkey", "R", "n_regionkey", "Part Of", "Nation", "Region"))
    made = [table(s, d, t).select(_id(p, a).alias("from"), _id(q, b).alias("to"), F.lit(e).alias("edgeType"), F.lit(x).alias("fromNodeType"), F.lit(y).alias("toNodeType")) for t, p, a, q, b, e, x, y in kinds]
    return made[0].unionAll(made[1]).unionAll(made[2]).unionAll(made[3])


def nodes(s: SparkSession, d: str) -> DataFrame:
    kinds = (("customer", "C", "c_custkey", "c_name", "Customer"), ("supplier", "S", "s_suppkey", "s_name", "Supplier"), ("nation", "N", "n_nationkey", "n_name", "Nation"), ("region", "R", "r_regionkey", "r_name", "Region"))
    made = [table(s, d, t).select(_id(p, k).alias("nodeID"), F.col(n).alias("displayName"), F.lit(x).alias("nodeType")) for t, p, k, n, x in kinds]
    return made[0].unionAll(made[1]).unionAll(made[2]).unionAll(made[3])


def trade(s: SparkSession, d: str) -> DataFrame:
    """One edge a line item: customer's nation to supplier's nation, typed by return flag."""
    c = table(s, d, "customer").select("c_custkey", "c_nationkey")
    l = table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").join(table(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    l = l.join(c, F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return l.select(_id("N", "c_nationkey").alias("from"), _id("N", "s_nationkey").alias("to"), F.col("l_returnflag").alias("edgeType"))


def _roundtrip(s: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{folder(s)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ---


@query(f"SELECT * FROM {NODES_SQL}")
def src01_src06_nodes_roundtrip(s, d):
    """Nodes saved by type as JSON lines and loaded again."""
    path = _roundtrip(s, "nodes")
    writers.save_by_type(nodes(s, d), path)
    return readers.load_nodes(s, path).select("nodeID", "displayName", "nodeType")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def src03_src04_csv(s, d):
    path = _roundtrip(s, "customers") + ".csv"
    table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.csv(path, header=True)
    return readers.load_table(s, path, "c_custkey long, c_name string, c_acctbal double")


@query("SELECT doc_id::VARCHAR AS id, md5(text) AS h FROM documents UNION ALL SELECT '0', md5('a text itself')")
def src05_documents(s, d):
    """Documents from a frame, and a text given as such."""
    both = readers.load_documents(s, table(s, d, "documents"), "text", "doc_id").unionByName(readers.load_documents(s, "a text itself"))
    return both.select("id", F.md5("report").alias("h"))



@query(f"SELECT count(*) AS n_edges, (SELECT count(*) FROM {NODES_SQL}) AS n_nodes FROM {EDGES_SQL} WHERE \"edgeType\" IN ('Located At', 'Part Of')")
def src07_src08_graph_subset(s, d):
    path = _roundtrip(s, "graph")
    writers.save_graph(nodes(s, d), edges(s, d), path)
    n, e = readers.load_graph(s, path, None, ["Located At", "Part Of"])
    return e.agg(F.count("*").alias("n_edges")).crossJoin(n.agg(F.count("*").alias("n_nodes")))


@query(f"SELECT \"nodeType\", count(*) AS n FROM {NODES_SQL} GROUP BY 1")
def src09_resume(s, d):
    """Saved customers, topped up with the other types."""
    path = _roundtrip(s, "resume")
    n = nodes(s, d)
    writers.save_by_type(n.where("nodeType = 'Customer'"), path)
    return readers.resume(s, path, n).groupBy("nodeType").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type, value FROM events")
def src10_json_lines(s, d):
    path = _roundtrip(s, "events") + ".jsonl"
    writers.append_json(table(s, d, "events").select("event_id", "event_type", "value"), path)
    return readers.load_table(s, path, "event_id long, event_type string, value double")


@query("SELECT doc_id AS path, 'T' || doc_id AS title, 'src' || doc_id % 20 AS surname FROM documents")
def src12_tei(s, d):
    """TEI papers parsed by XPath."""
    i = F.col("doc_id").cast("string")
    x = F.concat(F.lit("<TEI><teiHeader><fileDesc><titleStmt><title>T"), i, F.lit("</title></titleStmt><sourceDesc><author><persName><surname>src"), (F.col("doc_id") % 20).cast("string"), F.lit("</surname></persName></author></sourceDesc></fileDesc></teiHeader></TEI>"))
    rows = readers.author_rows(readers.parse_tei(table(s, d, "documents").select(F.col("doc_id").alias("path"), x.alias("x"))).withColumn("t", F.col("title")))
    titles = readers.parse_tei(table(s, d, "documents").select(F.col("doc_id").alias("path"), x.alias("x"))).select("path", "title")
    return rows.join(titles, rows["paper"] == titles["path"]).select("path", "title", "surname")


@query("SELECT 'N' || n_nationkey AS code, CASE WHEN n_nationkey % 2 = 0 THEN replace(n_name, '_', ' ') ELSE 'N' || n_nationkey END AS label FROM nation")
def src16_code_table(s, d):
    """A saved code table, read back and looked up; codes that it lacks keep themselves."""
    path = _roundtrip(s, "codes") + ".csv"
    n = table(s, d, "nation").select(_id("N", "n_nationkey").alias("code"), F.replace("n_name", F.lit("_"), F.lit(" ")).alias("label"), "n_nationkey")
    n.where("n_nationkey % 2 = 0").select("code", "label").write.csv(path, header=True)
    return tables.labelled(n.select("code"), readers.load_taxonomy(s, path), "code").select("code", "label")



@query("SELECT DISTINCT regexp_extract(x, '^([^ (]+)', 1) AS code, regexp_extract(x, '^[^ (]+ *\\(?([^)]*)', 1) AS label FROM (SELECT unnest(regexp_extract_all(html, '<a(?: [^>]*)?>([^<]*)</a>', 1)) AS x FROM pages) WHERE regexp_extract(x, '^([^ (]+)', 1) <> ''")
def src17_taxonomy(s, d):
    return readers.taxonomy_from_html(table(s, d, "pages"))


@query("SELECT doc_id, lang, term FROM documents JOIN (VALUES ('en', 'the'), ('fr', 'que'), ('de', 'der')) k(lang, term) USING (lang) WHERE contains(text, term)")
def src18_keywords(s, d):
    k = readers.keyword_table(s, {"demo": {"en": ["the"], "fr": ["que"], "de": ["der"]}})
    return table(s, d, "documents").join(F.broadcast(k), "lang").where(F.contains("text", "term")).select("doc_id", "lang", "term")


@query("WITH p AS (SELECT 'S' || s_suppkey AS a, 'S' || (s_suppkey + 1) AS b FROM supplier) SELECT a AS \"from\", b AS \"to\" FROM p UNION SELECT b, a FROM p")
def src19_blacklist(s, d):
    pairs = table(s, d, "supplier").select(_id("S", "s_suppkey").alias("from"), F.concat(F.lit("S"), (F.col("s_suppkey") + 1).cast("string")).alias("to"))
    path = _roundtrip(s, "blacklist")
    writers.append_log(pairs, path)
    return readers.load_blacklist(s, path).select("from", "to")


@query("SELECT user_id AS iteration, event_id AS chunk FROM events ORDER BY user_id DESC, event_id DESC LIMIT 1")
def src20_last_state(s, d):
    return readers.last_state(table(s, d, "events").select(F.col("user_id").alias("iteration"), F.col("event_id").alias("chunk")))


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1")
def src15_src21_cached(s, d):
    path = _roundtrip(s, "cache")
    make = lambda: table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    writers.cached(s, path, make)
    return writers.cached(s, path, make)


@query("SELECT month(ts)::INT AS month, count(*) AS n FROM events GROUP BY 1")
def snk06_months(s, d):
    path = _roundtrip(s, "months")
    writers.save_months(table(s, d, "events").select("event_id", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("sec")), path, F.col("sec"))
    return s.read.parquet(path).groupBy(F.col("month").cast("int").alias("month")).agg(F.count("*").alias("n"))


@query(f"SELECT e.\"from\", e.\"to\", f.\"nodeType\" AS \"fromType\", t.\"nodeType\" AS \"toType\" FROM {EDGES_SQL} e LEFT JOIN {NODES_SQL} f ON f.\"nodeID\" = e.\"from\" LEFT JOIN {NODES_SQL} t ON t.\"nodeID\" = e.\"to\"")
def snk04_jn02_endpoint_types(s, d):
    return etl.with_types(edges(s, d).select("from", "to"), nodes(s, d))


@query("SELECT event_type AS type, string_agg(user_id || ':' || n, ',' ORDER BY user_id) AS counts FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def snk09_summary_counts(s, d):
    c = tables.value_maps(table(s, d, "events"), "event_type", "user_id")
    return c.select(F.col("event_type").alias("type"), F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat_ws(":", x["key"].cast("string"), x["value"].cast("string"))), ",").alias("counts"))



@query(f"SELECT count(*) AS lines FROM (SELECT \"nodeID\" FROM {NODES_SQL} UNION ALL SELECT \"from\" FROM {TRADE_SQL} GROUP BY \"from\", \"to\", \"edgeType\")")
def snk12_vis01_dot(s, d):
    return writers.dot_lines(nodes(s, d), weights.weight_edges(trade(s, d))).agg(F.count("*").alias("lines"))


# --- projections and filters ---


@query(f"SELECT DISTINCT \"from\" AS node, \"fromNodeType\" AS type FROM {EDGES_SQL} UNION SELECT \"to\", \"toNodeType\" FROM {EDGES_SQL}")
def prj01_endpoints(s, d):
    return etl.endpoints(edges(s, d))


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Book' WHEN 'STANDARD' THEN 'Journal' WHEN 'PROMO' THEN 'Conference' END AS kind FROM part")
def prj02_type_mapping(s, d):
    return table(s, d, "part").select("p_partkey", etl.mapped(F.col("p_type"), {"ECONOMY": "Book", "STANDARD": "Journal", "PROMO": "Conference"}).alias("kind"))


@query(f"SELECT \"from\" AS source, \"to\" AS target, CASE \"edgeType\" WHEN 'Placed' THEN 'Ordered' ELSE \"edgeType\" END AS \"edgeType\" FROM {EDGES_SQL}")
def prj03_prj04_rename(s, d):
    e = edges(s, d).withColumnsRenamed({"from": "source", "to": "target"}).drop("fromNodeType", "toNodeType", "absent")
    return etl.rename_types(e, {"Placed": "Ordered"})


@query(f"SELECT \"to\" AS \"from\", \"from\" AS \"to\", \"edgeType\" FROM {EDGES_SQL} WHERE \"toNodeType\" = 'Region' UNION ALL SELECT \"from\", \"to\", \"edgeType\" FROM {EDGES_SQL} WHERE \"toNodeType\" <> 'Region'")
def prj05_flip(s, d):
    return etl.flip(edges(s, d), "Region").select("from", "to", "edgeType")


@query("SELECT event_id, coalesce((props->>'k'), '') AS k, coalesce((props->>'absent'), '') AS absent FROM events")
def prj06_prj07_fields(s, d):
    e = table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.absent").alias("absent"))
    return e.fillna("", ["k", "absent"])


@query("SELECT n_nationkey, n_name FROM nation")
def prj08_drop_empty_columns(s, d):
    return writers.without_empty_columns(table(s, d, "nation").select("n_nationkey", "n_name", F.lit("").alias("blank"), F.lit(None).cast("string").alias("gone")))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('5-LOW')")
def flt01_isin(s, d):
    return table(s, d, "orders").where(F.col("o_orderstatus").isin("F", "P") & ~F.col("o_orderpriority").isin("5-LOW")).select("o_orderkey")


@query(f"SELECT * FROM {NODES_SQL} WHERE \"nodeID\" IN (SELECT \"from\" FROM {EDGES_SQL} WHERE \"edgeType\" = 'Placed')")
def flt02_jn10_semi(s, d):
    return etl.touched(nodes(s, d), edges(s, d).where("edgeType = 'Placed'"))


@query(f"SELECT \"from\", \"to\" FROM {EDGES_SQL} WHERE \"from\" IN ('N1', 'N2', 'C5') OR \"to\" IN ('N1', 'N2', 'C5')")
def flt03_touching(s, d):
    keep = nodes(s, d).where(F.col("nodeID").isin("N1", "N2", "C5")).select("nodeID")
    return etl.touching(edges(s, d), keep).select("from", "to")


@query(f"SELECT \"from\", \"to\" FROM {EDGES_SQL} WHERE \"edgeType\" = 'Located At' AND \"fromNodeType\" <> 'Supplier' AND \"from\" NOT IN ('C0', '')")
def flt04_flt05_flt06_filters(s, d):
    e = edges(s, d).na.drop(subset=["from", "to"]).where("edgeType = 'Located At' AND fromNodeType <> 'Supplier'")
    return e.where(~F.col("from").isin("C0", "")).select("from", "to")


@query("SELECT sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS strict, sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END)::BIGINT AS inclusive FROM events")
def flt07_flt08_thresholds(s, d):
    return table(s, d, "events").agg(F.count_if(F.col("value") > 50).alias("strict"), F.count_if(F.col("value") >= 50).alias("inclusive"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount > 0.05 AND l_tax > 0.04")
def flt09_constraints(s, d):
    return etl.constrained(table(s, d, "lineitem"), {"l_quantity": 45, "l_discount": 0.05, "l_tax": 0.04}).select("l_orderkey", "l_linenumber")


@query("SELECT item_id, len(list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '[a-zA-Z]')))::BIGINT AS n FROM benchmark WHERE len(list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '[a-zA-Z]'))) BETWEEN 3 AND 349")
def flt10_sentence_filter(s, d):
    n = F.size(F.filter(F.split("text", " "), lambda x: x.rlike("[a-zA-Z]")))
    return table(s, d, "benchmark").select("item_id", n.cast("long").alias("n")).where("n > 2 AND n < 350")


@query("SELECT p_partkey, w FROM (SELECT p_partkey, unnest(string_split(p_name || ' [CLS] 12 [SEP]', ' ')) AS w FROM part) WHERE w NOT IN ('[CLS]', '[SEP]') AND length(trim(regexp_replace(w, '[^a-zA-Z]', '', 'g'))) > 0")
def flt11_token_filter(s, d):
    w = table(s, d, "part").select("p_partkey", F.explode(F.split(F.concat("p_name", F.lit(" [CLS] 12 [SEP]")), " ")).alias("w"))
    return w.where(~F.col("w").isin("[CLS]", "[SEP]") & (F.length(F.regexp_replace("w", "[^a-zA-Z]", "")) > 0))


@query(f"SELECT \"from\", \"to\", count(*) AS n FROM {TRADE_SQL} WHERE \"from\" <> \"to\" GROUP BY 1, 2")
def flt12_no_self_pairs(s, d):
    return trade(s, d).where("`from` <> `to`").groupBy("from", "to").agg(F.count("*").alias("n"))


@query(f"SELECT * FROM {NODES_SQL} WHERE \"displayName\" NOT IN ('NATION_1', 'ASIA')")
def flt13_drop_named(s, d):
    return dedup.drop_named(nodes(s, d), ["NATION_1", "ASIA"])


# --- joins ---


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def jn01_inner(s, d):
    return table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query(f"SELECT e.\"from\", e.\"to\" FROM {EDGES_SQL} e JOIN {NODES_SQL} f ON f.\"nodeID\" = e.\"from\" JOIN {NODES_SQL} t ON t.\"nodeID\" = e.\"to\"")
def jn03_both_ends(s, d):
    return etl.both_ends(edges(s, d), nodes(s, d)).select("from", "to")


@query(
    f"WITH t AS (SELECT \"from\", \"to\", \"edgeType\" FROM {TRADE_SQL} GROUP BY 1, 2, 3), a AS (SELECT \"from\" AS node, count(*) AS n FROM t GROUP BY 1), b AS (SELECT \"to\" AS node, count(*) AS n FROM t GROUP BY 1) "
    "SELECT coalesce(a.node, b.node) AS node, coalesce(a.n, 0) + coalesce(b.n, 0) AS degree FROM a FULL JOIN b ON a.node = b.node"
)
def jn04_jn05_degrees(s, d):
    return weights.degrees(trade(s, d).distinct())


@query("SELECT a.s_suppkey, a.s_suppkey % 7 = 0 AS blacklist FROM supplier a")
def jn06_flag_join(s, d):
    a = table(s, d, "supplier").select("s_suppkey")
    return a.join(a.where("s_suppkey % 7 = 0").withColumn("blacklist", F.lit(True)), "s_suppkey", "left").fillna(False, ["blacklist"])


@query("WITH l AS (SELECT s_nationkey, avg(s_acctbal) AS m FROM supplier GROUP BY 1) SELECT c_custkey, round((coalesce(l.m, 0) + coalesce(k.m, 0)) / 2, 6) AS mean FROM customer LEFT JOIN l ON l.s_nationkey = c_nationkey LEFT JOIN l k ON k.s_nationkey = (c_nationkey + 1) % 25")
def jn07_two_sided_average(s, d):
    m = table(s, d, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("m"))
    c = table(s, d, "customer").select("c_custkey", "c_nationkey", ((F.col("c_nationkey") + 1) % 25).alias("next"))
    both = c.join(m.toDF("c_nationkey", "m_from"), "c_nationkey", "left").join(m.toDF("next", "m_to"), "next", "left")
    return both.select("c_custkey", F.round((F.coalesce("m_from", F.lit(0.0)) + F.coalesce("m_to", F.lit(0.0))) / 2, 6).alias("mean"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def jn08_counts_with_members(s, d):
    return tables.counts_with_members(table(s, d, "customer"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")



@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey")
def jn09_lookup(s, d):
    lookup = table(s, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(s, d, "customer").join(F.broadcast(lookup), "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey, l_suppkey) IN (SELECT (p, k) FROM (SELECT min(l_partkey) AS p, l_suppkey AS k FROM lineitem GROUP BY l_suppkey)) AS flagged FROM lineitem")
def jn11_composite_flag(s, d):
    l = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    keys = l.groupBy("l_suppkey").agg(F.min("l_partkey").alias("l_partkey")).withColumn("flagged", F.lit(True))
    return l.join(keys, ["l_partkey", "l_suppkey"], "left").select("l_orderkey", "l_linenumber", F.coalesce("flagged", F.lit(False)).alias("flagged"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '1%')")
def jn12_anti(s, d):
    """Customers without an urgent order in progress."""
    o = table(s, d, "orders").where("o_orderstatus = 'P' AND o_orderpriority LIKE '1%'")
    return table(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")



@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def jn13_jn15_pairs_in_group(s, d):
    n = table(s, d, "nation").select("n_nationkey", "n_regionkey")
    return n.withColumnRenamed("n_nationkey", "a").join(n.withColumnRenamed("n_nationkey", "b"), "n_regionkey").where("a < b").select("a", "b")


@query("SELECT o_orderkey, a || '-' || b AS pair FROM (SELECT o_orderkey, unnest([o_orderstatus, 'x']) AS a, o_orderpriority FROM orders) JOIN (SELECT unnest(['p', 'q']) AS b) ON true")
def jn14_product_of_lists(s, d):
    """Products of two short lists of a row, without a join."""
    a, b = F.array("o_orderstatus", F.lit("x")), F.array(F.lit("p"), F.lit("q"))
    return table(s, d, "orders").select("o_orderkey", F.explode(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, F.lit("-"), y))))).alias("pair"))


@query("SELECT conv_id, turn, md5(text) AS h, length(text)::BIGINT AS n FROM conversations")
def jn16_positional(s, d):
    """Two frames side by side by their rows' positions, repeated columns once."""
    c = table(s, d, "conversations")
    left, right = c.select("conv_id", "turn", F.md5("text").alias("h")), c.select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return tables.zip_rows(left, right, ["conv_id", "turn"])



@query(
    "WITH b AS (SELECT item_id, unnest(range(0, 200, 50)) AS at FROM benchmark), r AS (SELECT item_id, i, i * 60 AS s, (i + 1) * 60 AS e FROM (SELECT item_id, unnest(range(0, 5)) AS i FROM benchmark)) "
    "SELECT b.item_id, b.at, min(r.i)::INT AS sentence FROM b JOIN r ON b.item_id = r.item_id AND b.at >= r.s AND b.at < r.e GROUP BY 1, 2"
)
def jn18_range(s, d):
    """First range that holds each offset; ranges meet only within their document."""
    b = table(s, d, "benchmark").select("item_id")
    at = b.select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(150).cast("long"), F.lit(50).cast("long"))).alias("at"))
    r = b.select("item_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("sentence")).withColumns({"start": F.col("sentence") * 60, "end": (F.col("sentence") + 1) * 60})
    return tables.first_range(at, r, "item_id", "at", number="sentence")



@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS head, string_split(p_name, ' ')[2] AS tail FROM part")
def jn19_index_lookup(s, d):
    ends = tables.items_at(F.split("p_name", " "), F.array(F.lit(0), F.lit(1)))
    return table(s, d, "part").select("p_partkey", ends.alias("e")).select("p_partkey", F.element_at("e", 1).alias("head"), F.element_at("e", 2).alias("tail"))



@query("SELECT s_suppkey, s_name, s_name || '!' AS s_name_new FROM supplier")
def jn20_natural(s, d):
    a = table(s, d, "supplier").select("s_suppkey", "s_name")
    return etl.natural_join(a, a.withColumn("s_name", F.concat("s_name", F.lit("!"))), ["s_suppkey"])


# --- aggregations ---


@query(f"SELECT \"from\", \"to\", \"edgeType\", count(*) AS weight FROM {TRADE_SQL} GROUP BY 1, 2, 3")
def agg01_edge_weights(s, d):
    return weights.weight_edges(trade(s, d))


@query(
    f"WITH t AS (SELECT \"from\", \"to\", \"edgeType\", count(*) AS multiplicity FROM {TRADE_SQL} GROUP BY 1, 2, 3), g AS (SELECT node, count(*) AS n FROM (SELECT \"from\" AS node FROM t UNION ALL SELECT \"to\" FROM t) GROUP BY 1) "
    "SELECT t.*, multiplicity + a.n + b.n AS weight FROM t JOIN g a ON a.node = \"from\" JOIN g b ON b.node = \"to\" WHERE multiplicity + a.n + b.n > 150"
)
def agg02_weighted_graph(s, d):
    """The trade graph between nations, weighted by multiplicity and degrees, above a threshold."""
    return weights.weighted_graph(trade(s, d), up_weight=True, above=150)


@query("SELECT l_partkey AS \"from\", l_suppkey AS \"to\", round(sum(l_quantity), 6) AS weight FROM lineitem GROUP BY 1, 2")
def agg03_weight_sums(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("from"), F.col("l_suppkey").alias("to")).agg(F.round(F.sum("l_quantity"), 6).alias("weight"))


@query(f"SELECT \"edgeType\" AS type, format('{{:,}}', count(*)) AS n FROM {EDGES_SQL} GROUP BY 1")
def agg04_type_counts(s, d):
    return edges(s, d).groupBy(F.col("edgeType").alias("type")).agg(F.format_number(F.count("*"), 0).alias("n"))


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def agg05_first_by_order(s, d):
    return table(s, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))


@query("SELECT l_quantity AS weight, max(l_orderkey * 10 + l_linenumber) AS last FROM lineitem GROUP BY 1")
def agg06_keep_last(s, d):
    last = tables.keep_last(table(s, d, "lineitem").select("l_quantity", "l_orderkey", "l_linenumber"), ["l_quantity"], [F.col("l_orderkey") * 10 + F.col("l_linenumber")])
    return last.select(F.col("l_quantity").alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("last"))



@query("SELECT DISTINCT event_type, props FROM events")
def agg07_distinct_rows(s, d):
    return table(s, d, "events").select("event_type", "props").dropDuplicates()


@query("SELECT md5(trim(regexp_replace(regexp_replace(lower(p_name), '[.,!?$]', ' ', 'g'), ' +', ' ', 'g'))) AS key, p_brand, min(p_partkey) AS kept, count(*) AS size FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def agg08_er14_duplicate_groups(s, d):
    g = dedup.duplicate_groups(table(s, d, "part"), "p_name", "p_partkey", ("p_brand",))
    return g.select(F.md5("key").alias("key"), "p_brand", "kept", "size")


@query("SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types, count(DISTINCT p_size) AS sizes FROM part GROUP BY 1")
def agg09_consolidate(s, d):
    return etl.consolidate(table(s, d, "part"), ["p_brand"], ["p_type", "p_size"]).select("p_brand", F.array_join(F.array_sort("p_type"), "|").alias("types"), F.size("p_size").cast("long").alias("sizes"))


@query(f"SELECT node, count(*) AS degree FROM (SELECT \"from\" AS node FROM {EDGES_SQL} UNION ALL SELECT \"to\" FROM {EDGES_SQL}) GROUP BY 1")
def agg10_degrees(s, d):
    return weights.degrees(edges(s, d))


@query(
    f"WITH g AS (SELECT node, count(*) AS n FROM (SELECT \"from\" AS node FROM {EDGES_SQL} UNION ALL SELECT \"to\" FROM {EDGES_SQL}) GROUP BY 1) "
    f"SELECT \"nodeType\", (SELECT node FROM g JOIN {NODES_SQL} m ON m.\"nodeID\" = g.node WHERE m.\"nodeType\" = x.\"nodeType\" ORDER BY n DESC, node LIMIT 1) AS top FROM (SELECT DISTINCT \"nodeType\" FROM {NODES_SQL}) x"
)
def agg11_argmax(s, d):
    g = weights.degrees(edges(s, d)).join(nodes(s, d), F.col("node") == F.col("nodeID"))
    best = g.groupBy("nodeType").agg(F.max("degree").alias("degree"))
    return g.join(best, ["nodeType", "degree"]).groupBy("nodeType").agg(F.min("node").alias("top"))


@query("SELECT p_brand, (SELECT p_name FROM part q WHERE q.p_brand = p.p_brand GROUP BY p_name ORDER BY count(*) DESC, length(p_name), p_name LIMIT 1) AS label FROM (SELECT DISTINCT p_brand FROM part) p")
def agg12_mode(s, d):
    return windows.mode_label(table(s, d, "part"), ["p_brand"], "p_name").select("p_brand", F.col("p_name").alias("label"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') > 0 AS f, count(*) FILTER (o_orderstatus = 'O') > 0 AS o, count(*) FILTER (o_orderstatus = 'P') > 0 AS p FROM orders GROUP BY 1")
def agg14_incidence(s, d):
    return tables.incidence(table(s, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]).toDF("o_orderpriority", "f", "o", "p")


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1 :]))
def agg15_agg16_correlation(s, d):
    """All pairs of measures: the upper triangle of the correlation matrix in long form."""
    return tables.correlations(table(s, d, "lineitem"), _MEASURES).select("a", "b", F.round("r", 6).alias("r"))



@query("SELECT conv_id, md5(string_agg(role, '-' ORDER BY turn)) AS roles FROM conversations GROUP BY 1")
def agg17_string_concat(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), "-")).alias("roles"))


@query("SELECT source AS doc, round(avg(n), 6) AS mean, max(n) AS longest, min(n) AS shortest, count(*) AS n FROM (SELECT source, length(text)::BIGINT AS n FROM documents) GROUP BY 1")
def agg19_nlp13_describe(s, d):
    from loomgraph.operators.nlp import describe

    return describe(table(s, d, "documents").select(F.col("source").alias("doc"), F.length("text").cast("long").alias("n")))


@query("SELECT w AS part, round(count(*) / sum(count(*)) OVER (), 6) AS likelihood FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def agg20_part_likelihood(s, d):
    return windows.shares(table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("part")), "part").select("part", F.round("share", 6).alias("likelihood"))


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT props) AS props FROM events")
def agg22_unique(s, d):
    return table(s, d, "events").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("props").alias("props"))


@query("SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, round(median(value), 6) AS mid, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def agg23_agg24_statistics(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.median("value"), 6).alias("mid"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    "WITH p AS (SELECT quality AS y, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT k, count(*) FILTER (y = k AND p = k) AS tp, count(*) FILTER (y = k) AS pos, count(*) FILTER (p = k) AS pred FROM p, (VALUES (0), (1)) v(k) GROUP BY k) "
    "SELECT round(avg(CASE WHEN pos + pred = 0 THEN 0 ELSE 2.0 * tp / (pos + pred) END), 6) AS f1 FROM c"
)
def agg25_macro_f1(s, d):
    from loomgraph.operators.representation import macro_f1

    p = table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select(F.col("quality").alias("label"), F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("prediction"))
    return macro_f1(p).select(F.round("f1", 6).alias("f1"))


# --- windows, sorts, sets ---


@query("SELECT event_id, round(CASE WHEN value > 10 THEN cume_dist() OVER (PARTITION BY event_type, value > 10 ORDER BY value) ELSE 0 END, 6) AS score FROM events")
def win01_percentile(s, d):
    e = table(s, d, "events").withColumn("v", F.when(F.col("value") > 10, F.col("value")).otherwise(0.0))
    return windows.percentile_of_positive(e, "v", ["event_type"]).select("event_id", F.round("percentile", 6).alias("score"))


@query("SELECT l_quantity AS weight, round(sum(sum(l_quantity)) OVER (ORDER BY l_quantity) / sum(sum(l_quantity)) OVER (), 6) AS share, row_number() OVER (ORDER BY l_quantity DESC) AS place FROM lineitem GROUP BY 1")
def win02_win03_cumulative(s, d):
    w = table(s, d, "lineitem").groupBy(F.col("l_quantity").alias("weight")).agg(F.sum("l_quantity").alias("mass"))
    return windows.cumulative(w).select("weight", F.round("share", 6).alias("share"), F.col("place").cast("long").alias("place"))


@query("SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS diff FROM events")
def win04_difference(s, d):
    return table(s, d, "events").select("event_id", F.round(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), 6).alias("diff"))


_P = "CASE WHEN event_type = 'purchase' THEN value END"


@query(
    f"SELECT event_id, last_value({_P} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS forward, "
    f"first_value({_P} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM events"
)
def win05_win06_fill(s, d):
    e = table(s, d, "events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return windows.filled(e, "v", ["user_id"], ["ts", "event_id"]).select("event_id", "forward", "backward")


@query("SELECT conv_id, turn, conv_id || '_' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS sentence_id FROM conversations")
def win07_running_id(s, d):
    return windows.running_ids(table(s, d, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", F.col("running_id").alias("sentence_id"))


@query("SELECT p_partkey, i - 1 AS author_order, i = 1 AS first_author, i = n AS last_author FROM (SELECT p_partkey, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i, len(string_split(p_name, ' ')) AS n FROM part)")
def win08_positions(s, d):
    p = table(s, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "w"), F.size(F.split("p_name", " ")).alias("n"))
    return p.select("p_partkey", F.col("i").cast("long").alias("author_order"), (F.col("i") == 0).alias("first_author"), (F.col("i") == F.col("n") - 1).alias("last_author"))


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS id FROM conversations")
def win09_global_id(s, d):
    """Numbers over all rows in a stated order, from per-partition counts: no single-partition window."""
    return windows.global_ids(table(s, d, "conversations").select("conv_id", "turn"), ["conv_id", "turn"])


@query("SELECT conv_id, turn, (sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1)::BIGINT AS start FROM conversations")
def win10_offsets(s, d):
    return windows.offsets(table(s, d, "conversations"), ["conv_id"], ["turn"], F.length("text")).select("conv_id", "turn", F.col("start").cast("long").alias("start"))


@query("SELECT p_partkey, round(1 + 3 * (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS scaled, round(pow(1 - p_retailprice / max(p_retailprice) OVER (), 4), 6) AS rare FROM part")
def win11_win12_rescale(s, d):
    p = windows.rescaled(table(s, d, "part"), "p_retailprice", 1, 4)
    return p.select("p_partkey", F.round("scaled", 6).alias("scaled"), F.round(F.pow(1 - F.col("p_retailprice") / F.col("high"), F.lit(4)), 6).alias("rare"))


@query("SELECT user_id, min(event_id) AS first, count(*) AS n, event_type FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, run, event_type")
def win13_runs(s, d):
    r = windows.runs(table(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return r.groupBy("user_id", "run", "event_type").agg(F.min("event_id").alias("first"), F.count("*").alias("n")).drop("run")


@query("SELECT l_partkey, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1 ORDER BY q DESC, l_partkey LIMIT 10")
def srt01_srt03_top(s, d):
    return table(s, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("q")).orderBy(F.desc("q"), "l_partkey").limit(10)


@query("SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS first, max_by(o_orderkey, o_orderkey) AS last FROM orders GROUP BY 1")
def srt02_head_tail(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("SELECT p_brand, word, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, word) AS k FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS word, count(*) AS n FROM part GROUP BY 1, 2)) WHERE k <= 3")
def srt04_top_per_group(s, d):
    w = table(s, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("word")).groupBy("p_brand", "word").agg(F.count("*").alias("n"))
    return windows.top_per_group(w, ["p_brand"], [F.desc("n"), F.asc("word")], 3).select("p_brand", "word", "n")


@query("SELECT c_nationkey AS cluster, count(*) AS size FROM customer GROUP BY 1 ORDER BY 2 DESC, 1")
def srt05_by_size(s, d):
    return table(s, d, "customer").groupBy(F.col("c_nationkey").alias("cluster")).agg(F.count("*").alias("size")).orderBy(F.desc("size"), "cluster")


@query("SELECT l_orderkey, min(l_partkey) AS least, min_by(l_suppkey, l_partkey * 100000 + l_suppkey) AS by_prefix FROM lineitem GROUP BY 1")
def srt06_srt07_least(s, d):
    key = F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    order = F.struct(F.split(key, "-")[0].cast("long"), "l_suppkey")
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("least"), F.min_by("l_suppkey", order).alias("by_prefix"))


@query(f"WITH n AS (SELECT count(DISTINCT \"nodeID\") AS n FROM {NODES_SQL}), c AS (SELECT unnest(range(0, ((SELECT n FROM n) + 499) // 500)) AS chunk) SELECT chunk, least(500, n - 500 * chunk) AS nodes, true AS apart FROM c, n")
def srt08_chunks(s, d):
    """Nodes in a seeded random order, cut into chunks: how many are in each, and whether each node is in one."""
    c = windows.chunks(nodes(s, d).select("nodeID"), "nodeID", 500)
    return c.groupBy("chunk").agg(F.count_distinct("nodeID").alias("nodes"), (F.count_distinct("nodeID") == F.count("*")).alias("apart"))



@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 5")
def srt09_cap(s, d):
    return table(s, d, "documents").select("doc_id").orderBy("doc_id").limit(5)


@query("SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def set01_union_by_name(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    k = table(s, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(k, allowMissingColumns=True)


@query(f"SELECT \"from\" AS node FROM {EDGES_SQL} UNION SELECT \"to\" FROM {EDGES_SQL}")
def set02_union_distinct(s, d):
    return edges(s, d).select(F.col("from").alias("node")).union(edges(s, d).select("to")).distinct()


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set03_difference(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("id")).subtract(table(s, d, "orders").where("o_orderstatus = 'P'").select("o_custkey"))



@query("SELECT l_orderkey AS id FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_discount > 0.08")
def set04_intersection(s, d):
    l = table(s, d, "lineitem")
    return l.where("l_quantity > 45").select(F.col("l_orderkey").alias("id")).intersect(l.where("l_discount > 0.08").select("l_orderkey"))


@query(
    "WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS c, 1 AS a, 0 AS b FROM part UNION ALL SELECT p_partkey, unnest(string_split(p_type, '')), 0, 1 FROM part), g AS (SELECT p_partkey, c, sum(a) AS a, sum(b) AS b FROM c GROUP BY 1, 2) "
    "SELECT p_partkey, sum(least(a, b))::BIGINT AS common, sum(greatest(a, b))::BIGINT AS either, sum(greatest(a - b, 0))::BIGINT AS only FROM g GROUP BY 1"
)
def set05_multisets(s, d):
    return etl.multiset(table(s, d, "part"), "p_partkey", F.split("p_name", ""), F.split("p_type", ""))


@query("SELECT vec_id, least(3, count(*) OVER (PARTITION BY label) - 1) AS partners, true AS alike FROM embeddings")
def set06_pair_sampling(s, d):
    """Three partners of the same label an item, by a seeded hash: how many distinct ones, and whether all are alike."""
    from loomgraph.operators.representation import same_label_pairs

    e = table(s, d, "embeddings").select("vec_id", "label")
    pairs = same_label_pairs(e, "vec_id", "label", 3).join(e.toDF("b", "lb"), "b").where("a <> b")
    return pairs.groupBy(F.col("a").alias("vec_id")).agg(F.count_distinct("b").alias("partners"), F.bool_and(F.col("label") == F.col("lb")).alias("alike"))


