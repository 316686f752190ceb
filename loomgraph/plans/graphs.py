"""Queries for graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.scratch import stored
from loomgraph.operators import dedup, etl, factored, graphs, similarity, weights
from loomgraph.plans.registry import query, table
from loomgraph.plans.resolution import CHARS, names
from loomgraph.plans.relational import EDGES_SQL, NODES_SQL, TRADE_SQL, edges, nodes, trade


def supply(s, d):
    """Distinct supplier-part edges."""
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("from"), F.col("l_partkey").alias("to")).distinct()


_SUPPLY = "(SELECT DISTINCT l_suppkey AS \"from\", l_partkey AS \"to\" FROM lineitem)"
_PROJ = f"(SELECT a.\"from\" AS u, b.\"from\" AS v, count(*) AS weight FROM {_SUPPLY} a JOIN {_SUPPLY} b ON a.\"to\" = b.\"to\" AND a.\"from\" < b.\"from\" GROUP BY 1, 2)"


def gatherings(s, d):
    """Customers and the days on which they ordered at one priority and status: a sparse graph of all orders."""
    day = F.concat_ws("|", F.to_date("o_orderdate").cast("string"), "o_orderpriority", "o_orderstatus")
    return table(s, d, "orders").select(F.col("o_custkey").alias("from"), day.alias("to")).distinct()


_MET = "(SELECT DISTINCT o_custkey AS c, o_orderdate::DATE AS d, o_orderpriority AS p, o_orderstatus AS s FROM orders)"
_MEETINGS = f"(SELECT a.c AS u, b.c AS v, count(*) AS weight FROM {_MET} a JOIN {_MET} b ON a.d = b.d AND a.p = b.p AND a.s = b.s AND a.c < b.c GROUP BY 1, 2)"


@query(
    "SELECT 'Paper' AS \"nodeType\", count(DISTINCT o_orderkey) AS n, 'nodes' AS part FROM orders UNION ALL SELECT 'Scientist', count(DISTINCT o_custkey), 'nodes' FROM orders "
    "UNION ALL SELECT 'Institution', count(DISTINCT c_nationkey), 'nodes' FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'Location', count(DISTINCT n_regionkey), 'nodes' FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
    "UNION ALL SELECT 'Author Of', count(*), 'edges' FROM orders UNION ALL SELECT 'Belongs To', count(DISTINCT o_custkey), 'edges' FROM orders UNION ALL SELECT 'Located At', count(DISTINCT c_nationkey), 'edges' FROM orders JOIN customer ON o_custkey = c_custkey"
)
def gr01_gr02_gr03_restructure_links(s, d):
    """Raw links with JSON payloads to typed nodes and edges: orders as papers, customers as scientists, nations as institutions."""
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    inst = F.array(F.struct(F.col("n_name").alias("name"), F.concat_ws(", ", F.lit("1 Main St"), "r_name").alias("address")))
    links = o.select(
        F.to_json(F.struct(F.concat(F.lit("sci"), F.col("c_custkey").cast("string")).alias("origin_id"), F.col("c_name").alias("name"), inst.alias("institutions"))).alias("from"),
        F.to_json(F.array(F.struct(F.lit("ord").alias("origin"), F.col("o_orderkey").cast("string").alias("origin_id"), F.col("o_orderpriority").alias("title")))).alias("to"),
        F.lit("Scientist").alias("fromNodeType"), F.lit("Paper").alias("toNodeType"), F.lit("Authored").alias("edgeType"),
    )
    n_, e_ = etl.restructure_links(links)
    return n_.groupBy("nodeType").agg(F.count("*").alias("n")).withColumn("part", F.lit("nodes")).unionByName(e_.groupBy(F.col("edgeType").alias("nodeType")).agg(F.count("*").alias("n")).withColumn("part", F.lit("edges")))


@query(f"SELECT * FROM {_PROJ}")
def gr04_projection(s, d):
    return graphs.projection(supply(s, d))


@query(f"SELECT a.s_suppkey AS u, a.s_suppkey + 1 AS v, coalesce(p.weight, 0) AS weight FROM supplier a LEFT JOIN {_PROJ} p ON p.u = a.s_suppkey AND p.v = a.s_suppkey + 1")
def gr05_one_hop(s, d):
    pairs = table(s, d, "supplier").select(F.col("s_suppkey").alias("u"), (F.col("s_suppkey") + 1).alias("v"))
    return graphs.shared_neighbours(pairs, supply(s, d))


@query(
    f"WITH p AS {_MEETINGS}, w AS (SELECT u, v, weight FROM p UNION ALL SELECT v, u, weight FROM p) SELECT a.u, b.v, sum(a.weight + b.weight)::BIGINT AS score FROM w a JOIN w b ON a.v = b.u WHERE a.u < b.v AND NOT EXISTS (SELECT 1 FROM p WHERE p.u = a.u AND p.v = b.v) GROUP BY 1, 2"
)
def gr06_jn17_two_hop(s, d):
    return factored.factored_projection(gatherings(s, d)).two_hop()


@query(
    f"WITH p AS {_MEETINGS}, w AS (SELECT u, v, weight FROM p UNION ALL SELECT v, u, weight FROM p), far AS (SELECT a.u, b.v, sum(a.weight + b.weight)::BIGINT AS weight FROM w a JOIN w b ON a.v = b.u WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.u = a.u AND w.v = b.v) GROUP BY 1, 2) "
    "SELECT c_custkey AS u, c_custkey + 1 AS v, coalesce(weight, 0) AS weight FROM customer LEFT JOIN far ON far.u = c_custkey AND far.v = c_custkey + 1"
)
def gr06_two_steps(s, d):
    """The two-step weight of given pairs, without the projection."""
    return graphs.two_steps(table(s, d, "customer").select(F.col("c_custkey").alias("u"), (F.col("c_custkey") + 1).alias("v")), gatherings(s, d))


_BRANDS = "(SELECT DISTINCT l_orderkey AS \"from\", p_brand AS \"to\" FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(
    f"WITH e AS {_BRANDS}, n AS (SELECT count(DISTINCT \"from\")::DOUBLE AS n FROM e), k AS (SELECT \"to\", count(*)::DOUBLE AS k FROM e GROUP BY 1), s AS (SELECT a.\"to\" AS a, b.\"to\" AS b, count(*)::DOUBLE AS n11 FROM e a JOIN e b ON a.\"from\" = b.\"from\" AND a.\"to\" < b.\"to\" GROUP BY 1, 2) "
    "SELECT a, b, round(phi, 6) AS phi FROM (SELECT a, b, (n * n11 - x.k * y.k) / sqrt(x.k * (n - x.k) * y.k * (n - y.k)) AS phi FROM s JOIN k x ON x.\"to\" = a JOIN k y ON y.\"to\" = b, n) WHERE phi > 0"
)
def gr07_phi_graph(s, d):
    e = table(s, d, "lineitem").select("l_orderkey", "l_partkey").join(table(s, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    g = graphs.phi_graph(e.select(F.col("l_orderkey").alias("from"), F.col("p_brand").alias("to")))
    return g.select("a", "b", F.round("phi", 6).alias("phi"))


@query(
    "SELECT a, b, round(c, 6) AS similarity FROM (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(list_transform(x.embedding, lambda v: v::DOUBLE), list_transform(y.embedding, lambda v: v::DOUBLE)) AS c FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id) WHERE c > 0.3"
)
def gr08_cosine_graph(s, d):
    return graphs.cosine_graph(table(s, d, "embeddings"), "vec_id", "embedding", "label", 0.3).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("SELECT round(avg(c), 6) AS mean, label AS cluster FROM (SELECT x.label, list_cosine_similarity(list_transform(x.embedding, lambda v: v::DOUBLE), list_transform(y.embedding, lambda v: v::DOUBLE)) AS c FROM embeddings x JOIN embeddings y ON x.label = y.label) GROUP BY label")
def agg13_cluster_mean(s, d):
    """Mean cosine within a label, the diagonal included: the squared length of the mean unit vector, so no pairs are formed."""
    from loomgraph.functions import arrays

    u = table(s, d, "embeddings").select("label", F.posexplode(arrays.unit(F.transform("embedding", lambda x: x.cast("double")))).alias("i", "x"))
    m = u.groupBy("label", "i").agg(F.avg("x").alias("m"))
    return m.groupBy(F.col("label").alias("cluster")).agg(F.round(F.sum(F.col("m") * F.col("m")), 6).alias("mean"))


@query()
def gr09_communities(s, d):
    g = graphs.cosine_graph(table(s, d, "embeddings"), "vec_id", "embedding", "label", 0.3)
    return graphs.communities(g.select(F.col("a").alias("from"), F.col("b").alias("to"), F.col("similarity").alias("weight")))


@query("SELECT a.c_custkey AS \"from\", b.c_custkey AS \"to\", 'Colleague' AS \"edgeType\", 1::BIGINT AS weight FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey")
def gr10_indirect_edges(s, d):
    e = table(s, d, "customer").select(F.col("c_custkey").alias("from"), F.col("c_nationkey").alias("to"), F.lit("Belongs To").alias("edgeType"))
    return graphs.indirect_edges(e, "Belongs To", "Colleague")


_VISITS = "(SELECT DISTINCT user_id AS u, ts::DATE AS d FROM events WHERE event_type = 'purchase')"
_SEEN = f"(SELECT a.u AS u, b.u AS v, count(*) AS weight FROM {_VISITS} a JOIN {_VISITS} b ON a.d = b.d AND a.u < b.u GROUP BY 1, 2)"


def visits(s, d):
    """Users and the days on which they bought something."""
    return table(s, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("from"), F.to_date("ts").alias("to")).distinct()


@query("WITH c AS (SELECT c_nationkey, min(c_custkey) AS twin, count(*) AS n FROM customer GROUP BY 1) SELECT twin AS a, twin AS b, 1::BIGINT AS weight FROM c WHERE n > 1")
def gr10_factored_links(s, d):
    """Colleagues as classes: a row a nation in place of a row a pair of its customers."""
    e = table(s, d, "customer").select(F.col("c_custkey").alias("from"), F.col("c_nationkey").alias("to"))
    return factored.factored_projection(e).links.select("a", "b", F.col("weight").cast("long").alias("weight"))


@query(f"WITH p AS {_SEEN}, w AS (SELECT u, v, weight FROM p WHERE weight > 1 UNION ALL SELECT v, u, weight FROM p WHERE weight > 1), n AS (SELECT DISTINCT u FROM {_VISITS}) SELECT n.u AS node, count(v) AS degree, coalesce(sum(weight), 0)::BIGINT AS strength FROM n LEFT JOIN w USING (u) GROUP BY 1")
def gr10_degrees(s, d):
    """Degrees in the projection of users that bought on more than one common day, read from its classes."""
    return factored.factored_projection(visits(s, d)).threshold(1).degrees().select("node", F.col("degree").cast("long").alias("degree"), F.col("strength").cast("long").alias("strength"))


@query(f"WITH p AS {_SEEN}, w AS (SELECT u, v FROM p WHERE weight > 2 UNION ALL SELECT v, u FROM p WHERE weight > 2), a AS (SELECT min(u) AS u FROM {_VISITS}), one AS (SELECT u FROM a UNION SELECT v FROM w WHERE u IN (SELECT u FROM a)) SELECT u AS node FROM one UNION SELECT v FROM w WHERE u IN (SELECT u FROM one)")
def gr10_within(s, d):
    """Users within two links of the first one, by steps between classes."""
    e = visits(s, d)
    return factored.factored_projection(e).threshold(2).within(e.agg(F.min("from").alias("node")), 2)


@query(
    f"WITH RECURSIVE {CHARS.replace('> 0.8', '> 0.9')}, u AS (SELECT a, b FROM cand UNION ALL SELECT b, a FROM cand), r(node, label) AS (SELECT a, a FROM u UNION SELECT u.b, r.label FROM r JOIN u ON u.a = r.node) SELECT node, min(label) AS component FROM r GROUP BY 1"
)
def gr11_components(s, d):
    """Names that are linked by alike characters, directly or over others."""
    pairs = similarity.candidate_pairs(names(s, d), "id", "name", 0.9)
    return graphs.connected_components(pairs.select(F.col("a").alias("from"), F.col("b").alias("to")))


@query()
def gr12_cliques(s, d):
    g = graphs.cosine_graph(table(s, d, "embeddings"), "vec_id", "embedding", "label", 0.3)
    return graphs.maximal_cliques(g.select(F.col("a").alias("from"), F.col("b").alias("to")), 3)


@query()
def gr13_connectivity(s, d):
    g = stored(graphs.cosine_graph(table(s, d, "embeddings"), "vec_id", "embedding", "label", 0.3))
    e = g.select(F.col("a").alias("from"), F.col("b").alias("to"))
    return graphs.connectivity(e, g.select("a", "b"))


def _clusters(s, d):
    return table(s, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("k"), F.floor(F.col("n_nationkey") / 3).cast("string")).alias("cluster"))


_CANON = (
    f"g AS (SELECT node, count(*) AS n FROM (SELECT \"from\" AS node FROM {TRADE_SQL} UNION ALL SELECT \"to\" FROM {TRADE_SQL}) GROUP BY 1), c AS (SELECT 'N' || n_nationkey AS node, 'k' || (n_nationkey // 3) AS cluster FROM nation), "
    "m AS (SELECT c.cluster, c.node, first_value(c.node) OVER (PARTITION BY cluster ORDER BY coalesce(n, 0) DESC, c.node) AS canonical, count(*) OVER (PARTITION BY cluster) AS size FROM c LEFT JOIN g ON g.node = c.node), k AS (SELECT * FROM m WHERE size > 1)"
)


@query(f"WITH {_CANON} SELECT DISTINCT coalesce(a.canonical, \"from\") AS \"from\", coalesce(b.canonical, \"to\") AS \"to\", \"edgeType\" FROM {TRADE_SQL} LEFT JOIN k a ON a.node = \"from\" LEFT JOIN k b ON b.node = \"to\"")
def gr14_er12_merge(s, d):
    n = nodes(s, d).where("nodeType = 'Nation'")
    return graphs.merge_clusters(n, trade(s, d), _clusters(s, d))[1]


@query(f"WITH {_CANON} SELECT coalesce(k.canonical, 'N' || n_nationkey) AS \"nodeID\", string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation LEFT JOIN k ON k.node = 'N' || n_nationkey GROUP BY 1")
def gr15_consolidate(s, d):
    n = nodes(s, d).where("nodeType = 'Nation'")
    return graphs.consolidate_clusters(n, _clusters(s, d), trade(s, d), ["displayName"]).select("nodeID", F.array_join("displayName", "|").alias("names"))


@query("WITH k AS (SELECT min('P' || p_partkey) OVER (PARTITION BY p_name, p_brand) AS kept, p_partkey FROM part) SELECT DISTINCT 'S' || l_suppkey AS \"from\", kept AS \"to\" FROM lineitem JOIN k ON l_partkey = p_partkey")
def gr16_er14_remap_edges(s, d):
    ids = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    m = dedup.mappings(table(s, d, "part").withColumn("p_partkey", ids("P", "p_partkey")), "p_name", "p_partkey", ("p_brand",))
    return dedup.remap_edges(table(s, d, "lineitem").select(ids("S", "l_suppkey").alias("from"), ids("P", "l_partkey").alias("to")), m)


@query(
    "WITH w AS (SELECT l_quantity AS weight, sum(l_quantity) AS mass FROM lineitem GROUP BY 1), s AS (SELECT weight, sum(mass) OVER (ORDER BY weight) / sum(mass) OVER () AS share FROM w), j AS (SELECT weight, share - lag(share) OVER (ORDER BY weight) AS jump FROM s), m AS (SELECT median(jump) AS m FROM j) "
    "SELECT coalesce(max(weight) FILTER (jump / m > 1.5), max_by(weight, jump)) AS threshold FROM j, m"
)
def gr17_weight_threshold(s, d):
    return weights.weight_threshold(table(s, d, "lineitem").select(F.col("l_quantity").alias("weight")), 1.5)


@query("WITH l AS (SELECT p_brand AS cluster, p_name, count(*) AS n FROM part GROUP BY 1, 2), b AS (SELECT cluster, first(p_name ORDER BY n DESC, length(p_name), p_name) AS label FROM l GROUP BY 1) SELECT p_partkey, label FROM part JOIN b ON cluster = p_brand")
def gr18_replace_labels(s, d):
    from loomgraph.operators.windows import mode_label

    p = table(s, d, "part").select("p_partkey", "p_brand", "p_name")
    return p.drop("p_name").join(mode_label(p, ["p_brand"], "p_name"), "p_brand").select("p_partkey", F.col("p_name").alias("label"))


@query(
    "WITH t AS (SELECT user_id, event_type, avg(value) AS p FROM events GROUP BY 1, 2), r AS (SELECT a.event_type AS a, b.event_type AS b, corr(a.p, b.p) AS r FROM t a JOIN t b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2), k AS (SELECT * FROM r WHERE r > -1) "
    "SELECT a, b, round(r, 6) AS r, round(1 + 3 * (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()), 6) AS weight FROM k"
)
def gr19_topic_graph(s, d):
    t = table(s, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("p"))
    return graphs.top_correlations(t, "user_id", "event_type", "p", -1.0).select("a", "b", F.round("r", 6).alias("r"), F.round("weight", 6).alias("weight"))


@query("WITH RECURSIVE n AS (SELECT 'N' || n_nationkey AS a, 'R' || n_regionkey AS b FROM nation), u AS (SELECT a, b FROM n UNION ALL SELECT b, a FROM n), r(node, k) AS (SELECT 'N3', 0 UNION SELECT u.b, r.k + 1 FROM r JOIN u ON u.a = r.node WHERE r.k < 2) SELECT DISTINCT node FROM r")
def gr20_within_radius(s, d):
    return graphs.within(edges(s, d).where("edgeType = 'Part Of'"), s.createDataFrame([("N3",)], "node string"), 2)


@query(
    "WITH a AS (SELECT l_suppkey AS f, l_partkey AS t, count(*) AS w FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), b AS (SELECT l_suppkey AS f, l_partkey AS t, count(*) AS w FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2) "
    "SELECT coalesce(a.f, b.f) AS \"from\", coalesce(a.t, b.t) AS \"to\", CASE WHEN a.f IS NULL THEN 'srl' ELSE 'ner' END AS type, coalesce(a.w, 0) + coalesce(b.w, 0) AS weight FROM a FULL JOIN b ON a.f = b.f AND a.t = b.t"
)
def gr21_combined(s, d):
    make = lambda flag, kind: table(s, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("from"), F.col("l_partkey").alias("to")).agg(F.count("*").alias("weight")).withColumn("type", F.lit(kind))
    return graphs.combined(make("A", "ner"), make("N", "srl"))


@query(f"SELECT \"from\", \"to\", 'Placed' AS type, 1 AS weight FROM {EDGES_SQL} WHERE \"edgeType\" = 'Placed' UNION ALL SELECT \"from\", \"to\", 'coref', 1 FROM {EDGES_SQL} WHERE \"edgeType\" = 'Part Of'")
def hlp02_union_coref(s, d):
    e = edges(s, d)
    a = e.where("edgeType = 'Placed'").select("from", "to", F.col("edgeType").alias("type"))
    return a.unionByName(e.where("edgeType = 'Part Of'").select("from", "to", F.lit("coref").alias("type"))).withColumn("weight", F.lit(1))


@query(f"SELECT count(*) AS n FROM {NODES_SQL} WHERE \"nodeType\" = 'Customer'")
def hlp05_field_nodes(s, d):
    return nodes(s, d).where("nodeType = 'Customer'").agg(F.count("*").alias("n"))


@query(f"SELECT \"from\" || '-->' || \"to\" AS key, count(*) AS n FROM {TRADE_SQL} GROUP BY 1")
def hlp07_pair_key(s, d):
    return trade(s, d).groupBy(F.concat("from", F.lit("-->"), "to").alias("key")).agg(F.count("*").alias("n"))


@query("SELECT l_partkey, round(1 - q / max(q) OVER (), 6) AS cost FROM (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1)")
def hlp09_path_cost(s, d):
    q = table(s, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return q.join(F.broadcast(q.agg(F.max("q").alias("top")))).select("l_partkey", F.round(1 - F.col("q") / F.col("top"), 6).alias("cost"))
