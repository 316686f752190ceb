"""Queries for entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.scratch import stored
from loomgraph.operators import resolve, similarity
from loomgraph.plans.registry import query, table


def names(s, d):
    """Distinct part names, as nodes."""
    return table(s, d, "part").select(F.col("p_name").alias("id")).distinct().withColumn("name", F.col("id"))


CHARS = (
    "n AS (SELECT DISTINCT p_name AS k FROM part), t AS (SELECT k, c AS term, count(*)::DOUBLE AS tf FROM (SELECT k, unnest(string_split(regexp_replace(lower(k), '[,-./]', '', 'g'), '')) AS c FROM n) GROUP BY 1, 2), "
    "i AS (SELECT term, ln((1.0 + (SELECT count(*) FROM n)) / (1.0 + count(*))) + 1 AS idf FROM t GROUP BY 1 HAVING count(*) >= 0.005 * (SELECT count(*) FROM n)), cw AS (SELECT k, term, tf * idf AS w FROM t JOIN i USING (term)), cu AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM cw), "
    "p AS (SELECT a.k AS a, b.k AS b, sum(a.w * b.w) AS similarity FROM cu a JOIN cu b ON a.term = b.term AND a.k < b.k GROUP BY 1, 2), cand AS (SELECT * FROM p WHERE similarity > 0.8)"
)


@query(f"WITH {CHARS} SELECT a, b, round(similarity, 6) AS similarity FROM cand")
def er02_jn13_candidates(s, d):
    return similarity.candidate_pairs(names(s, d), "id", "name", 0.8).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    f"WITH {CHARS}, used AS (SELECT a AS k FROM cand UNION SELECT b FROM cand), wt AS (SELECT k, term, count(*)::DOUBLE AS tf FROM (SELECT k, unnest(regexp_extract_all(lower(k), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1)) AS term FROM used) GROUP BY 1, 2), "
    "wi AS (SELECT term, ln((1.0 + (SELECT count(DISTINCT k) FROM wt)) / (1.0 + count(*))) + 1 AS idf FROM wt GROUP BY 1), ww AS (SELECT k, term, tf * idf AS w FROM wt JOIN wi USING (term)), wu AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM ww), "
    "x AS (SELECT c.a, c.b, sum(p.w * q.w) AS s FROM cand c JOIN wu p ON p.k = c.a JOIN wu q ON q.k = c.b AND q.term = p.term GROUP BY 1, 2) SELECT c.a, c.b, round(coalesce(s, 0), 6) AS tfidf FROM cand c LEFT JOIN x ON x.a = c.a AND x.b = c.b"
)
def er03_word_similarity(s, d):
    n = names(s, d)
    pairs = stored(similarity.candidate_pairs(n, "id", "name", 0.8))
    return similarity.word_similarity(pairs, n, "id", "name").select("a", "b", F.round("tfidf", 6).alias("tfidf"))


@query()
def agg21_name_likelihood(s, d):
    return similarity.part_likelihood(names(s, d), "id", "name").select("key", F.round("likelihood", 6).alias("likelihood"))


@query("WITH RECURSIVE n AS (SELECT DISTINCT p_name AS x FROM part), p AS (SELECT a.x AS a, b.x AS b FROM n a JOIN n b ON a.x < b.x), "
       "r AS (SELECT a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda k: 0) AS row FROM p UNION ALL "
       "SELECT a, b, i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [CASE WHEN a[i + 1] = b[j] THEN row[j] + 1 ELSE row[j + 1] END]), lambda acc, x: list_append(acc, greatest(acc[len(acc)], x[1])), [0]) FROM r WHERE i < len(a)) "
       "SELECT a, b, round(2.0 * row[len(row)] / (len(a) + len(b)), 6) AS ratio FROM r WHERE i = len(a) AND 2.0 * row[len(row)] / (len(a) + len(b)) > 0.5")
def er04_pairwise_edit_ratio(s, d):
    return similarity.pairwise_edit_ratio(names(s, d), "id", "name", 0.5).select("a", "b", F.round("ratio", 6).alias("ratio"))


def resolver(s, d, kind="Scientist", **how):
    """Part names as nodes of a type; brands are their papers, sizes their institutions, and types places."""
    n = names(s, d).select(F.col("id").alias("nodeID"), F.col("name").alias("displayName"), F.lit(kind).alias("nodeType"))
    p = table(s, d, "part")
    made = []
    for column, edge_type, source, target in (("p_brand", "Author Of", "Scientist", "Paper"), ("p_size", "Belongs To", "Scientist", "Institution"), ("p_type", "Located At", "Institution", "Location")):
        ends = ("p_name", column) if kind == source else (column, "p_name")
        made.append(p.select(*(F.col(c).cast("string").alias(x) for c, x in zip(ends, ("from", "to"))), F.lit(edge_type).alias("edgeType"), F.lit(source).alias("fromNodeType"), F.lit(target).alias("toNodeType")))
    e = made[0].unionAll(made[1]).unionAll(made[2]).distinct()
    return resolve.Resolver(n, e, kind, **how)


def scores(s, d, **how):
    return stored(resolver(s, d, **how).scores())


@query()
def er05_er06_text_scores(s, d):
    first = names(s, d).agg(F.min("id").alias("from")).join(names(s, d).agg(F.max("id").alias("to")))
    t = resolver(s, d, blacklist=first).text_scores()
    return t.select("from", "to", *[F.round(c, 6).alias(c) for c in ("tfidf", "lev", "parts", "initials", "likelihood", "text")], "blacklist")


_SIDE = "e AS (SELECT DISTINCT p_name AS f, {c}::VARCHAR AS t FROM part), w AS (SELECT a.f AS u, b.f AS v, count(*)::DOUBLE AS weight FROM e a JOIN e b ON a.t = b.t AND a.f <> b.f GROUP BY 1, 2)"


@query(
    f"WITH {CHARS}, " + _SIDE.format(c="p_type") + ", g AS (SELECT DISTINCT p_name AS f, p_size::VARCHAR AS t FROM part), h AS (SELECT a.f AS u, b.f AS v, count(*)::DOUBLE AS weight FROM g a JOIN g b ON a.t = b.t AND a.f <> b.f GROUP BY 1, 2), "
    "x AS (SELECT a, b, coalesce(w.weight, 0) AS p, coalesce(h.weight, 0) AS q FROM cand LEFT JOIN w ON w.u = a AND w.v = b LEFT JOIN h ON h.u = a AND h.v = b), r AS (SELECT a, b, CASE WHEN p > 0 AND max(p) OVER () > min(p) OVER () THEN cume_dist() OVER (PARTITION BY p > 0 ORDER BY p) ELSE 0 END AS rp, "
    "CASE WHEN q > 0 AND max(q) OVER () > min(q) OVER () THEN cume_dist() OVER (PARTITION BY q > 0 ORDER BY q) ELSE 0 END AS rq FROM x) SELECT a AS \"from\", b AS \"to\", round(rp + rq, 6) AS graph FROM r"
)
def er08_graph_scores(s, d):
    """Institutions by their default graphs: shared places and shared staff."""
    r = resolver(s, d, "Institution")
    return r.graph_scores(r.candidates()).select("from", "to", F.round("graph", 6).alias("graph"))


@query(
    f"WITH {CHARS}, " + _SIDE.format(c="p_brand") + ", x AS (SELECT a, b, (SELECT sum(l.weight + r.weight) FROM w l JOIN w r ON l.v = r.v WHERE l.u = a AND r.u = b AND NOT EXISTS (SELECT 1 FROM w WHERE u = a AND v = b)) AS far FROM cand), "
    "g AS (SELECT DISTINCT p_name AS f, p_size::VARCHAR AS t FROM part), h AS (SELECT a.f AS u, b.f AS v, count(*)::DOUBLE AS weight FROM g a JOIN g b ON a.t = b.t AND a.f <> b.f GROUP BY 1, 2), y AS (SELECT x.a, x.b, coalesce(far, 0) AS p, coalesce(h.weight, 0) AS q FROM x LEFT JOIN h ON h.u = a AND h.v = b), "
    "r AS (SELECT a, b, CASE WHEN p > 0 AND max(p) OVER () > min(p) OVER () THEN cume_dist() OVER (PARTITION BY p > 0 ORDER BY p) ELSE 0 END AS rp, CASE WHEN q > 0 AND max(q) OVER () > min(q) OVER () THEN cume_dist() OVER (PARTITION BY q > 0 ORDER BY q) ELSE 0 END AS rq FROM y) SELECT a AS \"from\", b AS \"to\", round(rp + rq, 6) AS graph FROM r"
)
def er08_scientist_graph_scores(s, d):
    """Scientists by their default graphs: co-authors at two steps, colleagues at one."""
    r = resolver(s, d)
    return r.graph_scores(r.candidates()).select("from", "to", F.round("graph", 6).alias("graph"))


_RATIO = (
    "lcs AS (SELECT a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda k: 0) AS row FROM cand UNION ALL "
    "SELECT a, b, i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [CASE WHEN a[i + 1] = b[j] THEN row[j] + 1 ELSE row[j + 1] END]), lambda acc, x: list_append(acc, greatest(acc[len(acc)], x[1])), [0]) FROM lcs WHERE i < len(a)), "
    "lev AS (SELECT a, b, 2.0 * row[len(row)] / (len(a) + len(b)) AS lev FROM lcs WHERE i = len(a))"
)
_WORDS = (
    "used AS (SELECT a AS k FROM cand UNION SELECT b FROM cand), wt AS (SELECT k, term, count(*)::DOUBLE AS tf FROM (SELECT k, unnest(regexp_extract_all(lower(k), '([\\p{L}\\p{N}_]{2,})', 1)) AS term FROM used) GROUP BY 1, 2), "
    "wi AS (SELECT term, ln((1.0 + (SELECT count(DISTINCT k) FROM wt)) / (1.0 + count(*))) + 1 AS idf FROM wt GROUP BY 1), ww AS (SELECT k, term, tf * idf AS w FROM wt JOIN wi USING (term)), wu AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM ww), "
    "tf AS (SELECT c.a, c.b, sum(p.w * q.w) AS tfidf FROM cand c JOIN wu p ON p.k = c.a JOIN wu q ON q.k = c.b AND q.term = p.term GROUP BY 1, 2)"
)


@query(
    f"WITH RECURSIVE {CHARS}, {_RATIO}, {_WORDS}, " + _SIDE.format(c="p_type") + ", g AS (SELECT DISTINCT p_name AS f, p_size::VARCHAR AS t FROM part), h AS (SELECT a.f AS u, b.f AS v, count(*)::DOUBLE AS weight FROM g a JOIN g b ON a.t = b.t AND a.f <> b.f GROUP BY 1, 2), "
    "x AS (SELECT a, b, coalesce(w.weight, 0) AS p, coalesce(h.weight, 0) AS q FROM cand LEFT JOIN w ON w.u = a AND w.v = b LEFT JOIN h ON h.u = a AND h.v = b), r AS (SELECT a, b, CASE WHEN p > 0 AND max(p) OVER () > min(p) OVER () THEN cume_dist() OVER (PARTITION BY p > 0 ORDER BY p) ELSE 0 END + "
    "CASE WHEN q > 0 AND max(q) OVER () > min(q) OVER () THEN cume_dist() OVER (PARTITION BY q > 0 ORDER BY q) ELSE 0 END AS graph FROM x), tx AS (SELECT a, b, coalesce(tfidf, 0) + lev AS text FROM lev LEFT JOIN tf USING (a, b)) "
    "SELECT a AS \"from\", b AS \"to\", round(text, 6) AS text, round(graph, 6) AS graph FROM tx JOIN r USING (a, b) WHERE text > 1 AND graph > 0"
)
def er07_er17_resolved(s, d):
    """Institutions above their default limits."""
    return resolver(s, d, "Institution").resolved().select("from", "to", F.round("text", 6).alias("text"), F.round("graph", 6).alias("graph"))


@query()
def er09_communities(s, d):
    return resolver(s, d, "Institution").communities(scores(s, d, kind="Institution"), "total", 1.0)


@query("SELECT p_brand AS cluster, count(DISTINCT p_name) AS nodes FROM part GROUP BY 1 HAVING count(DISTINCT p_name) > 1")
def er10_impact(s, d):
    clusters = table(s, d, "part").select(F.col("p_name").alias("node"), F.col("p_brand").alias("cluster")).distinct()
    return resolver(s, d).impact(clusters).select("cluster", "nodes")


@query("WITH p AS (SELECT 'N' || a.n_nationkey AS f, 'N' || b.n_nationkey AS t FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey WHERE a.n_regionkey = 1 UNION ALL SELECT 'x', 'y' UNION ALL SELECT 'y', 'x') SELECT DISTINCT f AS \"from\", t AS \"to\" FROM p")
def er11_blacklist(s, d):
    clusters = table(s, d, "nation").select(F.col("n_regionkey").alias("cluster"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node"))
    known = s.createDataFrame([("x", "y")], "`from` string, `to` string")
    return resolve.cluster_to_blacklist(known, clusters, s.createDataFrame([(1,)], "cluster int"))


@query("WITH n AS (SELECT count(DISTINCT p_name) AS n FROM part), c AS (SELECT unnest(range(0, ((SELECT n FROM n) + 19) // 20)) AS chunk) SELECT 1 AS iteration, chunk, least(20, n - 20 * chunk) AS nodes FROM c, n")
def er15_chunks(s, d):
    n = names(s, d).select(F.col("id").alias("nodeID"))
    c = resolve.iterate(n, 20, 1)
    return c.groupBy("iteration", "chunk").agg(F.count("*").alias("nodes"))


def chunked_run(s, d, iterations):
    """All chunks of some iterations over the part names; candidates with equal last words are accepted and the rest rejected."""
    r = resolver(s, d, "Institution")
    m = resolve.Merging(r.nodes, r.edges, "Institution", size=40, threshold=0.8, constraints={"text": 1.0})
    last = lambda c: F.element_at(F.split(c, " "), -1)
    merged = m.run(lambda p: p.select("from", "to", (last("from") == last("to")).alias("accepted")), iterations)
    return m, merged


@query()
def er15_history(s, d):
    """The history of an iteration in chunks of 40, with the nodes and edges that each chunk began with."""
    return chunked_run(s, d, 1)[0].history.select("iteration", "chunk", "metric", "n_nodes", "n_edges", "merged")


@query()
def er15_merged(s, d):
    """Where each merged name went over two iterations in chunks of 40."""
    return chunked_run(s, d, 2)[1]


@query("SELECT 'N' || n_nationkey AS node, min('N' || n_nationkey) OVER (PARTITION BY n_regionkey) AS cluster FROM nation")
def er18_accepted_clusters(s, d):
    n = table(s, d, "nation").select("n_regionkey", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node"))
    hub = n.groupBy("n_regionkey").agg(F.min("node").alias("hub"))
    return resolve.accepted_clusters(n.join(hub, "n_regionkey").where("node <> hub").select(F.col("node").alias("from"), F.col("hub").alias("to"), F.lit(True).alias("accepted")))


@query()
def er13_match_probability(s, d):
    """Candidate pairs of part names with the probability that they are one, from a matcher fitted on misspelt supplier, part and nation names."""
    known = names(s, d).select("name").unionAll(table(s, d, "supplier").select("s_name")).unionAll(table(s, d, "nation").select("n_name"))
    matcher = similarity.fit_matcher(similarity.misspelt_pairs(known, "name"))
    r = resolver(s, d, "Institution", predict=matcher)
    return r.text_scores().select("from", "to", F.round("predict", 6).alias("predict"))
