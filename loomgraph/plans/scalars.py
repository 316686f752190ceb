"""Queries for scalar functions: strings, dates, numbers, arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import tables
from loomgraph.functions import arrays, text
from loomgraph.plans.registry import query, table

_ADDRESS = "(c_name || ', ' || n_name || ', ' || r_name || CASE WHEN c_custkey % 3 = 0 THEN ', 12345' WHEN c_custkey % 3 = 1 THEN ', Russian Federation, ' ELSE '' END)"
_PLACES = f"SELECT c_custkey, {_ADDRESS} AS address FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def addresses(s: SparkSession, d: str) -> DataFrame:
    """Customers with a composed address."""
    n, r = table(s, d, "nation"), table(s, d, "region")
    c = table(s, d, "customer").join(F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey)), F.col("c_nationkey") == F.col("n_nationkey"))
    tail = F.when(F.col("c_custkey") % 3 == 0, ", 12345").when(F.col("c_custkey") % 3 == 1, ", Russian Federation, ").otherwise("")
    return c.select("c_custkey", F.concat("c_name", F.lit(", "), "n_name", F.lit(", "), "r_name", tail).alias("address"))


@query("SELECT doc_id, md5(lower(regexp_replace(regexp_replace(text, '[‐᠆﹣－⁃−]+', '-', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS h FROM documents")
def str01_clean_entity(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(text.clean_entity(F.col("text"))).alias("h"))


@query(
    "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]', '', 'g'), '[!-/:-@\\[-`{-~]', '', 'g'), 'et al', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS h FROM documents"
)
def str02_clean_topic(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(text.clean_topic(F.col("text"))).alias("h"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[.,!?$]', ' ', 'g'), ' +', ' ', 'g'))) AS key FROM documents")
def str03_duplicate_key(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(text.duplicate_key(F.col("text"))).alias("key"))


@query("SELECT p_partkey, regexp_replace(' \t' || p_name || ' \n', '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g') AS name FROM part")
def str04_strip(s, d):
    return table(s, d, "part").select("p_partkey", text.strip(F.concat(F.lit(" \t"), "p_name", F.lit(" \n"))).alias("name"))


@query(
    f"WITH a AS ({_PLACES}), b AS (SELECT c_custkey, coalesce(list_filter(list_transform(string_split(address, ','), lambda x: trim(x)), lambda x: x <> '')[-1], '') AS l FROM a) "
    "SELECT c_custkey, CASE WHEN regexp_full_match(l, '[0-9]+') THEN '' WHEN l = 'Russian Federation' THEN 'Russia' ELSE l END AS country FROM b"
)
def str05_country(s, d):
    return addresses(s, d).select("c_custkey", text.country(F.col("address")).alias("country"))


@query("SELECT s_suppkey, s_name || '-' || s_nationkey AS node_id FROM supplier")
def str06_concat_id(s, d):
    return table(s, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit("-"), F.col("s_nationkey").cast("string")).alias("node_id"))


@query("SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(p_name || ', ' || p_brand), '[^\\p{L}\\p{N}_]+'), lambda x: x <> ''), '|') AS parts FROM part")
def str07_clean_parts(s, d):
    return table(s, d, "part").select("p_partkey", F.array_join(text.clean_parts(F.concat("p_name", F.lit(", "), "p_brand")), "|").alias("parts"))


@query("SELECT item_id, md5(array_to_string(regexp_extract_all(text, '[\\p{L}\\p{N}_'']+'), '|')) AS h, len(regexp_extract_all(text, '[\\p{L}\\p{N}_'']+'))::BIGINT AS n FROM benchmark")
def str08_word_tokens(s, d):
    tokens = text.word_tokens(F.col("text"))
    return table(s, d, "benchmark").select("item_id", F.md5(F.array_join(tokens, "|")).alias("h"), F.size(tokens).cast("long").alias("n"))


@query("SELECT p_partkey, array_to_string(list_transform(list_filter(regexp_split_to_array(p_name || ' ' || p_brand, '[^\\p{L}]+'), lambda x: x <> ''), lambda x: lower(left(x, 1))), '') AS initials FROM part")
def str09_initials(s, d):
    return table(s, d, "part").select("p_partkey", F.array_join(text.initials(F.concat_ws(" ", "p_name", "p_brand")), "").alias("initials"))


@query(
    "WITH c AS (SELECT s_suppkey, regexp_replace(s_name || '.x', '[,-./]', '', 'g') AS s FROM supplier) "
    "SELECT s_suppkey, array_to_string(list_transform(range(1, length(s)), lambda i: s[i:i + 1]), '|') AS grams FROM c"
)
def str10_char_ngrams(s, d):
    return table(s, d, "supplier").select("s_suppkey", F.array_join(text.char_ngrams(F.concat("s_name", F.lit(".x")), 2), "|").alias("grams"))


@query(
    "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(CASE p_partkey % 4 WHEN 0 THEN 'The a ' WHEN 1 THEN 'a the ' WHEN 2 THEN 'These ' ELSE '' END || p_name), '^the ', ''), '^a ', ''), '^our ', ''), '^this ', ''), '^and ', ''), '^these ', '') AS name FROM part"
)
def str11_strip_articles(s, d):
    k = F.col("p_partkey") % 4
    return table(s, d, "part").select("p_partkey", text.strip_articles(F.concat(F.when(k == 0, "The a ").when(k == 1, "a the ").when(k == 2, "These ").otherwise(""), "p_name")).alias("name"))


def name_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct part names that share a word: joined on the word, not on everything."""
    words = table(s, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("word", F.explode(F.split("name", " ")))
    return words.toDF("a", "word").join(words.toDF("b", "word"), "word").where("a < b").select("a", "b").distinct()


_PAIRS = "w AS (SELECT DISTINCT p_name AS n, unnest(string_split(p_name, ' ')) AS w FROM part), p AS (SELECT DISTINCT a.n AS a, b.n AS b FROM w a JOIN w b ON a.w = b.w AND a.n < b.n)"
#: Longest common subsequences of the pairs in q, a row of the table a step.
_LCS = (
    "r AS (SELECT a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda k: 0) AS row FROM q UNION ALL "
    "SELECT a, b, i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [CASE WHEN a[i + 1] = b[j] THEN row[j] + 1 ELSE row[j + 1] END]), lambda acc, x: list_append(acc, greatest(acc[len(acc)], x[1])), [0]) FROM r WHERE i < len(a)), "
    "l AS (SELECT a, b, 2.0 * row[len(row)] / (len(a) + len(b)) AS ratio FROM r WHERE i = len(a))"
)


@query(f"WITH RECURSIVE {_PAIRS}, q AS (SELECT a, b FROM p), {_LCS} SELECT a, b, round(ratio, 6) AS ratio FROM l")
def str12_edit_ratio(s, d):
    return name_pairs(s, d).select("a", "b", F.round(text.edit_ratio("a", "b"), 6).alias("ratio"))


@query(
    f"WITH RECURSIVE {_PAIRS}, q AS (SELECT DISTINCT x.w AS a, y.w AS b FROM w x, w y), {_LCS}, s AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM p), "
    "m AS (SELECT s.a, s.b, (l1.ratio + l2.ratio) / 2 AS straight, (l3.ratio + l4.ratio) / 2 AS crossed FROM s JOIN l l1 ON l1.a = x[1] AND l1.b = y[1] JOIN l l2 ON l2.a = x[2] AND l2.b = y[2] JOIN l l3 ON l3.a = x[1] AND l3.b = y[2] JOIN l l4 ON l4.a = x[2] AND l4.b = y[1]) "
    "SELECT a, b, round(greatest(straight, crossed), 6) AS similarity FROM m"
)
def str13_parts_similarity(s, d):
    return name_pairs(s, d).select("a", "b", F.round(text.parts_similarity("a", "b"), 6).alias("similarity"))


@query(
    f"WITH {_PAIRS}, s AS (SELECT a, b, list_transform(string_split(a, ' '), lambda z: z[1]) AS x, list_transform(string_split(b, ' '), lambda z: z[1]) AS y, list_transform(range(97, 123), lambda c: chr(c::INT)) AS abc FROM p), "
    "c AS (SELECT *, list_sum(list_transform(abc, lambda c: least(len(list_filter(x, lambda z: z = c)), len(list_filter(y, lambda z: z = c))))) AS common, list_sum(list_transform(abc, lambda c: greatest(len(list_filter(x, lambda z: z = c)), len(list_filter(y, lambda z: z = c))))) AS every FROM s) "
    "SELECT a, b, round((common - least(every - len(x), every - len(y))) / least(len(x), len(y)) - 2 + CASE WHEN x = y THEN 1 WHEN list_filter(x, lambda z: list_contains(y, z)) = list_filter(y, lambda z: list_contains(x, z)) THEN 0.5 ELSE 0 END, 6) AS score FROM c"
)
def str14_initials_similarity(s, d):
    return name_pairs(s, d).select("a", "b", F.round(text.initials_similarity(text.initials(F.col("a")), text.initials(F.col("b"))), 6).alias("score"))


@query("SELECT doc_id, CASE WHEN length(l) > 30 THEN left(l, 30) || '..' ELSE l END AS label FROM (SELECT doc_id, replace(coalesce(source || ':' || left(text, 40), ''), ':', ' - ') AS l FROM documents)")
def str15_label(s, d):
    return table(s, d, "documents").select("doc_id", text.label(F.concat("source", F.lit(":"), F.substring("text", 1, 40))).alias("label"))


_TAGS = "CASE event_type WHEN 'view' THEN 'O' WHEN 'click' THEN 'B-PER' WHEN 'purchase' THEN 'I-PER' WHEN 'signup' THEN 'L-PER' ELSE 'U-LOC' END"


@query(f"SELECT event_id, regexp_replace({_TAGS}, '^[BILU]-', '') AS type FROM events")
def str16_tag_type(s, d):
    return table(s, d, "events").select("event_id", text.tag_type(F.expr(_TAGS)).alias("type"))


@query("SELECT conv_id, turn, regexp_replace(role || '_' || conv_id || '_' || turn, '_[^_]*$', '') AS parent FROM conversations")
def str17_parent_id(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", text.parent_id(F.concat_ws("_", "role", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("parent"))


@query(
    "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)(the)', '<span style=\"color:red\">\\1</span>', 'g'), '(?i)(que)', '<span style=\"color:red\">\\1</span>', 'g')) AS h FROM documents"
)
def str18_highlight(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(text.highlight(F.col("text"), ["the", "que"])).alias("h"))


@query("SELECT doc_id, md5(replace(text, 'the', chr(27) || '[7mthe' || chr(27) || '[0m')) AS h FROM documents")
def str19_inverse(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(text.inverse(F.col("text"), "the")).alias("h"))


@query("SELECT p_partkey, replace(left(p_name, 3) || ' ##' || substr(p_name, 4) || ' x', ' ##', '') AS word FROM part")
def str20_join_pieces(s, d):
    return table(s, d, "part").select("p_partkey", text.join_pieces(F.array(F.substring("p_name", 1, 3), F.concat(F.lit("##"), F.expr("substring(p_name, 4)")), F.lit("x"))).alias("word"))


@query("SELECT conv_id, turn, md5(text) AS h FROM conversations")
def str21_without_markers(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(text.without_markers(F.concat(F.lit("[BOS]"), "text", F.lit("[EOS]")))).alias("h"))


@query(
    "SELECT l_orderkey, l_linenumber, 'ARG0' AS role, 'supplier ' || l_suppkey AS words FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'V', 'ships' FROM lineitem "
    "UNION ALL SELECT l_orderkey, l_linenumber, 'ARG1', 'part ' || l_partkey FROM lineitem"
)
def str22_role_spans(s, d):
    desc = F.concat(F.lit("[ARG0: supplier "), F.col("l_suppkey").cast("string"), F.lit("] [V: ships] [ARG1: part "), F.col("l_partkey").cast("string"), F.lit("]"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.inline(text.role_spans(desc)))


@query("SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', '') || '.html', '([^/]+?)(\\.[^./]*)?$', 1) AS stem, starts_with(url, 'https') AS secure FROM pages")
def str23_file_stem(s, d):
    return table(s, d, "pages").select("page_id", text.file_stem(F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit(".html"))).alias("stem"), F.col("url").startswith("https").alias("secure"))


@query("SELECT c_mktsegment AS segment, format('{:,}', count(*)) AS n, round(100.0 * count(*) / (SELECT count(*) FROM customer), 2)::DOUBLE AS percent FROM customer GROUP BY 1")
def str24_formats(s, d):
    c = table(s, d, "customer")
    total = c.agg(F.count("*").alias("total"))
    return c.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("k")).join(F.broadcast(total)).select("segment", F.format_number("k", 0).alias("n"), F.round(100.0 * F.col("k") / F.col("total"), 2).alias("percent"))


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, month(ts)::INT AS month, year(ts)::INT AS year FROM events")
def dt01_dt02_epoch_month(s, d):
    e = table(s, d, "events").withColumn("seconds", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    when = F.expr("timestampadd(SECOND, seconds, timestamp_ntz'1970-01-01 00:00:00')")
    return e.select("event_id", "seconds", F.month(when).alias("month"), F.year(when).alias("year"))


_E64 = "list_transform(embedding, lambda x: x::DOUBLE)"


@query(f"WITH v AS (SELECT vec_id, {_E64} AS e FROM embeddings), x AS (SELECT vec_id, list_transform(e, lambda y: exp(y - list_max(e))) AS e FROM v) SELECT vec_id, round(list_max(e) / list_sum(e), 6) AS confidence FROM x")
def mt01_softmax(s, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(s, d, "embeddings").select("vec_id", F.round(F.array_max(arrays.softmax(e)), 6).alias("confidence"))


@query(f"SELECT a.vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def mt02_row_cosine(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return e.join(b, "vec_id").select("vec_id", F.round(arrays.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query(
    f"WITH v AS (SELECT vec_id, {_E64} AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v) "
    "SELECT a.vec_id, round(exp(-2 * pow(list_distance(a.e, b.e), 2)), 6) AS affinity FROM u a JOIN u b ON b.vec_id = a.vec_id + 1"
)
def mt03_unit_distance(s, d):
    e = table(s, d, "embeddings").select("vec_id", arrays.unit(F.transform("embedding", lambda x: x.cast("double"))).alias("x"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return e.join(b, "vec_id").select("vec_id", F.round(F.exp(-2 * arrays.squared_distance(F.col("x"), F.col("y"))), 6).alias("affinity"))


@query("SELECT event_id, round(exp(-value / 100), 6) AS p, round(pow(1 - value / 1000, 4), 6) AS q, ceil(value / 10)::BIGINT AS chunk FROM events")
def mt04_mt05_mt06_arithmetic(s, d):
    v = F.col("value")
    return table(s, d, "events").select("event_id", F.round(F.exp(-v / 100), 6).alias("p"), F.round(F.pow(1 - v / 1000, F.lit(4)), 6).alias("q"), F.ceil(v / 10).alias("chunk"))


@query(f"WITH v AS (SELECT label, unnest({_E64}) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, round(sum(m * m), 6) AS squares FROM (SELECT label, i, avg(x) AS m FROM v GROUP BY 1, 2) GROUP BY 1")
def mt07_mean_pooling(s, d):
    """Element-wise means per label."""
    means = tables.mean_vectors(table(s, d, "embeddings"), "label", "embedding")
    return means.groupBy("label").agg(F.round(F.sum(F.col("mean") * F.col("mean")), 6).alias("squares"))



@query("SELECT o_orderkey, [o_orderpriority][1] AS first, 1 AS n FROM orders")
def arr01_listify(s, d):
    a = F.array("o_orderpriority")
    return table(s, d, "orders").select("o_orderkey", F.element_at(a, 1).alias("first"), F.size(a).alias("n"))


@query("SELECT p_partkey, unnest(CASE WHEN p_partkey % 5 = 0 THEN [NULL] ELSE string_split(p_name, ' ') END) AS word FROM part")
def arr02_explode_outer(s, d):
    words = F.when(F.col("p_partkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.split("p_name", " "))
    return table(s, d, "part").select("p_partkey", F.explode_outer(words).alias("word"))


@query(
    "WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, CASE WHEN p_partkey % 2 = 0 THEN string_split(p_type, ' ') ELSE [] END AS b FROM part) "
    "SELECT p_partkey, coalesce(a[i], '') AS word, coalesce(b[i], '') AS type FROM (SELECT *, unnest(range(1, greatest(len(a), len(b)) + 1)) AS i FROM p)"
)
def arr03_aligned_explode(s, d):
    p = table(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("word"), F.when(F.col("p_partkey") % 2 == 0, F.split("p_type", " ")).otherwise(F.array().cast("array<string>")).alias("type"))
    return tables.aligned_explode(p, ["word", "type"])



@query(
    "WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark), f AS (SELECT item_id, w, min(i) AS i FROM w GROUP BY 1, 2) "
    "SELECT item_id, md5(string_agg(w, ' ' ORDER BY i)) AS h, count(*) AS n FROM f GROUP BY 1"
)
def arr04_ordered_distinct(s, d):
    w = arrays.distinct_in_order(F.split("text", " "))
    return table(s, d, "benchmark").select("item_id", F.md5(F.array_join(w, " ")).alias("h"), F.size(w).cast("long").alias("n"))


@query("SELECT doc_id, len(w)::BIGINT AS n, w[1] AS first, array_to_string(w[2:4], ' ') AS part FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def arr05_size_first_slice(s, d):
    w = F.split("text", " ")
    return table(s, d, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.element_at(w, 1).alias("first"), F.array_join(F.slice(w, 2, 3), " ").alias("part"))


@query("SELECT item_id, contains(' ' || text || ' ', ' of the ') AS found FROM benchmark")
def arr06_contains_run(s, d):
    return table(s, d, "benchmark").select("item_id", arrays.contains_run(F.array(F.lit("of"), F.lit("the")), F.split("text", " ")).alias("found"))


@query("SELECT user_id, bool_and(p IS NULL OR value > p) AS rising FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 3 GROUP BY 1")
def arr07_increasing(s, d):
    from pyspark.sql import Window

    e = table(s, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("k <= 3")
    a = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("a"))
    return a.select("user_id", arrays.increasing(F.col("a")).alias("rising"))


@query("SELECT item_id, md5(array_to_string(list_filter(string_split(text, ' '), lambda x: length(x) > 3), ' ')) AS h FROM benchmark")
def arr09_compress(s, d):
    w = F.split("text", " ")
    return table(s, d, "benchmark").select("item_id", F.md5(F.array_join(arrays.compress(w, F.transform(w, lambda x: F.length(x) > 3)), " ")).alias("h"))


@query("SELECT item_id, md5(array_to_string(list_resize(w[1:40], 40, '[PAD]'), ' ')) AS h, list_sum(list_resize(list_transform(w[1:40], lambda x: 1), 40, 0))::BIGINT AS mask FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)")
def arr10_pad(s, d):
    w = F.split("text", " ")
    mask = arrays.padded(F.transform(w, lambda x: F.lit(1)), 40, 0)
    return table(s, d, "benchmark").select("item_id", F.md5(F.array_join(arrays.padded(w, 40, "[PAD]"), " ")).alias("h"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("long").alias("mask"))


@query("SELECT DISTINCT unnest([p_brand, p_type]) AS value FROM part")
def arr11_flatten_unique(s, d):
    return table(s, d, "part").select(F.explode(F.array("p_brand", "p_type")).alias("value")).distinct()


@query("SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x: list_contains(string_split(p_type || ' ring', ' '), x)) = list_filter(string_split(p_type || ' ring', ' '), lambda x: list_contains(string_split(p_name, ' '), x)) AS same FROM part")
def arr12_common_subsequence(s, d):
    return table(s, d, "part").select("p_partkey", tables.same_common_order(F.split("p_name", " "), F.split(F.concat("p_type", F.lit(" ring")), " ")).alias("same"))



@query("SELECT o_orderkey, 'status' AS key, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders")
def map01_explode_map(s, d):
    return table(s, d, "orders").select("o_orderkey", F.explode(F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")))


@query("SELECT l_orderkey, string_agg(l_linenumber || '=' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS tags FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def map02_tags_by_number(s, d):
    m = tables.map_by_number(table(s, d, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag")
    return m.select("l_orderkey", F.array_join(F.transform(F.map_entries("tags"), lambda x: F.concat(x["key"].cast("string"), F.lit("="), x["value"])), ",").alias("tags"))



@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' WHEN 'error' THEN 'x' ELSE event_type END AS code FROM events")
def map03_merge_lookup(s, d):
    m = F.map_concat(F.create_map(F.lit("click"), F.lit("c"), F.lit("view"), F.lit("v")), F.create_map(F.lit("error"), F.lit("x")))
    return table(s, d, "events").select("event_id", F.coalesce(F.try_element_at(m, F.col("event_type")), "event_type").alias("code"))


@query("SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def map04_count_map(s, d):
    c = table(s, d, "events").groupBy("user_id", "event_type").count()
    m = c.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "count")))).alias("m"))
    return m.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",").alias("counts"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def jsn01_flatten(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", "p.k")


@query("SELECT n_nationkey, '{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS record FROM nation")
def jsn02_records(s, d):
    return table(s, d, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("record"))


@query("SELECT c_custkey, unnest([n_name, 'x' || n_name]) AS org, unnest([1, 2]) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey")
def jsn03_dynamic_keys(s, d):
    """Dynamic ``org_k`` fields, one row a field."""
    n = table(s, d, "nation")
    raw = F.to_json(F.create_map(F.lit("org_1"), "n_name", F.lit("org_2"), F.concat(F.lit("x"), "n_name")))
    j = table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", raw.alias("raw"))
    return tables.numbered_fields(j, "raw", "org_", "org")


