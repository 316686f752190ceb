"""Queries for sentence, token, topic and representation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.scratch import stored
from loomgraph.operators import nlp, representation, tables, topics
from loomgraph.plans.registry import query, table
from loomgraph.plans.relational import _roundtrip
from loomgraph.sources import writers

_SENT = (
    "x AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)) AS a FROM documents), y AS (SELECT doc_id, unnest(a) AS s, generate_subscripts(a, 1) AS i FROM x), "
    "z AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM y WHERE length(trim(s)) > 0 AND len(list_filter(string_split(s, ' '), lambda w: regexp_matches(w, '[a-zA-Z]'))) BETWEEN 3 AND 349)"
)


@query(f"WITH {_SENT} SELECT doc_id || '_' || k AS sentence_id, md5(s) AS h FROM z")
def nlp01_nlp02_sentences(s, d):
    return nlp.sentence_table(table(s, d, "documents"), "doc_id", "text").select("sentence_id", F.md5("sentence").alias("h"))


@query(f"WITH {_SENT} SELECT doc_id, md5(string_agg(s, ' ' ORDER BY k)) AS h FROM z GROUP BY 1")
def nlp02_documents(s, d):
    return nlp.documents_of(nlp.sentence_table(table(s, d, "documents"), "doc_id", "text")).select("doc_id", F.md5("document").alias("h"))


def tagged(s, d):
    """All events of a user, in order of time, as words with BILOU tags of two types, logits, and places in the table."""
    kind = F.when(F.col("event_id") % 3 == 0, "LOC").otherwise("PER")
    mark = F.expr("CASE event_type WHEN 'click' THEN 'B-' WHEN 'purchase' THEN 'I-' WHEN 'signup' THEN 'L-' WHEN 'error' THEN 'U-' END")
    tag = F.coalesce(F.concat(mark, kind), F.lit("O"))
    fields = F.struct("ts", "event_id", F.col("event_type").alias("w"), tag.alias("t"), F.array(F.col("value") / 10, F.lit(1.0), F.lit(0.5)).alias("l"))
    g = table(s, d, "events").select("user_id", fields.alias("x")).groupBy("user_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    of = lambda name: F.transform("x", lambda v: v[name])
    return g.select("user_id", of("w").alias("words"), of("t").alias("tags"), of("l").alias("logits"), of("event_id").alias("ids"))


_EVENTS = (
    "e AS (SELECT user_id, event_id, event_type AS w, CASE event_type WHEN 'click' THEN 'B' WHEN 'purchase' THEN 'I' WHEN 'signup' THEN 'L' WHEN 'error' THEN 'U' ELSE 'O' END AS mark, "
    "CASE WHEN event_type = 'view' THEN 'O' WHEN event_id % 3 = 0 THEN 'LOC' ELSE 'PER' END AS kind, 1 / (exp(value / 10 - greatest(value / 10, 1)) + exp(1 - greatest(value / 10, 1)) + exp(0.5 - greatest(value / 10, 1))) AS sure, "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"
)


@query(
    f"WITH RECURSIVE {_EVENTS}, r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, []::BIGINT[] AS run, '' AS open, []::BIGINT[][] AS outs FROM e UNION ALL SELECT r.user_id, e.i, "
    "CASE WHEN mark = 'B' THEN [e.i] WHEN mark = 'I' AND len(run) > 0 AND open = kind THEN list_append(run, e.i) WHEN mark = 'I' THEN run WHEN mark = 'L' AND len(run) = 1 AND open <> kind THEN run ELSE [] END, CASE WHEN mark = 'B' THEN kind ELSE open END, "
    "CASE WHEN mark = 'I' THEN [] WHEN mark = 'B' THEN CASE WHEN len(run) > 0 THEN [run] ELSE [] END WHEN len(run) = 0 THEN [[e.i]] WHEN mark = 'L' AND open = kind THEN [list_append(run, e.i)] WHEN mark = 'L' AND len(run) = 1 THEN [[e.i]] ELSE [run, [e.i]] END "
    "FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1), o AS (SELECT user_id, i, unnest(outs) AS places, generate_subscripts(outs, 1) AS k FROM r), n AS (SELECT user_id, places, row_number() OVER (PARTITION BY user_id ORDER BY i, k) AS n FROM o), "
    "p AS (SELECT user_id, n, unnest(places) AS i FROM n), t AS (SELECT user_id, n, string_agg(w, ' ' ORDER BY i) AS text, last(kind ORDER BY i) AS type, avg(sure) AS confidence FROM p JOIN e USING (user_id, i) GROUP BY 1, 2), "
    "a AS (SELECT *, (sum(length(text) + 1) OVER (PARTITION BY user_id ORDER BY n) - length(text) - 1)::INT AS start FROM t) SELECT user_id, text, type, start, (start + length(text) - 1)::INT AS \"end\", round(confidence, 6) AS confidence FROM a"
)
def win13_nlp05_merge_tags(s, d):
    merged = nlp.merge_tags(F.col("words"), F.col("tags"), F.col("logits"))
    return tagged(s, d).select("user_id", F.inline(merged)).withColumn("confidence", F.round("confidence", 6))


@query(
    f"WITH {_EVENTS} SELECT user_id, i - 1 AS position, w AS token, CASE WHEN mark = 'O' THEN 'O' ELSE mark || '-' || kind END AS predicted_role, round(sure, 6) AS confidence, "
    "(sum(length(w) + 1) OVER (PARTITION BY user_id ORDER BY i) - length(w) - 1)::BIGINT AS start_idx FROM e"
)
def nlp05_tag_rows(s, d):
    rows = nlp.tag_rows(tagged(s, d).withColumn("mask", F.transform("words", lambda w: F.lit(True))), ["user_id"], "words", "tags", "logits", "mask")
    return rows.select("user_id", F.col("position").cast("long").alias("position"), "token", "predicted_role", F.round("confidence", 6).alias("confidence"), F.col("start_idx").cast("long").alias("start_idx"))


@query(
    f"WITH RECURSIVE {_EVENTS}, x AS (SELECT user_id, i, w, CASE WHEN w = 'click' AND event_id % 2 = 0 THEN 'v' WHEN w = 'view' THEN 's' WHEN w IN ('signup', 'purchase') THEN 'o' END AS part FROM e), "
    "r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::VARCHAR AS s, NULL::VARCHAR AS v, NULL::VARCHAR AS o, NULL::VARCHAR[] AS made FROM x UNION ALL "
    "SELECT user_id, i, CASE WHEN full_ THEN NULL ELSE s END, CASE WHEN full_ THEN NULL ELSE v END, CASE WHEN full_ THEN NULL ELSE o END, CASE WHEN full_ THEN [s, v, o] END FROM ("
    "SELECT *, s IS NOT NULL AND v IS NOT NULL AND o IS NOT NULL AS full_ FROM (SELECT x.user_id, x.i, CASE WHEN part = 's' THEN w ELSE s END AS s, CASE WHEN part = 'v' THEN w ELSE v END AS v, CASE WHEN part = 'o' THEN w ELSE o END AS o FROM r JOIN x ON x.user_id = r.user_id AND x.i = r.i + 1))) "
    "SELECT user_id, made[1] AS s, made[2] AS v, made[3] AS o FROM r WHERE made IS NOT NULL"
)
def win15_nlp10_triples(s, d):
    role = F.transform("words", lambda w: F.when(w == "view", "nsubj").when(w == "signup", "dobj").when(w == "purchase", "pobj").when(w == "click", "root").otherwise("dep"))
    pos = F.transform("ids", lambda i: F.when(i % 2 == 0, "VERB").otherwise("NOUN"))
    return tagged(s, d).select("user_id", F.inline(nlp.triples(F.col("words"), role, pos)))


@query(
    f"WITH RECURSIVE {_EVENTS}, r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, false AS a, false AS b, '' AS tense FROM e UNION ALL SELECT e.user_id, e.i, w = 'view' OR (a AND w NOT IN ('click', 'purchase')), w = 'purchase' OR (b AND NOT (w = 'click' AND NOT a)), "
    "CASE WHEN w IN ('click', 'purchase') AND (a OR b) THEN 'future' WHEN w = 'error' THEN 'past' ELSE 'None' END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, tense, count(*) AS n FROM r WHERE i > 0 GROUP BY 1, 2"
)
def win14_nlp08_tense(s, d):
    """Events as words: views are modifiers, clicks infinitives, purchases 'to', errors past verbs."""
    features = lambda w: F.when(w == "view", F.create_map(F.lit("VerbForm"), F.lit("Mod"))).when(w == "error", F.create_map(F.lit("Tense"), F.lit("Past"), F.lit("VerbForm"), F.lit("Fin"))).when(w.isin("click", "purchase"), F.create_map(F.lit("VerbForm"), F.lit("Inf"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    tense, form = F.transform("words", lambda w: nlp.morphology(features(w))[0]), F.transform("words", lambda w: nlp.morphology(features(w))[1])
    tags = F.transform("words", lambda w: F.when(w == "purchase", "TO").otherwise("VB"))
    return tagged(s, d).select("user_id", F.explode(nlp.future_tense(tense, form, tags)).alias("tense")).groupBy("user_id", "tense").agg(F.count("*").alias("n"))


def phrase_tags():
    return F.zip_with("words", "ids", lambda w, i: F.when(w == "view", "DT").when(w == "click", "JJ").when(w == "purchase", F.when(i % 2 == 0, "CC").otherwise("NNS")).when(w == "error", F.when(i % 5 == 0, "VB").otherwise("HYPH")).otherwise("NN"))


@query(
    f"WITH {_EVENTS}, c AS (SELECT user_id, i, w, CASE w WHEN 'view' THEN 'D' WHEN 'click' THEN 'J' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'C' ELSE 'N' END WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'x' ELSE 'H' END ELSE 'N' END AS c FROM e), "
    "m AS (SELECT user_id, string_split(regexp_replace(string_agg(c, '' ORDER BY i), '(D?J*C*J*N+(HN+)*)', '<\\1>', 'g'), '') AS m FROM c GROUP BY 1), x AS (SELECT user_id, unnest(m) AS ch, generate_subscripts(m, 1) AS k FROM m), "
    "k AS (SELECT user_id, ch, sum((ch = '<')::INT) OVER w AS opened, sum((ch = '>')::INT) OVER w AS closed, sum((ch NOT IN ('<', '>'))::INT) OVER w AS i FROM x WINDOW w AS (PARTITION BY user_id ORDER BY k)) "
    "SELECT user_id, string_agg(c.w, ' ' ORDER BY c.i) AS phrase FROM k JOIN c USING (user_id, i) WHERE ch NOT IN ('<', '>') AND opened > closed GROUP BY user_id, opened"
)
def nlp09_noun_phrases(s, d):
    return tagged(s, d).select("user_id", F.explode(nlp.noun_phrases(F.col("words"), phrase_tags())).alias("phrase"))


@query()
def nlp09_phrase_labels(s, d):
    """Per word the noun phrase that it is part of."""
    return tagged(s, d).select("user_id", F.posexplode(nlp.noun_phrase_labels(F.col("words"), phrase_tags())).alias("position", "label"))


def predictions(s, d):
    """Parts as sentences with two verbs' tags."""
    w = F.split("p_name", " ")
    return table(s, d, "part").select(
        F.col("p_partkey").cast("string").alias("sentence_id"), F.concat(w, F.array(F.lit("ships"), F.lit("x"))).alias("words"),
        F.array(F.concat(F.transform(w, lambda x: F.lit("B-ARG0")), F.array(F.lit("B-V"), F.lit("B-ARG1"))), F.concat(F.transform(w, lambda x: F.lit("O")), F.array(F.lit("B-V"), F.lit("O")))).alias("verbs"),
    )


@query("SELECT p_partkey::VARCHAR AS sentence_id, i - 1 AS tok_idx, w[i] AS token, '0:' || (CASE WHEN i <= len(w) - 2 THEN 'B-ARG0' WHEN i = len(w) - 1 THEN 'B-V' ELSE 'B-ARG1' END) || ',1:' || (CASE WHEN i = len(w) - 1 THEN 'B-V' ELSE 'O' END) AS args FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT p_partkey, list_concat(string_split(p_name, ' '), ['ships', 'x']) AS w FROM part))")
def nlp06_role_map(s, d):
    m = nlp.role_map(predictions(s, d))
    args = F.array_join(F.transform(F.map_entries("srl_args"), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["value"])), ",")
    return m.select("sentence_id", F.col("tok_idx").cast("long").alias("tok_idx"), "token", args.alias("args"))


@query("SELECT p_partkey::VARCHAR AS sentence_id, p_name AS arg0, 'ships' AS verb, 'x' AS arg1 FROM part")
def nlp16_assemble_roles(s, d):
    t = nlp.role_triples(nlp.assemble_roles(nlp.role_map(predictions(s, d))))
    return t.select("sentence_id", F.col("ARG0").alias("arg0"), F.col("V").alias("verb"), F.col("ARG1").alias("arg1"))


@query("SELECT p_partkey::VARCHAR AS sentence_id, 'ARG0' AS role, p_name AS text, array_to_string(list_transform(range(0, len(string_split(p_name, ' '))), lambda i: i::VARCHAR), '-') AS ids, p_name AS phrases FROM part")
def nlp16_role_phrases(s, d):
    """Roles with the noun phrases in them: a part's name as one phrase."""
    tokens = nlp.role_map(predictions(s, d)).join(table(s, d, "part").select(F.col("p_partkey").cast("string").alias("sentence_id"), "p_name"), "sentence_id")
    labelled = tokens.withColumn("np", F.when(F.contains("p_name", "token"), F.col("p_name")).otherwise(""))
    a = nlp.assemble_roles(labelled, "np").where("role = 'ARG0'")
    return a.select("sentence_id", "role", "text", "ids", F.array_join("phrases", "|").alias("phrases"))


@query(f"WITH {_SENT} SELECT doc_id || '_' || k AS sentence_id, len(string_split(s, ' ')) AS n FROM z")
def nlp04_batched_model(s, d):
    """A model over batches of sentences: here one that counts words."""
    return nlp.batched(nlp.sentence_table(table(s, d, "documents"), "doc_id", "text"), lambda: lambda texts: [{"n": len(t.split(" "))} for t in texts], "n long")


@query(f"WITH {_SENT} SELECT 'ner' AS step, count(*) AS n FROM z UNION ALL SELECT 'coref', count(DISTINCT doc_id) FROM z")
def nlp03_discovery(s, d):
    """Steps in their order; one without a model is skipped."""
    sentences = stored(nlp.sentence_table(table(s, d, "documents"), "doc_id", "text"))
    done, _ = nlp.discover(sentences, nlp.documents_of(sentences), {"ner": lambda x: x.select("sentence_id"), "coref": lambda x: x.select("doc_id")})
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n") for name, df in done.items()]
    return counts[0].unionAll(counts[1])


@query("SELECT p_partkey::VARCHAR AS sentence_id, i - 1 AS tok_idx, w[i] AS token, CASE WHEN i <= 2 THEN array_to_string(w[1:2], '-') END AS mentions FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT p_partkey, list_concat(string_split(p_name, ' '), ['ships', 'x']) AS w FROM part))")
def nlp07_cluster_tokens(s, d):
    tokens = predictions(s, d).select("sentence_id", F.posexplode("words").alias("tok_idx", "token"))
    clusters = predictions(s, d).select("sentence_id", F.lit(0).alias("cluster"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    out = nlp.cluster_tokens(tokens, clusters)
    return out.select("sentence_id", F.col("tok_idx").cast("long").alias("tok_idx"), "token", F.array_join(F.flatten("clusters"), ";").alias("mentions"))


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 0 ELSE -1 END AS sentiment FROM conversations")
def nlp11_label_map(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 0).otherwise(-1).alias("sentiment"))


@query("SELECT conv_id, turn, length(text)::BIGINT AS n, role FROM conversations")
def nlp12_combine(s, d):
    """Results of two steps side by side, row by row."""
    c = table(s, d, "conversations")
    return tables.zip_rows(c.select("conv_id", "turn", F.length("text").cast("long").alias("n")), c.select("conv_id", "turn", "role"), ["conv_id", "turn"])



@query()
def nlp14_nlp15_alignment(s, d):
    w = F.split("text", " ")
    b = table(s, d, "benchmark").select("item_id", w.alias("a"), F.filter(w, lambda x: F.length(x) > 2).alias("b"))
    return b.select("item_id", nlp.aligned("a", "b").alias("m")).select("item_id", F.array_join("m.a", " ").alias("a"), F.array_join("m.b", " ").alias("b"))


@query(
    "WITH w AS (SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)), p AS (SELECT a.item_id, least(a.i, b.i) AS s, greatest(a.i, b.i) AS e FROM w a JOIN w b USING (item_id) WHERE a.w = 'the' AND b.w = 'of'), "
    "f AS (SELECT item_id, s, e, row_number() OVER (PARTITION BY item_id ORDER BY e - s, e) AS k FROM p) SELECT item_id AS row, s AS start, e AS \"end\" FROM f WHERE k = 1"
)
def arr08_nlp17_minimal_spans(s, d):
    b = table(s, d, "benchmark").select(F.col("item_id").alias("row"), F.split("text", " ").alias("words"), F.array(F.lit("the"), F.lit("of")).alias("need"))
    return nlp.minimal_spans(b, "words", "need").where("start IS NOT NULL")



@query("SELECT string_split(p_name, ' ')[1] AS \"from\", string_split(p_name, ' ')[2] AS \"to\", 'Of' AS type, count(*) AS weight FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2")
def nlp18_relations(s, d):
    ents = F.array(F.struct(F.lit("A").alias("type"), F.lit(0).alias("start"), F.lit(1).alias("end")), F.struct(F.lit("B").alias("type"), F.lit(1).alias("start"), F.lit(2).alias("end")))
    rel = F.array(F.struct(F.when(F.col("p_partkey") % 2 == 0, "Of").otherwise("Conjunction").alias("type"), F.lit(0).alias("head"), F.lit(1).alias("tail")))
    return nlp.relations(table(s, d, "part").select(F.split("p_name", " ").alias("tokens"), ents.alias("entities"), rel.alias("relations")))


@query("SELECT p_partkey, p_name AS label FROM part")
def hlp03_label_from_ids(s, d):
    """A label from token ids joined with '-': tokens looked up in order."""
    p = table(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    tokens = p.select("p_partkey", F.posexplode("w").alias("id", "token"))
    ids = p.select("p_partkey", F.explode(F.split(F.array_join(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: i.cast("string")), "-"), "-")).alias("id")).withColumn("id", F.col("id").cast("int"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "token"))), lambda x: x["token"]), " ")
    return ids.join(tokens, ["p_partkey", "id"]).groupBy("p_partkey").agg(ordered.alias("label"))


@query("WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, 1::BIGINT AS word_idx, array_to_string(w, '') AS word, (len(w) + 1) / 2.0 AS mean FROM w")
def agg18_nlp22_word_pieces(s, d):
    p = table(s, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "w"))
    p = p.select("p_partkey", "i", F.when(F.col("i") == 0, F.col("w")).otherwise(F.concat(F.lit("##"), "w")).alias("token"), F.array((F.col("i") + 1.0).cast("double")).alias("v"))
    return nlp.word_pieces(p, ["p_partkey"], "i", "token", "v").select("p_partkey", "word_idx", "word", F.element_at("vector", 1).alias("mean"))


_GRAMS = (
    "w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), lambda x: x NOT IN ('the', 'of', 'and')) AS w FROM documents), "
    "g AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM w)"
)


def whole_grams(s, d):
    return topics.Grams(table(s, d, "documents"), "doc_id", "text", ("the", "of", "and"))


@query(f"WITH {_GRAMS} SELECT term, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, term LIMIT 1000")
def top01_vis04_vocabulary(s, d):
    return whole_grams(s, d).vocabulary(1000)


@query(f"WITH {_GRAMS}, v AS (SELECT term FROM g GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 100) SELECT doc_id AS key, term, count(*) AS tf FROM g JOIN v USING (term) GROUP BY 1, 2")
def top01_hlp12_doc_terms(s, d):
    g = whole_grams(s, d)
    return g.doc_terms(g.vocabulary(100))


@query()
def top02_top04_topics(s, d):
    """Top terms of five total-correlation topics."""
    g = whole_grams(s, d)
    return topics.top_terms(topics.fit_topics(g.doc_sets(g.vocabulary(200)), 5, rounds=10)[2])


@query()
def top03_best_n(s, d):
    """Total correlation explained by two and by four topics, the better one first."""
    g = whole_grams(s, d)
    return topics.best_n_topics(g.doc_sets(g.vocabulary(100)), [2, 4], rounds=6)[1]


@query(
    "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v), "
    "p AS (SELECT a.label = b.label AS same, 2 - 2 * list_dot_product(a.e, b.e) AS d2 FROM u a JOIN u b ON b.vec_id > a.vec_id) SELECT round(avg(d2) FILTER (same), 6) AS alignment, round(ln(avg(exp(-2 * d2)) FILTER (NOT same)), 6) AS uniformity FROM p"
)
def agg26_rep04_alignment_uniformity(s, d):
    r = representation.label_alignment_uniformity(table(s, d, "embeddings"))
    return r.select(F.round("alignment", 6).alias("alignment"), F.round("uniformity", 6).alias("uniformity"))


@query("SELECT item_id, md5(array_to_string(w[6:17], ' ')) AS h FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)")
def rep01_context_window(s, d):
    b = table(s, d, "benchmark").select("item_id", F.split("text", " ").alias("w"), F.lit(10).alias("s"), F.lit(12).alias("e"))
    return representation.context_window(b, "w", "s", "e", 5).select("item_id", F.md5(F.array_join("context", " ")).alias("h"))


@query("SELECT item_id, md5(array_to_string(list_resize(list_concat(list_concat(w[1:3], ['[MASK]']), w[6:len(w)])[1:24], 24, '[PAD]'), ' ')) AS h FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)")
def rep02_masked_features(s, d):
    b = table(s, d, "benchmark").select("item_id", F.split("text", " ").alias("w"), F.lit(3).alias("s"), F.lit(5).alias("e"))
    return representation.masked_features(b, "w", "s", "e", 24).select("item_id", F.md5(F.array_join("tokens", " ")).alias("h"))


@query("SELECT vec_id, 3::BIGINT AS partners, true AS apart FROM embeddings")
def rep03_different_label_pairs(s, d):
    """Three partners of other labels an item: how many distinct ones, and whether all differ."""
    e = table(s, d, "embeddings").select("vec_id", "label")
    pairs = representation.different_label_pairs(e, "vec_id", "label", 3).join(e.toDF("a", "la"), "a").join(e.toDF("b", "lb"), "b")
    return pairs.groupBy(F.col("a").alias("vec_id")).agg(F.count_distinct("b").alias("partners"), F.bool_and(F.col("la") != F.col("lb")).alias("apart"))



@query("SELECT label, row_number() OVER (ORDER BY label)::INT - 1 AS index FROM (SELECT DISTINCT event_type AS label FROM events)")
def rep07_label_index(s, d):
    return representation.label_index(table(s, d, "events").select(F.col("event_type").alias("label")), "label")


def orders_as_texts(s, d):
    """Orders with their words and the second they were placed."""
    return table(s, d, "orders").select("o_orderkey", F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"), F.unix_timestamp("o_orderdate").alias("seconds"))


@query(
    "WITH w AS (SELECT o_orderkey, month(o_orderdate)::INT AS month, unnest(string_split(trim(regexp_replace(lower(o_orderpriority || ' ' || o_orderstatus), '[ ]+', ' ', 'g')), ' ')) AS w FROM orders), p AS (SELECT month, w, unnest(range(0, (len(w) + 3) // 4)) AS k FROM w) "
    "SELECT month, CASE WHEN k > 0 THEN '##' ELSE '' END || w[4 * k + 1:4 * k + 4] AS token, count(*) AS n, count(*)::DOUBLE AS lengths FROM p GROUP BY 1, 2"
)
def nlp21_embeddings_by_month(s, d):
    """Word pieces of all orders with their vectors, by month; how many, and the sum of the vectors' squared lengths."""
    e = nlp.subword_embeddings(orders_as_texts(s, d), nlp.hashed_pieces(), "seconds", key="o_orderkey")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return e.groupBy("month", "token").agg(F.count("*").alias("n"), F.round(F.sum(square), 6).alias("lengths"))


@query()
def snk07_topic_outputs(s, d):
    """Topics of all documents saved as tables and read back: documents a topic that each goes with best, and its terms."""
    g = whole_grams(s, d)
    model, shares, terms = topics.fit_topics(g.doc_sets(g.vocabulary(100)), 3, rounds=6)
    path = _roundtrip(s, "topics")
    docs = table(s, d, "documents").select("doc_id")
    writers.save_topics(docs, shares, terms, path, model)
    own = s.read.csv(f"{path}/document_topics", header=True, inferSchema=True)
    best = F.when(F.col("0").isNull(), F.lit(None)).when((F.col("0") >= F.col("1")) & (F.col("0") >= F.col("2")), 0).when(F.col("1") >= F.col("2"), 1).otherwise(2)
    counted = own.groupBy(best.alias("topic")).agg(F.count("*").alias("documents"))
    told = s.read.csv(f"{path}/topic_terms", header=True, inferSchema=True).groupBy("topic").agg(F.count("*").alias("terms"))
    return counted.join(told, "topic", "left")
