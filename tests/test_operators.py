"""Micro fixtures with results worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import arrays, text
from loomgraph.operators import dedup, etl, graphs, nlp, resolve, topics, weights, windows


def col(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("address, expected", [("1 Main St, Moscow, Russian Federation", "Russia"), ("A, 12345", ""), ("", ""), (None, ""), ("X, Chile, ", "Chile")])
def test_country(spark, address, expected):
    assert col(spark, address, text.country) == expected


def test_keys_and_articles(spark):
    assert col(spark, "Acme, Inc.", text.duplicate_key) == col(spark, "acme  inc", text.duplicate_key) == "acme inc"
    assert col(spark, "The a model", text.strip_articles) == "model"
    assert col(spark, "a the model", text.strip_articles) == "the model"
    assert col(spark, " \tx\n", text.strip) == "x"
    assert col(spark, "7_3", text.parent_id) == "7"


def test_ratios():
    assert text.ratio("kitten", "sitting") == pytest.approx(8 / 13)
    rnd = random.Random(0)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(9))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert text.lcs(a, b) == t[-1][-1]
    assert text.initials_score(["j", "s"], ["j", "s"]) == 0.0
    assert text.initials_score(["j", "s"], ["j", "r", "s"]) == -0.5
    assert text.initials_score(["j", "s"], ["s", "j"]) == -1.0
    assert text.parts_ratio("John Smith", "Smith John") == 1.0
    assert text.parts_ratio("a b c d e", "a") == 0.0


def test_percentile_of_positive(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (2.0,)], "v double")
    assert sorted(r.p for r in windows.percentile_ranks(df, "v", "p", positive_only=True).collect()) == pytest.approx([0, 1 / 3, 1, 1])


def test_phi_and_projection(spark):
    e = spark.createDataFrame([(1, "a"), (3, "a"), (2, "b"), (3, "b")], "`from` int, `to` string")
    assert graphs.phi_graph(e, -1.0).first().phi == pytest.approx(-0.5)
    assert graphs.phi_graph(e).count() == 0
    s = spark.createDataFrame([("S1", "P1"), ("S1", "P1"), ("S2", "P1"), ("S2", "P2"), ("S3", "P2")], "`from` string, `to` string")
    w = graphs.projection(s)
    assert {(r.u, r.v, r.weight) for r in w.collect()} == {("S1", "S2", 1), ("S2", "S3", 1)}
    assert {(r.u, r.v, r.score) for r in graphs.two_hop(w).collect()} == {("S1", "S3", 2)}


def test_weighted_graph_and_threshold(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("a", "b", "x"), ("a", "c", "x"), ("c", "a", "y")], "`from` string, `to` string, edgeType string")
    got = {(r["from"], r["to"], r.edgeType): (r.multiplicity, r.weight) for r in weights.weighted_graph(e, up_weight=True).collect()}
    assert got == {("a", "b", "x"): (2, 6), ("a", "c", "x"): (1, 6), ("c", "a", "y"): (1, 6)}
    w = spark.createDataFrame([(float(x),) for x in (1, 1, 1, 2, 10)], "weight double")
    assert weights.weight_threshold(w, 5).first().threshold == 10.0


def test_mode_label(spark):
    df = spark.createDataFrame([(1, x) for x in ("the cat", "cat", "the cat", "cat", "a cat")], "k int, label string")
    assert windows.mode_label(df, ["k"], "label").first().label == "cat"


def test_tags_triples_alignment_pieces(spark):
    df = spark.createDataFrame([("John Smith visited New York City".split(), "B-PER L-PER O B-LOC I-LOC L-LOC".split())], "w array<string>, t array<string>")
    got = [tuple(r) for r in df.select(F.inline(nlp.merge_tags(F.col("w"), F.col("t")))).collect()]
    assert got == [("John Smith", "PER", 0, 9, None), ("visited", "O", 11, 17, None), ("New York City", "LOC", 19, 31, None)]
    for tags, runs in (
        ("B-X O", [[0], [1]]), ("B-X B-X L-X", [[0], [1, 2]]), ("O L-X", [[0], [1]]), ("I-X O", [[1]]), ("B-X I-Y L-X", [[0, 2]]), ("B-X L-Y L-X", [[1], [0, 2]]),
        ("B-X I-X L-Y U-Z", [[0, 1], [2], [3]]), ("O B-X I-X", [[0]]), ("B-X U-Y", [[0], [1]]), ("", []),
    ):
        assert nlp.tag_runs(tags.split()) == runs
    one = spark.createDataFrame([(["a", "b"], ["B-X", "L-X"], [[0.0, 0.0], [3.0, 3.0 + 1e3]]), ([], [], []), (None, None, None)], "w array<string>, t array<string>, l array<array<double>>")
    assert [tuple(r) for r in one.select(F.inline(nlp.merge_tags(F.col("w"), F.col("t"), F.col("l")))).collect()] == [("a b", "X", 0, 2, 0.75)]
    rows = spark.createDataFrame([(1, ["ab", "c"], ["B-X", "O"], [[0.0], [0.0, 0.0], [1.0]], [False, True, True])], "k int, w array<string>, t array<string>, l array<array<double>>, m array<boolean>")
    assert [tuple(r) for r in nlp.tag_rows(rows, ["k"], "w", "t", "l", "m").orderBy("position").collect()] == [(1, 0, "ab", "B-X", 0.5, 0, 1), (1, 1, "c", "O", 1.0, 3, 3)]
    for words, roles, pos, want in (
        ("dog met cat", "nsubj root dobj", "N VERB N", [("dog", "met", "cat")]), ("cat dog met", "pobj nsubj root", "N N VERB", [("dog", "met", "cat")]), ("met dog cat", "root nsubj obj", "NOUN N N", []),
        ("a b met c d met e", "nsubj nsubj root obj nsubj root iobj", "N N VERB N N VERB N", [("b", "met", "c"), ("d", "met", "e")]),
    ):
        svo = spark.createDataFrame([tuple(x.split() for x in (words, roles, pos))], "w array<string>, r array<string>, p array<string>")
        assert [tuple(r) for r in svo.select(F.inline(nlp.triples("w", "r", "p"))).collect()] == want
    verbs = [("None", "modifier", "MD"), ("None", "None", "RB"), ("past", "finite", "VBD"), ("None", "infinitive", "VB"), ("None", "infinitive", "VB"), ("None", "infinitive", "TO"), ("None", "infinitive", "VB"), ("None", "modifier", "MD"), ("None", "infinitive", "TO"), ("None", "infinitive", "VB")]
    v = spark.createDataFrame([tuple(map(list, zip(*verbs)))], "t array<string>, f array<string>, g array<string>")
    assert v.select(nlp.future_tense("t", "f", "g").alias("x")).first().x == ["None", "None", "past", "future", "None", "None", "future", "None", "future", "future"]
    m = spark.createDataFrame([({"Tense": "Pres", "VerbForm": "Fin"},), ({"x": "y"},)], "m map<string,string>")
    assert [tuple(r) for r in m.select(*nlp.morphology(F.col("m"))).collect()] == [("present", "finite"), ("None", "None")]
    for text_, tags, want in (
        ("big and red dog ran", "JJ CC JJ NN VBD", ["big and red dog"]), ("the well - being of Jo", "DT NN HYPH NN IN NNP", ["the well - being", "Jo"]), ("bigger dog", "JJR NN", ["dog"]), ("the big", "DT JJ", []),
    ):
        p = spark.createDataFrame([(text_.split(), tags.split())], "w array<string>, t array<string>")
        assert p.select(nlp.noun_phrases(F.col("w"), F.col("t")).alias("x")).first().x == want
    p = spark.createDataFrame([("the dog saw the dog . Jo".split(), "DT NN VBD DT NN . NNP".split())], "w array<string>, t array<string>")
    assert p.select(nlp.noun_phrase_labels(F.col("w"), F.col("t")).alias("x")).first().x == ["the dog", "the dog", "", "the dog", "the dog", "", ""]
    assert nlp.align(list("abc"), list("ac")) == (["a", "b", "c"], ["a", "[-]", "c"], [0, 1, 2], [0, -1, 1])
    p = spark.createDataFrame([(1, 0, "un", [1.0, 3.0]), (1, 1, "##ion", [3.0, 5.0])], "k int, i int, t string, v array<double>")
    r = nlp.word_pieces(p, ["k"], "i", "t", "v").first()
    assert (r.word, r.vector) == ("union", [2.0, 4.0])


def test_models_behind_batches(spark, tmp_path):
    df = spark.createDataFrame([("a", "x y", 0), ("b", None, 3_000_000), ("c", "z", 0)], "sentence_id string, sentence string, at long")
    got = nlp.batched(df, lambda: lambda texts: [{"n": len(t.split())} for t in texts], "n long", size=2)
    assert {tuple(r) for r in got.collect()} == {("a", 2), ("b", 0), ("c", 1)}
    steps = {"ner": lambda s: s.select("sentence_id"), "coref": lambda d: d.select("doc"), "pos": lambda s: s.select("missing")}
    done, failed = nlp.discover(df, df.select(F.lit(1).alias("doc")), steps, ("pos", "coref", "ner", "svo"))
    assert list(done) == ["coref", "ner"] and [f.split(":")[0] for f in failed] == ["pos", "svo"]
    assert nlp.discover(df.where("false"), df, steps) == ({}, list(nlp.STEPS))
    e = nlp.subword_embeddings(df, lambda: lambda texts: [[("[CLS]", [0.0]), *((w, [1.0]) for w in t.split())] for t in texts], "at", "sentence_id", "sentence")
    assert {(r.sentence_id, r.month, r.position, r.token) for r in e.collect()} == {("a", 1, 1, "x"), ("a", 1, 2, "y"), ("c", 1, 1, "z")}
    script = tmp_path / "model.py"
    script.write_text("import json,sys\nfor l in sys.stdin:\n    print(json.dumps({'n': len(json.loads(l)['tokens'])}))\n")
    x = nlp.external_spans(spark.createDataFrame([(1, ["a", "b"]), (2, None)], "doc_id int, tokens array<string>"), ["python", str(script)], "n long")
    assert {tuple(r) for r in x.collect()} == {(1, 2), (2, 0)}


def test_sentence_ids(spark):
    df = spark.createDataFrame([(7, "One two three. Four five six! Seven eight nine?")], "id int, text string")
    assert sorted(r.sentence_id for r in nlp.sentence_table(df, "id", "text").collect()) == ["7_0", "7_1", "7_2"]


def test_constraints_blacklist_merge(spark):
    assert etl.constrained(spark.createDataFrame([(2.0, 0.5)], "text double, graph double"), {"text": 2.0}).count() == 0
    none = spark.createDataFrame([], "`from` string, `to` string")
    b = resolve.add_to_blacklist(none, spark.createDataFrame([("x", "y"), ("y", "x")], "`from` string, `to` string"))
    assert {tuple(r) for r in b.collect()} == {("x", "y"), ("y", "x")}
    nodes = spark.createDataFrame([("p", "P", "T"), ("q", "Q", "T")], "nodeID string, displayName string, nodeType string")
    edges = spark.createDataFrame([("p", "1"), ("p", "2"), ("p", "3"), ("q", "3")], "`from` string, `to` string")
    n, e, log = graphs.merge_clusters(nodes, edges, spark.createDataFrame([("p", "k"), ("q", "k")], "node string, cluster string"))
    assert [r.nodeID for r in n.collect()] == ["p"]
    assert {tuple(r) for r in e.collect()} == {("p", "1"), ("p", "2"), ("p", "3")}
    assert [(r.canonical, r.merged) for r in log.collect()] == [("p", "q")]


def test_exact_duplicates(spark):
    n = spark.createDataFrame([("2", "Acme, Inc."  , "I"), ("1", "acme inc", "I"), ("3", "acme inc", "J"), ("4", None, "I")], "nodeID string, displayName string, nodeType string")
    assert [tuple(r) for r in dedup.mappings(n).collect()] == [("2", "1")]


def test_components_communities_cliques(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("c", "d", 0.1)], "`from` string, `to` string, weight double")
    assert {r.component for r in graphs.connected_components(e).collect()} == {"a"}
    assert {(r.node, r.cluster) for r in graphs.communities(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    assert {r.clique for r in graphs.maximal_cliques(e, 3).collect()} == {"a|b|c"}
    paths = graphs.connectivity(e, spark.createDataFrame([("a", "c"), ("a", "e")], "a string, b string"))
    assert {(r.a, r.b): r.paths for r in paths.collect()} == {("a", "c"): 2, ("a", "e"): 1}


def test_restructure_links(spark):
    rows = [('{"origin_id":"s1","name":"A","institutions":[{"name":"U","address":"1 St, Peru"}]}', '[{"origin":"ax","origin_id":"1","title":"T"},{"origin":"ax","origin_id":"2"}]', "Scientist", "Paper", "Authored"), ('"Fund"', '"ax3"', "Funding Agency", "Paper", "Funded By"), ('{"institutions":[]}', '"ax4"', "Scientist", "Paper", "Authored")]
    n, e = etl.restructure_links(spark.createDataFrame(rows, "`from` string, `to` string, fromNodeType string, toNodeType string, edgeType string"))
    assert {(r.nodeID, r.nodeType) for r in n.collect()} == {("s1", "Scientist"), ("ax1", "Paper"), ("ax2", "Paper"), ("U1 St, Peru", "Institution"), ("Peru", "Location"), ("Fund", "Funding Agency"), ("ax3", "Paper")}
    assert {(r["from"], r["to"], r.edgeType) for r in e.collect()} == {("s1", "ax1", "Author Of"), ("s1", "ax2", "Author Of"), ("Fund", "ax3", "Funded"), ("s1", "U1 St, Peru", "Belongs To"), ("U1 St, Peru", "Peru", "Located At")}


def test_arrays_ngrams_spans(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [1, 2, 3])], "w array<string>, n array<int>")
    r = df.select(arrays.contains_run(F.array(F.lit("b"), F.lit("c")), F.col("w")).alias("c"), arrays.increasing(F.col("n")).alias("i"), arrays.padded(F.col("n"), 2, 0).alias("p")).first()
    assert (r.c, r.i, r.p) == (True, True, [1, 2])
    t = topics.ngrams(spark.createDataFrame([(1, "x y z"), (2, "")], "k int, t string"), "k", "t")
    assert sorted(r.term for r in t.collect()) == ["x", "x y", "x y z", "y", "y z", "z"]
    s = nlp.minimal_spans(spark.createDataFrame([(1, ["a", "x", "b", "a"], ["a", "b"]), (2, ["a"], ["b"])], "row int, w array<string>, m array<string>"), "w", "m")
    assert {(r.row, r.start, r.end) for r in s.collect()} == {(1, 2, 3), (2, None, None)}


def test_streaming(spark, tmp_path):
    from loomgraph.streaming import incremental

    spark.createDataFrame([("Acme, Inc.", 1), ("acme inc", 2), ("Other", 3)], "name string, n int").selectExpr("name", "timestamp_seconds(n) AS at").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("name string, at timestamp").parquet(f"{tmp_path}/in")
    q = incremental.distinct_nodes(stream, "name", "at").writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == 2
