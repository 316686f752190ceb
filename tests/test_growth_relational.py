"""Relational steps whose tasks' memory grew with the table: results of plain versions, and how rows are dealt and made."""

from collections import Counter

from pyspark.sql import functions as F

from loomgraph.operators import etl


def made(df, node):
    """Rows that nodes of a name gave out in the executed plan."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.nodeName() == node:
            n += p.metrics().apply("numOutputRows").value()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            todo.append(p.plan())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return n


def test_touched_deals_ends_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(etl, "TASK_ROWS", 200, raising=False)
    edges = spark.createDataFrame([(f"a{i}", "hub" if i % 2 else None) for i in range(2000)], "`from` string, `to` string")
    nodes = spark.createDataFrame([(f"a{i}",) for i in range(0, 4000, 3)] + [("hub",), ("lone",), (None,)], "nodeID string")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in before:
        spark.conf.set(k, "-1")
    try:
        rows = etl.touched(nodes, edges).select("nodeID", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(r.nodeID for r in rows) == sorted([f"a{i}" for i in range(0, 2000, 3)] + ["hub"])
    assert len({r.p for r in rows}) > 10


def test_multisets_within_rows(spark):
    """Repeated and null keys, nulls, '' and long bags; bags of single keys are not exploded."""
    rows = [(i, list("abca" * (i % 3)) + [""], list("cab" * (i % 4)) + [None]) for i in range(500)]
    rows += [(7, ["a", "z"], ["z"]), (None, ["a"], ["a", "b"]), (None, ["b"], None), (900, ["x"] * 700, ["x"] * 400 + ["y"]), (901, None, ["q", "q"]), (902, [], None)]
    a, b = {}, {}
    for k, x, y in rows:
        a.setdefault(k, Counter()).update(v for v in x or [] if v)
        b.setdefault(k, Counter()).update(v for v in y or [] if v)
    want = {k: ((a[k] & b[k]).total(), (a[k] | b[k]).total(), (a[k] - b[k]).total()) for k in a if a[k] or b[k]}
    df = etl.multiset(spark.createDataFrame(rows, "k long, x array<string>, y array<string>"), "k", F.col("x"), F.col("y"))
    got = df.collect()
    assert {r.k: (r.common, r.either, r.only) for r in got} == want and len(got) == len(want)
    assert made(df, "Generate") < 1300


def test_sentences_are_objects_by_slices():
    """A batch of 4,000 sentences of 100 words: objects at a time are a slice's, and results are those of single rows."""
    import tracemalloc

    import pyarrow as pa

    from loomgraph.operators import nlp

    tags = [("B-PER", "I-PER", "L-PER", "O", "U-LOC")[i % 5] for i in range(100)]
    rows = [([f"w{i}" for i in range(100)], tags, [[float(i % 7), 1.0, 0.5] for i in range(100)]), (None, None, None), ([], [], [])]
    batch = [pa.array([rows[i % 3][c] if i % 3 else rows[0][c] for i in range(4000)], k) for c, k in enumerate((pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.list_(pa.float64()))))]
    merged = nlp._merged.func(*[c.slice(0, 0) for c in batch])
    assert len(merged) == 0
    tracemalloc.start()
    merged = nlp._merged.func(*batch)
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    one = [nlp._merged.func(*[c.slice(i, 1) for c in batch]).to_pylist()[0] for i in range(3)]
    assert merged.to_pylist() == [one[i % 3] for i in range(4000)] and len(one[0]) == 60
    assert top < 20e6


def test_uniformity_sends_vectors_to_few_parts(spark, monkeypatch):
    """As plain sums over all pairs, over several tiles; each vector is sent once a part, and parts do not grow with the rows."""
    import numpy as np

    from loomgraph.operators import representation as rep

    x = np.random.default_rng(3).normal(size=(300, 4))
    labels = [i % 3 for i in range(300)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d2 = 2 - 2 * u @ u.T
    low, same = np.triu(np.ones((300, 300), bool), 1), np.equal.outer(labels, labels)
    monkeypatch.setattr(rep, "TILE_ROWS", 16, raising=False)
    monkeypatch.setattr(rep, "MOST_PARTS", 3, raising=False)
    r = rep.label_alignment_uniformity(spark.createDataFrame([(i, v.tolist(), l) for i, (v, l) in enumerate(zip(x, labels))], "vec_id long, embedding array<double>, label long")).first()
    assert np.isclose(r.alignment, d2[low & same].mean()) and np.isclose(r.uniformity, np.log(np.exp(-2 * d2[low & ~same]).mean()))
    monkeypatch.undo()
    assert rep._parts(0) == 1 and rep._parts(5000) == 5 and rep._parts(100_000) == rep._parts(1_000_000) == 32


def test_projection_deals_pairs_by_their_number(spark, monkeypatch):
    """Few bytes make many pairs: tasks are as many as the pairs ask for, with the same pairs."""
    from loomgraph.operators import graphs

    edges = spark.range(60).crossJoin(spark.range(40).toDF("to")).where("(id + to) % 3 > 0").select(F.col("id").alias("from"), "to")
    want = {(r.u, r.v): r.weight for r in graphs.projection(edges).collect()}
    monkeypatch.setattr(graphs, "TASK_PAIRS", 500, raising=False)
    pairs = graphs.pairs_within(edges, "to", "from")
    rows = pairs.withColumn("p", F.spark_partition_id()).collect()
    assert Counter((r.from_a, r.from_b) for r in rows) == want and len({r.p for r in rows}) > 10
