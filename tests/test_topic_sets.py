"""Documents' sets of terms are made once, by the task that reads the text."""

from pyspark.sql import functions as F

from loomgraph.operators import topics


def test_sets_equal_counts(spark):
    texts = ["a b a c", "", None, "b c d", "zz", "A-b b", "c a b c a b"]
    df = spark.createDataFrame([(k % 6, t) for k, t in enumerate(texts)], "k int, text string").repartition(3)
    g = topics.Grams(df, "k", "text", ("d",))
    vocab = g.vocabulary(6)
    want = {}
    for r in g.doc_terms(vocab).collect():
        want.setdefault(r.key, set()).add(r.term)
    rows = g.doc_sets(vocab).where(F.size("terms") > 0).collect()
    assert {r.key: set(r.terms) for r in rows} == want and sum(len(r.terms) for r in rows) == sum(map(len, want.values())) and len(rows) == len(want)
    one, two = (topics._incidence(x) for x in (g.doc_terms(vocab), g.doc_sets(vocab)))
    assert one[1] == two[1] and sorted(one[0].collect()) == sorted(two[0].collect())


def test_texts_are_read_once(spark):
    """A fit reads what it is given once; before, each document's terms were found twice."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(k, t, 1) for k in range(40) for t in ("ab" if k % 2 else "cd")]
    counts = spark.createDataFrame(rows, "key int, term string, tf int").mapInArrow(seen, "key int, term string, tf int")
    topics.fit_topics(counts, 2, rounds=3)
    assert read.value == len(rows)
