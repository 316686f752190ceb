"""Total-correlation topics on made-up documents, and against the dense formula."""

import random

import numpy as np
import pytest

from loomgraph.operators import topics


def made(spark, rnd, n=400):
    """Documents in which two groups of terms come and go together, and one term by chance."""
    rows = []
    for k in range(n):
        for group in ("abcd", "wxyz"):
            if rnd.random() < 0.4:
                rows += [(k, t, 1 + k % 3) for t in group if rnd.random() < 0.9]
        if rnd.random() < 0.5:
            rows.append((k, "noise", 1))
    return spark.createDataFrame(rows, "key int, term string, tf int")


def test_topics_find_groups(spark):
    counts = made(spark, random.Random(1))
    model, shares, terms = topics.fit_topics(counts, 2)
    by = {}
    for r in topics.top_terms(terms, 4).collect():
        by.setdefault(r.topic, set()).add(r.term)
    assert sorted(map(sorted, by.values())) == [list("abcd"), list("wxyz")]
    assert model.score > 1.0  # each group of four carries over half a nat
    # The dense formula over the same model.
    docs = {}
    for r in counts.collect():
        docs.setdefault(r.key, set()).add(r.term)
    got = {(r.key, r.topic): r.p for r in shares.collect()}
    for k, own in [*docs.items()][:50]:
        x = np.array([t in own for t in model.terms]).astype(int)
        at = np.arange(len(x))
        for j in range(2):
            log = [model.prior[y, j] + (model.alpha[j] * (model.given[y, x, j, at] - model.marginal[x, at])).sum() for y in (0, 1)]
            assert got[k, j] == pytest.approx(np.exp(log[1] - np.logaddexp(*log)))


def test_topics_of_chance_explain_little(spark):
    rnd = random.Random(2)
    rows = [(k, t, 1) for k in range(400) for t in "abcdef" if rnd.random() < 0.3]
    assert topics.fit_topics(spark.createDataFrame(rows, "key int, term string, tf int"), 2)[0].score < 0.2


def test_best_number_and_empty(spark):
    counts = made(spark, random.Random(3), 200)
    best, table = topics.best_n_topics(counts, [1, 2], rounds=15)
    rows = table.collect()
    assert [r.n_topics for r in rows][0] == 2 == best.alpha.shape[0] and rows[0].score > rows[1].score
    with pytest.raises(ValueError):
        topics.fit_topics(counts.where("false"), 2)
