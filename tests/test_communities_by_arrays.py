"""Communities by arrays are those of plain tables, and large components are worked on."""

import inspect
import random
import time

import numpy as np

from loomgraph.operators import graphs


def given(rnd, n, m, weights):
    a, b = (np.array([rnd.randrange(n) for _ in range(m)]) for _ in range(2))
    w = np.array([weights() for _ in range(m)])
    return a, b, w, np.bincount(np.concatenate([a, b]), np.concatenate([w, w]), n), float(w.sum())


def both(a, b, w, k, total):
    took = []
    for f, args in ((graphs._greedy_numbers, [x.tolist() for x in (a, b, w, k)]), (graphs._greedy_arrays, [a, b, w, k])):
        began = time.process_time()
        found = f(*args, total)
        took.append((time.process_time() - began, found))
    return took


def test_communities_by_arrays():
    """With repeated links, loops and many equal gains."""
    for seed in range(300):
        rnd = random.Random(seed)
        n = rnd.randrange(2, 40)
        one, two = both(*given(rnd, n, rnd.randrange(1, 5 * n), rnd.random if seed % 2 else lambda: rnd.choice([1.0, 2.0, 0.5])))
        assert one[1] == two[1]


def test_arrays_are_faster():
    rnd = random.Random(1)
    a, b, w, k, total = given(rnd, 1500, 30_000, rnd.random)
    one, two = both(a, b, w, k, 10 * total)
    assert one[1] == two[1] and two[0] < 0.7 * one[0]


def test_packed_pool(monkeypatch):
    packed = []
    pack = graphs._Rows._pack
    monkeypatch.setattr(graphs._Rows, "_pack", lambda self, room: packed.append(room) or pack(self, room))
    rnd = random.Random(2)
    a, b, w, k, total = given(rnd, 400, 8000, rnd.random)
    one, two = both(a, b, w, k, 10 * total)
    assert one[1] == two[1] and packed


def test_large_components_are_taken(spark, monkeypatch):
    monkeypatch.setattr(graphs, "FEW_LINKS", 10)
    rows = [(f"n{x:02}", f"n{x // 20 * 20 + y:02}", 1.0) for x in range(60) for y in range(20) if x % 20 < y] + [("n00", "n20", 0.1), ("n20", "n40", 0.1)]
    got = {r.node: r.cluster for r in graphs.communities(spark.createDataFrame(rows, "from string, to string, weight double")).collect()}
    assert got == {f"n{x:02}": f"n{x // 20 * 20:02}" for x in range(60)}
    assert inspect.signature(graphs.communities).parameters["most"].default >= 20_000_000
