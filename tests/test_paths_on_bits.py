"""Disjoint paths on bits are those of the search by sets, and links are worked out once."""

import random
import time

import numpy as np
import pytest

from loomgraph.operators import graphs
from loomgraph.plans import QUERIES


@pytest.mark.parametrize("wide", [0, 256])
def test_paths_on_bits(monkeypatch, wide):
    monkeypatch.setattr(graphs, "WIDE_LAYER", wide)
    longest = 0
    for seed in range(200):
        rnd = random.Random(seed)
        n = rnd.randrange(4, 40)
        links = [(x, y) for x, y in sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randrange(n, 4 * n))}) if x != y]
        codes = np.array([x for x, _ in links] + [y for _, y in links])
        near, bits = graphs._neighbours(codes, n), graphs._bit_rows(codes, n, 7)
        for x in range(n):
            for y in range(n):
                longest = max(longest, found := graphs.disjoint_paths(near, x, y))
                assert graphs._paths_on_bits(bits, x, y) == found
    assert longest > 3


def test_paths_on_bits_are_fast():
    rng = np.random.default_rng(0)
    n = 5000
    a, b = rng.integers(0, n, 100_000), rng.integers(0, n, 100_000)
    codes = np.concatenate([a[a != b], b[a != b]])
    near, bits = graphs._neighbours(codes, n), graphs._bit_rows(codes, n)
    pairs = list(zip(codes[:150].tolist(), codes[len(codes) // 2 :][:150].tolist()))
    took = []
    for f, rows in ((graphs.disjoint_paths, near), (graphs._paths_on_bits, bits)):
        began = time.process_time()
        found = [f(rows, *p) for p in pairs]
        took.append((time.process_time() - began, found))
    assert took[0][1] == took[1][1] and took[1][0] < 0.8 * took[0][0]


def test_links_are_found_once(spark, monkeypatch):
    called = []
    compare = graphs.cosine_graph
    monkeypatch.setattr(graphs, "cosine_graph", lambda *a: called.append(compare(*a)) or called[-1])
    plan = QUERIES["gr13_connectivity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert called and "MapInArrow" not in plan
