"""Graph queries without SQL against plain versions over a whole small table."""

import itertools
from collections import defaultdict, deque

import pytest

from loomgraph.plans import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def links(spark):
    from loomgraph.operators.graphs import cosine_graph

    rows = cosine_graph(spark.read.parquet(f"{DATA}/embeddings.parquet"), "vec_id", "embedding", "label", 0.3).collect()
    return {(str(min(r.a, r.b)), str(max(r.a, r.b))): r.similarity for r in rows}


def neighbours(links):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    return near


def test_communities(spark, links):
    """Greedy modularity by a scan of all gains after every merge."""
    own = {v: {v} for e in links for v in e}
    between, k = {v: {} for v in own}, dict.fromkeys(own, 0.0)
    for (a, b), w in links.items():
        between[a][b] = between[b][a] = w
        k[a] += w
        k[b] += w
    total = sum(links.values())
    while True:
        gains = [(between[a][b] / total - k[a] * k[b] / (2 * total**2), a, b) for a in between for b in between[a] if a < b]
        top = max((g[0] for g in gains), default=0)
        if top <= 1e-12:
            break
        _, a, b = min(g for g in gains if g[0] == top)
        own[a] |= own.pop(b)
        k[a] += k.pop(b)
        for c, w in between.pop(b).items():
            del between[c][b]
            if c != a:
                between[a][c] = between[c][a] = between[a].get(c, 0) + w
    got = {r.node: r.cluster for r in QUERIES["gr09_communities"](spark, DATA).collect()}
    assert got == {v: min(vs) for vs in own.values() for v in vs} and len(set(got.values())) > 1


def test_cliques(spark, links):
    near = neighbours(links)
    every = [set(c) for n in range(3, 7) for v in near for c in itertools.combinations(sorted({v, *near[v]}), n) if v == c[0] and all(y in near[x] for x, y in itertools.combinations(c, 2))]
    maximal = {"|".join(sorted(c)) for c in every if not any(c < o for o in every)}
    assert {r.clique for r in QUERIES["gr12_cliques"](spark, DATA).collect()} == maximal


def test_connectivity(spark, links):
    near = neighbours(links)

    def paths(a, b):
        used, k = set(), 1
        while k < min(len(near[a]), len(near[b])):
            came, todo = {a: None}, deque([a])
            while todo and b not in came:
                v = todo.popleft()
                for w in sorted(near[v] - used):
                    if w not in came and (v, w) != (a, b):
                        came[w] = v
                        todo.append(w)
            if b not in came:
                break
            v = came[b]
            while v != a:
                used.add(v)
                v = came[v]
            k += 1
        return k

    got = {(str(min(int(r.a), int(r.b))), str(max(int(r.a), int(r.b)))): r.paths for r in QUERIES["gr13_connectivity"](spark, DATA).collect()}
    assert len(got) == len(links) and all(n == paths(str(min(int(a), int(b))), str(max(int(a), int(b)))) for (a, b), n in got.items())


def test_name_likelihood_and_parts(spark):
    from loomgraph.functions.text import ratio
    from tests.test_resolution import plain_likelihood

    names = sorted({r.p_name for r in spark.read.parquet(f"{DATA}/part.parquet").collect()})
    got = {r.key: r.likelihood for r in QUERIES["agg21_name_likelihood"](spark, DATA).collect()}
    assert got == {n: pytest.approx(v, abs=1e-6) for n, v in plain_likelihood(names).items()}
    for r in QUERIES["str13_parts_similarity"](spark, DATA).collect():
        x, y = r.a.split(), r.b.split()
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        best = max(sum(ratio(p, q) for p, q in zip(x, order)) / len(x) for order in itertools.permutations(y, len(x))) if len(y) <= 4 else 0.0
        assert r.similarity == pytest.approx(best, abs=1e-6)
