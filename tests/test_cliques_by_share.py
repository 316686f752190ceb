"""Cliques of shares of a component are those of its nodes one by one, and links between neighbours are no rows."""

import random

import pytest

from loomgraph.operators import graphs


def plain(links, least):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = set()

    def grow(r, p, x):
        if not p and not x and len(r) >= least:
            out.add("|".join(sorted(r)))
        for v in sorted(p):
            grow({*r, v}, p & near[v], x & near[v])
            p, x = p - {v}, x | {v}

    grow(set(), set(near), set())
    return out


@pytest.mark.parametrize("least", [2, 3])
def test_cliques_by_share(spark, monkeypatch, least):
    monkeypatch.setattr(graphs, "TASK_WEDGES", 40)
    rnd = random.Random(6)
    links = {tuple(sorted((f"n{k}-{x}", f"n{k}-{y}"))) for k, n, m in ((0, 30, 160), (1, 12, 50), (2, 40, 60), (3, 2, 4)) for x, y in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(m)) if x != y}
    df = spark.createDataFrame(sorted(links), "from string, to string")
    rows = {whole: graphs.maximal_cliques(df, least, whole).collect() for whole in (10**6, 45, 0)}
    want = plain(links, least)
    for got in rows.values():
        assert {r.clique for r in got} == want and len(got) == sum(c.count("|") + 1 for c in want)
        assert {(r.component, r.clique, r.node) for r in got} == {(r.component, r.clique, r.node) for r in rows[0]}


def test_links_between_neighbours_are_no_rows(spark):
    df = spark.range(60).selectExpr("cast(id as string) as `from`", "cast((id * 7 + 1) % 60 as string) as `to`")
    plan = graphs.maximal_cliques(df, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "later" not in plan and " p#" not in plan
