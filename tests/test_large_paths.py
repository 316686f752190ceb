"""Operators whose large inputs go another way than small ones: both ways give the rows of a plain version."""

import itertools
import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scratch
from loomgraph.operators import factored, graphs, metric, nlp, similarity, topics, windows


@pytest.mark.parametrize("parts, above", [(None, 0.6), (3, 0.6), (3, 0.95)])
def test_metric_join_equals_all_pairs(spark, monkeypatch, parts, above):
    """Groups, two dimensions, equal vectors, null and empty ones; parts of a few rows meet where they must."""
    if parts:
        monkeypatch.setattr(metric, "PARTS", 100)
        monkeypatch.setattr(metric, "PIVOTS", (1, 4, 16))
    rnd = np.random.default_rng(3)
    rows = []
    for i in range(240):
        d = 3 if i % 40 == 0 else 20
        x = rnd.standard_normal(d) + (3 * np.eye(d)[i % 3] if i % 2 else 0)
        x = rows[-2][2] if i % 17 == 0 and i > 2 and len(rows[-2][2]) == d else (x / np.linalg.norm(x)).tolist()
        rows.append((f"k{i:03}", i % 2, x))
    df = spark.createDataFrame([*rows, ("none", 0, None), ("empty", 0, []), (None, 0, rows[1][2]), ("alone", None, rows[1][2])], "k string, g int, x array<double>")
    sims = {(a[0], b[0]): float(np.dot(a[2], b[2])) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and len(a[2]) == len(b[2])}
    want = {p: s for p, s in sims.items() if s > above}
    got = {(r.a, r.b): r.similarity for r in metric.similar_pairs(df, above, "k", "x", "g").collect()}
    assert set(got) == set(want) and len(want) > 10 and all(got[p] == pytest.approx(s) for p, s in want.items())
    assert metric.similar_pairs(df.where("false"), above, "k", "x", "g").count() == 0


def test_pivots_keep_cells_apart(spark):
    """Close groups far from each other: no pair of parts of different groups is made, and rows are those of all pairs."""
    rnd = np.random.default_rng(5)
    centres = np.linalg.qr(rnd.standard_normal((24, 24)))[0]
    x = centres[np.arange(4000) % 24] + 0.02 * rnd.standard_normal((4000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert len(metric._chosen(x, 4000, math.acos(0.99), 128)) >= 16
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, x array<double>").repartition(4)
    assert metric.similar_pairs(df, 0.99, "k", "x").count() == int(((x @ x.T) > 0.99).sum() - 4000) // 2


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("above", [0.0, 0.5, 0.85])
def test_edit_ratio_join(spark, above):
    rnd = random.Random(2)
    names = sorted({"".join(rnd.choice("abcdé한") for _ in range(rnd.choice([0, 1, 3, 5, 8, 70, 140]))) for _ in range(60)})
    names += [n[:3] + "x" + n[3:] for n in names if len(n) > 6]
    df = spark.createDataFrame([*enumerate(names), (900, None)], "id int, name string")
    want = {(i, j): r for (i, a), (j, b) in itertools.combinations(enumerate(names), 2) if len(a) + len(b) and (r := 2 * common(a, b) / (len(a) + len(b))) > above}
    assert {(r.a, r.b): r.ratio for r in similarity.pairwise_edit_ratio(df, "id", "name", above).collect()} == {k: pytest.approx(v) for k, v in want.items()} and want


def plain_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for e in edges for x in e}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_by_stars(spark, kind):
    rnd = random.Random(7)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(999, i) for i in range(200, 260)] + [(5, 5)]
    edges = [tuple(f"n{x:04}" for x in e) if kind == "string" else e for e in edges]
    df = spark.createDataFrame(edges, f"from {kind}, to {kind}")
    want = plain_components([e for e in edges if e[0] != e[1]])
    for small, hub in ((10**6, 10**6), (0, 5)) if kind == "long" else ((10**6, 10**6), (0, 10**6)):
        assert {r.node: r.component for r in graphs.connected_components(df, small, hub).collect()} == want
    assert graphs.connected_components(df.where("false")).count() == 0


def test_star_of_many_leaves_is_even(spark):
    """A hub's leaves do not meet in one task of a join: they get the hub's news by broadcast."""
    leaves = spark.range(1, 60_001).select(F.col("id").alias("from"), F.lit(1_000_000).cast("long").alias("to"))
    got = graphs.connected_components(leaves, small=0, hub=1000)
    assert got.agg(F.count("*"), F.max("component")).first()[:] == (60_001, 1)


def test_factored_projection(spark):
    """Links of classes, their pairs, degrees, thresholds and reach equal those of the expanded projection."""
    rnd = random.Random(1)
    edges = [(u, n) for u in range(60) for n in ([1000] if u < 30 else rnd.sample(range(1001, 1012), rnd.randrange(1, 4)))] + [(7, 1000), (None, 3), (3, None)]
    df = spark.createDataFrame(edges, "from int, to int")
    near = defaultdict(set)
    for u, n in edges:
        if u is not None and n is not None:
            near[u].add(n)
    full = {(a, b): w for a, b in itertools.combinations(sorted(near), 2) if (w := len(near[a] & near[b]))}
    f = factored.factored_projection(df)
    assert {(r.u, r.v): r.weight for r in f.expand().collect()} == full == {(r.u, r.v): r.weight for r in graphs.projection(df.dropna()).collect()}
    assert f.links.count() < len(full) and f.pairs().first().pairs == len(full)
    for above in (0, 1):
        own = {p: w for p, w in full.items() if w > above}
        g = f.threshold(above)
        want = {u: (sum(u in p for p in own), sum(w for p, w in own.items() if u in p)) for u in near}
        assert {r.node: (r.degree, r.strength) for r in g.degrees().collect()} == want
        seen = {40}
        for k in range(1, 3):
            seen |= {b for p in own for a, b in (p, p[::-1]) if a in seen}
            assert {r.node for r in g.within(spark.createDataFrame([(40,)], "node int"), k).collect()} == seen


def test_cliques_by_node(spark):
    rnd = random.Random(9)
    for share in (0.15, 0.5):
        near = defaultdict(set)
        edges = [(f"v{a:02}", f"v{b:02}") for a, b in itertools.combinations(range(16), 2) if rnd.random() < share] + [("x", "y"), ("y", "x"), ("z", "z")]
        for a, b in edges:
            if a != b:
                near[a].add(b)
                near[b].add(a)
        sets = [set(c) for n in range(2, 9) for c in itertools.combinations(sorted(near), n) if all(b in near[a] for a, b in itertools.combinations(c, 2))]
        for least in (2, 3):
            want = {"|".join(sorted(c)) for c in sets if len(c) >= least and not any(c < o for o in sets)}
            rows = graphs.maximal_cliques(spark.createDataFrame(edges, "from string, to string"), least).collect()
            assert {r.clique for r in rows} == want and all(n == len(c.split("|")) for c, n in Counter(r.clique for r in rows).items())


def test_two_hops_over_a_hub(spark, monkeypatch):
    """A hub's paths are dealt by parts of it, with the rows of a plain join."""
    monkeypatch.setattr(graphs, "PART_ROWS", 7)
    w = {(0, i): i % 5 + 1 for i in range(1, 40)} | {(1, 2): 4, (3, 50): 2}
    both = w | {(b, a): x for (a, b), x in w.items()}
    want = defaultdict(int)
    for (u, p), x in both.items():
        for (q, v), y in both.items():
            if p == q and u < v and (u, v) not in both:
                want[u, v] += x + y
    rows = graphs.two_hop(spark.createDataFrame([(*k, x) for k, x in w.items()], "u int, v int, weight long")).collect()
    assert {(r.u, r.v): r.score for r in rows} == want


def plain_align(a, b):
    n, m = len(a), len(b)
    s = [[-j for j in range(m + 1)]]
    for i in range(1, n + 1):
        s.append([-i])
        for j in range(1, m + 1):
            s[i].append(max(s[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), s[i - 1][j] - 1, s[i][j - 1] - 1))
    out, i, j = [], n, m
    while i or j:
        if i and j and s[i][j] == s[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and s[i][j] == s[i - 1][j] - 1:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


def test_alignment_keeps_few_rows():
    rnd = random.Random(11)
    for _ in range(150):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randrange(0, 24))] for _ in range(2))
        x, y, p, q = nlp.align(a, b)
        assert [*zip(p, q)] == plain_align(a, b)
        assert x == [a[i] if i >= 0 else "[-]" for i in p] and y == [b[j] if j >= 0 else "[-]" for j in q]
    import tracemalloc

    a, b = ([rnd.choice("abcdefgh") for _ in range(4000)] for _ in range(2))
    tracemalloc.start()
    began = time.time()
    p = nlp.align(a, b)[2]
    assert tracemalloc.get_traced_memory()[1] < 40e6 and time.time() - began < 60 and [i for i in p if i >= 0] == [*range(4000)]
    tracemalloc.stop()


def test_long_groups_by_carried_scans(spark):
    """Fills, runs, sums and ids over groups that stand in several ranges, with null groups and values."""
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i, rnd.choice([None, None, "x", "y"]), rnd.randrange(5)) for i in range(400)] + [("c", 0, None, 1)]
    df = spark.createDataFrame(rows, "g string, t int, v string, n int").repartition(5)
    same = lambda f: [sorted((tuple(r) for r in f(most).collect()), key=str) for most in (10**6, 20)]
    for f in (
        lambda most: windows.filled(df, "v", ["g"], ["t"], most), lambda most: windows.runs(df, ["g"], ["t"], "v", most),
        lambda most: windows.offsets(df, ["g"], ["t"], F.col("n"), 1, most), lambda most: windows.running_ids(df, "g", ["t"], most),
    ):
        short, long = same(f)
        assert short == long and len(short) == 401


@pytest.mark.parametrize("kept", [1 << 18, 8])
def test_grams_equal_rows_of_grams(spark, kept):
    """Heavy hitters are exact however few are kept in the first pass; texts with letters whose lower case is ASCII."""
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["The", "of", "a1", "Be", "c-d", "\u212a9", "é", "x"]) for _ in range(rnd.randrange(0, 40))) for _ in range(40)] + [None, "", "of"]
    df = spark.createDataFrame([*enumerate(texts)], "k int, t string").repartition(3)
    g = topics.Grams(df, "k", "t", ("of",))
    rows = topics.ngrams(df, "k", "t", ("of",)).collect()
    counts = Counter(r.term for r in rows)
    best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    for size in (1, 7, 10_000):
        assert [(r.term, r.n) for r in g.vocabulary(size, kept).orderBy(F.desc("n"), "term").collect()] == best[:size]
    some = spark.createDataFrame([(t,) for t, _ in best[3:12]], "term string")
    want = Counter((r.key, r.term) for r in rows if r.term in {t for t, _ in best[3:12]})
    assert {(r.key, r.term): r.tf for r in g.doc_terms(some).collect()} == want


def test_local_folder_is_refused_on_a_cluster():
    assert scratch.local_folder("local[4]").startswith("file://") and scratch.local_folder("local").startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(ValueError):
            scratch.local_folder(master)


def test_matcher_tells_misspelt_names(spark):
    rnd = random.Random(8)
    syllables = "an ber ca do el fer gu har is jo ka lo mi no or pa qui ro".split()
    df = spark.createDataFrame([("".join(rnd.choice(syllables) for _ in range(3)) + " " + "".join(rnd.choice(syllables) for _ in range(2)),) for _ in range(300)], "name string")
    pairs = similarity.misspelt_pairs(df, "name")
    match = similarity.fit_matcher(pairs.where(F.xxhash64("a") % 2 == 0))
    held = pairs.where(F.xxhash64("a") % 2 != 0).select("label", match(F.col("a"), F.col("b")).alias("p")).collect()
    assert len(held) > 100 and np.mean([(r.p > 0.5) == r.label for r in held]) > 0.95
