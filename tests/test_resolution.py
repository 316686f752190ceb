"""Entity resolution against plain versions on small graphs, one per default of a node type."""

import itertools
import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.text import initials_score, parts_ratio, ratio
from loomgraph.operators import graphs, representation, resolve, similarity, views, windows

EDGE = "`from` string, `to` string, edgeType string, fromNodeType string, toNodeType string"
NAMES = ["Ann Lee", "Anne Lee", "Bo Lee", "Ann Lee Bo", "Cher", "Ann Lee", "Ann Ann Lee", "Dan Poe", "Dana Poe", "Ed Poe Lee"]


def plain_likelihood(names):
    """By lists of all pairs of parts in a name, as a person would count them."""
    lists = defaultdict(list)
    for n in names:
        lists[n.lower()] += n.lower().split()
    near = defaultdict(set)
    for parts in lists.values():
        for p, q in itertools.permutations(set(parts), 2):
            near[p].add(q)
    share = Counter(p for parts in lists.values() for p in parts)
    total = sum(share.values())

    def paths(a, b):
        used, k = set(), 1  # parts of one name are neighbours
        while k < min(len(near[a]), len(near[b])):
            came, todo = {a: None}, deque([a])
            while todo and b not in came:
                v = todo.popleft()
                for w in sorted(near[v] - used):
                    if w not in came and not (v == a and w == b):
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

    conns = {n: [(p, q, 1 if p == q else paths(p, q)) for p, q in itertools.combinations(parts, 2)] for n, parts in lists.items()}
    top = max(c for rows in conns.values() for *_, c in rows)
    out = {}
    for n, rows in conns.items():
        by = defaultdict(list)
        for p, q, c in rows:
            by[p].append(c / top)
            by[q].append(c / top)
        if by:
            out[n] = sum(sum(v) / len(v) * share[p] / total for p, v in by.items()) / len(by)
    return out


def people(spark):
    nodes = spark.createDataFrame([(str(i), n, "Scientist") for i, n in enumerate(NAMES)], "nodeID string, displayName string, nodeType string")
    edges = [("0", "p1", "Author Of", "Scientist", "Paper"), ("1", "p2", "Author Of", "Scientist", "Paper"), ("2", "p1", "Author Of", "Scientist", "Paper"), ("2", "p2", "Author Of", "Scientist", "Paper"), ("0", "i", "Belongs To", "Scientist", "Institution"), ("1", "i", "Belongs To", "Scientist", "Institution"), ("7", "i", "Belongs To", "Scientist", "Institution"), ("7", "j", "Belongs To", "Scientist", "Institution"), ("8", "i", "Belongs To", "Scientist", "Institution"), ("8", "j", "Belongs To", "Scientist", "Institution")]
    return nodes, spark.createDataFrame(edges, EDGE)


def test_part_likelihood(spark):
    df = spark.createDataFrame([*enumerate(NAMES)], "id int, name string")
    got = {r.key: r.likelihood for r in similarity.part_likelihood(df, "id", "name").collect()}
    want = plain_likelihood(NAMES)
    assert got == {i: pytest.approx(want[n.lower()]) for i, n in enumerate(NAMES) if n.lower() in want} and 4 not in got


def test_candidates_are_exact(spark):
    """Prefixes lose no pair: as all pairs by whole vectors."""
    rnd = random.Random(1)
    names = sorted({"".join(rnd.choice("aabcdeez") for _ in range(rnd.randrange(1, 9))) for _ in range(60)})
    df = spark.createDataFrame([(n, n) for n in names], "id string, name string")
    w = defaultdict(dict)
    for r in similarity.tfidf(similarity.char_terms(df, "id", "name"), 0.005).collect():
        w[r.key][r.term] = r.w
    for above in (0.8, 0.95):
        want = {(a, b): s for a in names for b in names if a < b and (s := sum(x * w[b].get(t, 0) for t, x in w[a].items())) > above}
        assert {(r.a, r.b): r.similarity for r in similarity.candidate_pairs(df, "id", "name", above).collect()} == {k: pytest.approx(v) for k, v in want.items()}


def test_text_scores(spark):
    """All scientist metrics in their order; the blacklist flags a pair and leaves its scores."""
    nodes, edges = people(spark)
    r = resolve.Resolver(nodes, edges, "Scientist", threshold=0.5)
    plain = {(x["from"], x["to"]): x for x in r.text_scores().collect()}
    likely = plain_likelihood(NAMES)
    name = lambda i: NAMES[int(i)].lower()
    start = lambda n: [p[0] for p in n.split()]
    raw = {k: initials_score(start(name(k[0])), start(name(k[1]))) for k in plain}
    mean = {k: (likely[name(k[0])] + likely[name(k[1])]) / 2 if all(name(x) in likely for x in k) else None for k in plain}
    top = max(v for v in mean.values() if v is not None)
    for k, x in plain.items():
        assert (x.lev, x.parts) == (pytest.approx(ratio(name(k[0]), name(k[1]))), pytest.approx(parts_ratio(name(k[0]), name(k[1]))))
        assert x.initials == pytest.approx(sum(v <= raw[k] for v in raw.values()) / len(raw))
        if mean[k] is None:
            assert x.likelihood is None and x.text is None
        else:
            assert x.likelihood == pytest.approx((1 - mean[k] / top) ** 4)
            assert x.text == pytest.approx((x.tfidf + x.lev + x.parts) * x.initials * x.likelihood)
    one = next(iter(plain))
    listed = resolve.Resolver(nodes, edges, "Scientist", threshold=0.5, blacklist=spark.createDataFrame([one[::-1]], "`from` string, `to` string"), predict=lambda a, b: F.lit(0.5))
    again = {(x["from"], x["to"]): x for x in listed.text_scores().collect()}
    assert {k for k, x in again.items() if x.blacklist} == {one} and set(again) == set(plain)
    assert all(x.text == pytest.approx(plain[k].text or 0.0) and x.predict == 0.5 for k, x in again.items())
    assert one not in {(x["from"], x["to"]) for x in resolve.filtered(resolve._allowed(listed.text_scores()), "lev", 0.0).collect()}


def graph_of(spark, kind, edges, names):
    nodes = spark.createDataFrame([(i, n, kind) for i, n in names.items()], "nodeID string, displayName string, nodeType string")
    r = resolve.Resolver(nodes, spark.createDataFrame(edges, EDGE), kind, threshold=0.0)
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a < b], "`from` string, `to` string")
    return {(x["from"], x["to"]): x.graph for x in r.graph_scores(pairs).collect()}


def test_default_graphs(spark):
    abc = {"a": "x", "b": "y", "c": "z"}
    at = lambda x, y: (x, y, "Located At", "Institution", "Location")
    staff = lambda x, y: (x, y, "Belongs To", "Scientist", "Institution")
    wrote = lambda x, y: (x, y, "Author Of", "Scientist", "Paper")
    # Places: a and b share one; staff: a and b share two, b and c one.
    assert graph_of(spark, "Institution", [at("a", "1"), at("b", "1"), *(staff(s, i) for s, i in (("s", "a"), ("s", "b"), ("t", "a"), ("t", "b"), ("u", "b"), ("u", "c")))], abc) == {("a", "b"): 2.0, ("a", "c"): 0.0, ("b", "c"): 0.5}
    assert graph_of(spark, "Location", [at("i", "a"), at("i", "b"), at("j", "c")], abc) == {("a", "b"): 1.0, ("a", "c"): 0.0, ("b", "c"): 0.0}
    # Co-authors count at two steps only: a and c over b; all pairs work at one place, which tells nothing.
    assert graph_of(spark, "Scientist", [wrote("a", "p"), wrote("b", "p"), wrote("b", "q"), wrote("c", "q"), *(staff(x, "i") for x in "abc")], abc) == {("a", "b"): 0.0, ("a", "c"): 1.0, ("b", "c"): 0.0}
    assert graph_of(spark, "Journal", [("s", "a", "x", "Source", "Journal"), ("s", "b", "x", "Source", "Journal")], abc)["a", "b"] == 1.0
    assert set(graph_of(spark, "Topic", [at("a", "b")], abc).values()) == {0.0}


def test_default_limits(spark):
    nodes = spark.createDataFrame([("a", "Univ of X", "Institution"), ("b", "Univ of X.", "Institution"), ("c", "Other", "Institution")], "nodeID string, displayName string, nodeType string")
    edges = spark.createDataFrame([("s", "a", "Belongs To", "Scientist", "Institution"), ("s", "b", "Belongs To", "Scientist", "Institution"), ("t", "c", "Belongs To", "Scientist", "Institution")], EDGE)
    nodes = nodes.unionByName(spark.createDataFrame([("d", "Univ of Xy", "Institution")], nodes.schema))
    r = resolve.Resolver(nodes, edges, "Institution")
    assert [(x["from"], x["to"]) for x in r.resolved().collect()] == [("a", "b")]
    log = spark.createDataFrame([("c", "a", "b")], "cluster string, canonical string, merged string")
    r.merged_before = spark.createDataFrame([("x", "y", "x")], "match1 string, match2 string, canonical string")
    assert {tuple(x) for x in r.log(log).collect()} == {("a", "b", "a"), ("x", "y", "x")}


def test_merging_flow(spark):
    nodes = spark.createDataFrame([(i, f"Univ {i // 2}" + "." * (i % 2), "Institution") for i in range(4)], "nodeID string, displayName string, nodeType string")
    edges = spark.createDataFrame([(f"s{i // 2}", str(i), "Belongs To", "Scientist", "Institution") for i in range(4)], EDGE)
    m = resolve.Merging(nodes, edges, "Institution", size=4, threshold=0.1)
    review = [(x["from"], x["to"]) for x in m.candidates_for_review().collect()]
    assert ("0", "1") in review and ("2", "3") in review
    log = m.decide(spark.createDataFrame([("0", "1", True), ("2", "3", False)], "`from` string, `to` string, accepted boolean"))
    assert [(x.canonical, x.merged) for x in log.collect()] == [("0", "1")] and {x.nodeID for x in m.nodes.collect()} == {"0", "2", "3"}
    assert {tuple(x) for x in m.blacklist.collect()} == {("2", "3"), ("3", "2")} and not m.next_chunk()
    assert [(h.iteration, h.chunk, h.n_nodes, h.n_edges, h.merged) for h in m.history.collect()] == [(0, 0, 4, 4, True)]
    m.next_iteration(size=2)
    assert m.iteration == 1 and m.active().count() == 2 and m.next_chunk() and m.active().count() == 1
    # Resuming: after the last merged chunk; then the chunk that a history leaves unmerged.
    assert resolve.Merging(m.nodes, m.edges, "Institution", history=m.history).iteration == 1
    open_ = m.history.withColumn("merged", F.lit(False))
    again = resolve.Merging(nodes, edges, "Institution", size=4, history=open_, chunked=resolve.iterate(nodes.select("nodeID"), 4, 0))
    assert (again.iteration, again.chunk) == (0, 0) and again.for_type("Scientist").node_type == "Scientist"


def test_pairs_in_parts(spark, monkeypatch):
    """A hub cut into parts gives each of its pairs once."""
    monkeypatch.setattr(graphs, "PART_ROWS", 3)
    df = spark.createDataFrame([("h", k) for k in range(20)] + [("x", 1), ("y", 2), ("y", 1)], "g string, k int")
    got = Counter((r.g, r.k_a, r.k_b) for r in graphs.pairs_within(df, "g", "k").collect())
    assert got == Counter([*(("h", a, b) for a in range(20) for b in range(a + 1, 20)), ("y", 1, 2)])


def test_greedy_communities():
    """The heap picks as a scan of all gains does."""

    def scanned(nodes, links, total, strength):
        own, between, k = {v: {v} for v in nodes}, {v: {} for v in nodes}, dict(strength)
        for (a, b), w in links.items():
            between[a][b] = between[b][a] = w
        while gains := [(round(between[a][b] / total - k[a] * k[b] / (2 * total**2), 12), a, b) for a in between for b in between[a] if a < b]:
            top = max(g[0] for g in gains)
            if top <= 0:
                break
            _, a, b = min(g for g in gains if g[0] == top)
            own[a] |= own.pop(b)
            k[a] += k.pop(b)
            for c, w in between.pop(b).items():
                del between[c][b]
                if c != a:
                    between[a][c] = between[c][a] = between[a].get(c, 0) + w
        return own

    rnd = random.Random(2)
    for _ in range(20):
        nodes = [f"n{i:02}" for i in range(12)]
        links = {(a, b): rnd.randrange(1, 4) for a, b in itertools.combinations(nodes, 2) if rnd.random() < 0.25}
        strength = {v: sum(w for k, w in links.items() if v in k) for v in nodes}
        total = sum(links.values())
        if total:
            assert graphs._greedy(nodes, links, total, strength) == scanned(nodes, links, total, strength)


def test_refuses_components_past_bound(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "`from` string, `to` string, weight double")
    with pytest.raises(ValueError):
        graphs.communities(e, most=1).count()


def test_pair_sampling(spark, monkeypatch):
    monkeypatch.setattr(representation, "BUCKET_ROWS", 40)
    rows = [(i, "big" if i % 3 else f"l{i % 5}") for i in range(300)] + [(1000, None), (1001, "alone")]
    label = dict(rows)
    df = spark.createDataFrame(rows, "k int, label string")
    same, other = representation.same_label_pairs(df, "k", "label", 3).collect(), representation.different_label_pairs(df, "k", "label", 3).collect()
    sizes = Counter(label.values())
    assert all(label[r.a] == label[r.b] and r.a != r.b for r in same) and len({(r.a, r.b) for r in same}) == len(same)
    assert Counter(r.a for r in same) == {i: min(3, sizes[x] - 1) for i, x in rows if x and sizes[x] > 1}
    assert all(label[r.a] != label[r.b] for r in other) and len({(r.a, r.b) for r in other}) == len(other)
    assert Counter(r.a for r in other) == {i: 3 for i, x in rows if x}


def test_running_sums(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(50)], "x double, n int")
    assert {r.x: r.running for r in windows.running(df, "x", "n").collect()} == {float(i): i * (i + 1) // 2 for i in range(50)}
    assert windows.running(df.where("false"), "x", "n").count() == 0


def test_views_of_graphs(spark, tmp_path):
    from loomgraph.operators.etl import single_valued
    from loomgraph.sources import writers

    edges = spark.createDataFrame([("a", "b", 0.8)], "`from` string, `to` string, weight double")
    nodes, styled = views.community_graph(edges, spark.createDataFrame([("a", "k"), ("b", "k"), ("c", "j")], "node string, cluster string"))
    assert {(r.node, r.colour) for r in nodes.collect()} == {("a", "1"), ("b", "1"), ("c", "2")} and styled.first().penwidth == pytest.approx(1.0)
    html = views.keyword_rows(spark.createDataFrame([("A graph",), (None,)], "text string"), {"graph": "red"}).collect()
    assert [r.html for r in html] == ['A <span style="background-color:red">graph</span>', None]
    df = spark.createDataFrame([(["X"], ["Yy"]), (["a", "b"], ["c"]), ([], ["d"]), (None, ["e"])], "p array<string>, q array<string>")
    assert [tuple(r) for r in single_valued(df, "p", "q").collect()] == [("x", "yy")]
    assert writers.save_local_graph("d", str(tmp_path), None, (edges, nodes), edges) == "ner"
    assert spark.read.json(f"{tmp_path}/d_local_graph_ner_edges").count() == 1 and not (tmp_path / "d_local_graph_srl_edges").exists()
    assert writers.save_local_graph("e", str(tmp_path), srl=edges) == "srl" and writers.save_local_graph("f", str(tmp_path)) == ""
    docs, shares = spark.createDataFrame([(1, "t"), (2, "u")], "id int, text string"), spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.1)], "key int, topic int, p double")
    writers.save_topics(docs, shares, spark.createDataFrame([(0, "w", 0.5)], "topic int, term string, weight double"), str(tmp_path / "topics"))
    assert {tuple(r) for r in spark.read.csv(f"{tmp_path}/topics/document_topics", header=True).collect()} == {("1", "t", "0.9", "0.1"), ("2", "u", None, None)}
