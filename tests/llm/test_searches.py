"""Spelling variants, nearest neighbours and collocations against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import date
from decimal import Decimal

import duckdb
import numpy as np
import pytest

from loomgraph.llm import collocations, embedding_dup, multi_index, queries, spelling, words

DATA = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def variants(rows, least=3, length=5, modulus=97):
    """Near words by masks of one letter."""
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % modulus == 0 else run] += 1
    n = {w: k for w, k in count.items() if k >= least and len(w) >= length}
    near, masks = defaultdict(set), defaultdict(list)
    for w in n:
        for i in range(len(w)):
            masks[w[:i] + w[i + 1 :], i].append(w)
    for (rest, _), own in masks.items():
        for w in own:
            near[w] |= set(own) - {w}
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    form = {w: b for w in n if near[w] and n[b := min(near[w], key=lambda v: (-n[v], v))] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


@pytest.mark.parametrize("split", [spelling.SPLIT, 3])
def test_spelling_variants(spark, split):
    """A dense alphabet, accents, words of over 64 bytes, chains of forms, letters cut away, and signatures of many words."""
    rnd = random.Random(1)
    base = ["".join(rnd.choice("abcéÿ") for _ in range(rnd.randrange(4, 9))) for _ in range(60)] + ["é" * 70, "é" * 69, "x" * 64, "x" * 63 + "y"]
    rows = []
    for i in range(300):
        own = []
        for _ in range(30):
            w = rnd.choice(base[: 1 + rnd.randrange(len(base))])
            k = rnd.randrange(len(w))
            own.append(rnd.choice([w, w, w.upper(), w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + "É" + w[k + 1 :]]))
        rows.append((i if i % 50 else None, rnd.choice([" ", "-", "1", "Ā", "× "]).join(own)))
    rows += [(1, None), (2, ""), (2, ""), (3, "한글 " * 5)]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = sorted(tuple(r) for r in spelling.variants(df, split=split).collect())
    assert got == variants(rows) and len(got) > 100 and any(r[1] and r[2] != r[1] for r in got)
    assert spelling.variants(df.where("false")).count() == 0


def test_spelling_query_on_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op11_spelling_variants(spark, DATA).collect()) == variants(rows)


def test_check_sums_are_moved_on():
    rnd = np.random.default_rng(1)
    heads, tails = [bytes(rnd.integers(0, 256, rnd.integers(1, 9), dtype=np.uint8)) for _ in range(200)], [bytes(rnd.integers(0, 256, rnd.integers(0, 63), dtype=np.uint8)) for _ in range(200)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], dtype=np.uint32)
    assert (spelling.check_sums(crc(heads), crc(tails), np.array([len(t) for t in tails])) == crc([h + t for h, t in zip(heads, tails)])).all()


def nearest(rows, k, modulus):
    fine = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in sorted(fine):
        if q % modulus == 0:
            found = sorted((-float(np.dot(x, y)), i) for i, y in fine if i != q and len(y) == len(x))
            out.setdefault(q, []).extend(found)
    return {q: sorted(f)[:k] for q, f in out.items() if f}


def test_nearest_neighbours(spark, monkeypatch):
    """With all cells walked the search is exact: copies, ties, two dimensions, bad vectors, ids with two vectors, blocks and shares of a few rows."""
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.integers(-3, 4, 6)]) for i in range(200)] + [(i, [1.0, 2.0, 0.5, 0.0, 1.0, 1.0]) for i in range(200, 300)] + [(i, [float(i), 1.0]) for i in range(300, 306)]
    rows += [(320, None), (340, []), (360, [0.0] * 6), (380, [None] + [1.0] * 5), (400, [float("nan")] * 6), (420, [float("inf")] * 6), (None, [1.0] * 6), (20, [1.0] * 6), (40, rows[40][1]), (440, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, node int, cell string")
    for block, share in ((1 << 20, 1 << 17), (64, 7)):
        monkeypatch.setattr(multi_index, "BLOCK_BYTES", block)
        monkeypatch.setattr(multi_index, "SHARE", share)
        got = defaultdict(list)
        for r in sorted(multi_index.search(df, 5, 20, share=None).collect()):
            got[r.query_id].append((-r.score, r.vec_id))
        assert got == nearest(rows, 5, 20)
    assert multi_index.search(df.where("false"), 5, 20).count() == 0 and multi_index.search(df.where("vec_id = 440"), 5, 20).count() == 0


@pytest.mark.parametrize("sample", [multi_index.SAMPLE, 300])
def test_recall_of_nearest_neighbours(spark, monkeypatch, sample):
    """The walk by production settings finds nine in ten and more, on clustered and on formless vectors, with a small sample too."""
    monkeypatch.setattr(multi_index, "SAMPLE", sample)
    rnd = np.random.default_rng(3)
    x = np.concatenate([rnd.standard_normal((1500, 32)), rnd.standard_normal((30, 32))[np.arange(1500) % 30] * 2 + 0.4 * rnd.standard_normal((1500, 32))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in multi_index.search(df).collect():
        got[r.query_id].add(r.vec_id)
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    recall = [len(got[q] & set(np.argsort(-scores[q])[:20].tolist())) / 20 for q in range(0, 3000, 20)]
    assert np.mean(recall[:75]) > 0.9 and np.mean(recall[75:]) > 0.9 and all(len(got[q]) == 20 for q in range(0, 3000, 20))


def test_nearest_query_on_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want = nearest(rows, 20, 20)
    got = defaultdict(dict)
    for r in queries.op12_nearest_neighbours(spark, DATA).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(g) == [*range(1, 21)] for g in got.values())
    assert np.mean([len({v for v, _ in got[q].values()} & {i for _, i in want[q]}) / 20 for q in want]) > 0.9


def phrases(rows, least, top, share):
    """Counts of all phrases by lists of words."""
    count = defaultdict(lambda: [Counter(), Counter(), Counter()])
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                count["und" if lang is None else lang][k - 1].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, (one, two, three) in count.items():
        f = one | two | three
        cand = {p: a for p, a in (two | three).items() if a >= least}
        made = []
        for p, a in cand.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= share * a for q, b in cand.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            made.append((-score, -a, " ".join(p).encode(), left, right))
        made.sort()
        out += [(lang, i, p.decode(), -a, left, right, one.total(), -s) for i, (s, a, p, left, right) in enumerate(made[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("bits", [1 << 27, 1 << 10])
def test_collocations(spark, bits):
    """Filters so small that they let everything through change nothing."""
    rnd = random.Random(4)
    vocabulary = ["The", "new", "YORK", "city", "é", "a b", "of", "x" * 70, "\x1c", "hong", "kong", "Ä"]
    rows = [(rnd.choice(["en", "en", "de", None, "und", ""]), "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", " ", "\t", ", ", ".", "\r\n", "\x0b", "  "]) for _ in range(rnd.randrange(80)))) for _ in range(60)]
    rows += [("en", "new york city " * 40), ("en", None), ("fr", ""), ("en", " . , "), ("en", "new york city " * 40)]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(4)
    for least, top in ((3, 2000), (10, 5)):
        assert sorted(tuple(r) for r in collocations.collocations(df, least, top, most_bits=bits).collect()) == phrases(rows, least, top, 50)
    assert collocations.collocations(df.where("false")).count() == 0


def test_collocation_query_equals_sql(spark):
    got = sorted(tuple(r) for r in queries.op13_phrase_collocations(spark, DATA).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert got == sorted(con.execute(queries.oracle_sql()["op13_phrase_collocations"]).fetchall()) and len(got) > 10


def test_equal_partitions():
    """The three-way quicksort finds the runs that a full sort finds, at each depth."""
    rnd = np.random.default_rng(5)
    for n, kinds in ((1, 1), (400, 3), (5000, 40), (5000, 3000)):
        keys = [rnd.integers(0, kinds, n) for _ in range(3)]
        order, heads = collocations.equal_partitions(keys)
        rows = [tuple(k[i] for k in keys) for i in order]
        assert rows == sorted(rows) and sorted(order.tolist()) == [*range(n)]
        for depth in range(3):
            assert heads[depth].tolist() == [i for i in range(n) if i == 0 or rows[i][: depth + 1] != rows[i - 1][: depth + 1]]


def test_filters_deny_nothing_they_hold(spark):
    keys = np.random.default_rng(6).integers(-(2**62), 2**62, 3000)
    df = spark.createDataFrame([(int(k),) for k in keys], "key long")
    roomy, tight = words.Filter(df), words.Filter(df, 1 << 10)
    others = keys ^ 12345
    assert roomy.holds(keys.view(np.uint64)).all() and tight.holds(keys.view(np.uint64)).all() and tight.bits == 1 << 10
    assert roomy.holds(others.view(np.uint64)).mean() < 0.05 and words.Filter(df.where("false")).holds(keys.view(np.uint64)).sum() == 0


@pytest.mark.parametrize("kind, labels", [("double", [1.2, 1.7, 1.2, -0.0, 0.0]), ("string", ["a", "b", "a", "c", "c"]), ("decimal(10,2)", [Decimal("1.25"), Decimal("1.75"), Decimal("1.25"), Decimal(3), Decimal(3)]), ("date", [date(2024, 1, d) for d in (1, 2, 1, 3, 3)]), ("boolean", [True, False, True, None, None])])
def test_labels_of_any_type(spark, kind, labels):
    """Close vectors link where labels are equal as values of their type; decimals and whole numbers are compared as doubles."""
    df = spark.createDataFrame([(i, [1.0, i / 1000], x) for i, x in enumerate(labels)], f"vec_id long, embedding array<double>, label {kind}")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dup.classes(df).collect()}
    last = {3: (0, 3), 4: (0, 4)} if kind == "boolean" else {3: (1, 3), 4: (1, 3)}
    assert got == {0: (1, 0), 1: (0, 1), 2: (1, 0)} | last
    wide = df.selectExpr("vec_id", "transform(embedding, x -> cast(x * 1000000000 + 1 as decimal(20, 0))) AS embedding", "1 AS label")
    assert embedding_dup.classes(wide).where("n_links = 4").count() == 5
