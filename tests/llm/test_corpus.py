"""Quality, toxicity, near-duplicates, embeddings, sharding, chat and the pipeline against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat, embedding_dup, near_dup, quality, queries, sharding, toxicity

from .conftest import TEXTS

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(t):
    w = WORDS.findall(t)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, empty, labels):
    rows = quality.score_documents(docs, labels).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == Counter((i, *base(t or "")) for i, t in TEXTS)
    assert all(not r.kept for r in rows if r.base_failed) and quality.score_documents(empty, labels).count() == 0
    rnd = random.Random(0)
    texts = ["\n".join(" ".join(rnd.choice("abc") for _ in range(rnd.randrange(6))) for _ in range(8)) for _ in range(60)]
    raw, _, _ = quality._joined(texts)
    got = quality.base_counts(texts, raw)
    assert [tuple(int(got[n][i]) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for i in range(60)] == [base(t) for t in texts]


def test_quality_ratio(spark):
    d, l = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    good = quality.trusted_ids(l)
    counts = quality.corpus_counts(d, good)
    texts = {r.doc_id: (r.text or "").encode() for r in d.collect()}
    own = np.zeros_like(counts)
    for i, b in texts.items():
        h = quality.ngram_buckets(b, np.array([0, len(b)]))[0]
        assert len(h) == max(0, len(b) - 3)
        own[0] += np.bincount(h, minlength=own.shape[1])
        own[1] += np.bincount(h, minlength=own.shape[1]) * (i in good)
    assert (own == counts).all()
    ratios = quality.log_ratios(counts)
    rows = quality.score_documents(d, l).collect()
    for r in rows[:40]:
        h = quality.ngram_buckets(texts[r.doc_id], np.array([0, len(texts[r.doc_id])]))[0]
        assert r.score == pytest.approx(float(ratios[h].astype(float).sum()) / (len(h) + quality.PRIOR_NGRAMS), abs=1e-6)
    assert {r.doc_id for r in quality.filter_documents(d, l).collect()} == {r.doc_id for r in rows if r.kept}


def test_quality_target_is_whole(spark, monkeypatch):
    """Every trusted document counts, however many there are and by either way to them; null is no id."""
    n = 60_000
    ids = spark.range(n)
    d = ids.selectExpr("id AS doc_id", "concat('text', id % 7) AS text").unionByName(spark.createDataFrame([(None, "text9"), (n, "other"), (5, "again")], "doc_id long, text string"))
    l = ids.selectExpr("id AS doc_id", "1 AS quality").unionByName(spark.createDataFrame([(None, 1), (n, 0), (0, 1)], "doc_id long, quality int"))
    made = [quality.corpus_counts(d, quality.trusted_ids(l))]
    assert made[0][1].sum() == 2 * n + 2 and made[0][0].sum() == 2 * n + 2 + 2 + 2
    monkeypatch.setattr(quality, "BROADCAST_IDS", n - 1)
    made.append(quality.corpus_counts(d, quality.trusted_ids(l)))
    assert (made[0] == made[1]).all()


def test_toxicity(spark, docs, empty, labels):
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert toxicity.score_documents(empty, labels).count() == 0
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in l.collect()}
    got = [(r.score, r.predicted, truth[r.doc_id]) for r in toxicity.score_documents(d.join(l.select("doc_id"), "doc_id", "left_semi"), l).collect() if r.held_out]
    pos, neg = [s for s, _, t in got if t], [s for s, _, t in got if not t]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.9 and sum(p for _, p, t in got if not t) <= 0.02 * len(neg)


def test_toxicity_keeps_class_shares(spark):
    """Bounds that cut the classes unevenly leave verdicts where all labels put them."""
    rnd = random.Random(3)
    rows = [(i, "some plain words " + "!" * (9 * loud), int(rnd.random() < (0.3 if loud else 0.02))) for i in range(4000) for loud in [i % 3 == 0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    made = [toxicity.score_documents(df.drop("toxic"), df.drop("text"), tree_rows=bound).toPandas() for bound in (8000, 60)]
    assert not made[0].predicted.any() and not made[1].predicted.any()
    assert abs(made[0].score.mean() - made[1].score.mean()) < 0.05 and abs(made[1].score.mean() - np.mean([t for *_, t in rows])) < 0.05


def plain_features(text, lexicon):
    """Features word by word, from their names."""
    import math

    edge = ".,!?;:|#$%&*\"'()[]{}<>-_…«»“”"
    looks = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
    starts = lambda w: [f"{w[:n]}*" for n in (4, 5, 6, 7) if len(w) >= n]
    words = text.split()
    weights, prefix, hidden, you, caps, mixed, runs = [], 0, 0, [], 0, 0, 0
    for at, raw in enumerate(words):
        w = raw.strip(edge).lower()
        part = max([lexicon.get(t, 0) for t in starts(w)], default=0)
        weight = max(lexicon.get(w, 0), part) if w else 0
        is_mixed, is_run = bool(re.search(r"[^\W\d_][\d@$!*._-]+[^\W\d_]", w)), bool(re.search(r"(.)\1\1", w))
        prefix += part > 0
        you += [at] * (w in toxicity.SECOND_PERSON)
        caps += len(w) > 2 and raw == raw.upper() and raw != raw.lower()
        mixed, runs = mixed + is_mixed, runs + is_run
        if w and not weight and (is_run or not w.isalpha()):
            bare = re.sub(r"(.)\1{2,}", r"\1", re.sub(r"[\W_\d]", "", "".join(looks.get(c, c) for c in w))).strip(edge)
            weight = max([lexicon.get(t, 0) for t in [bare, *starts(bare)] if bare], default=0)
            hidden += weight > 0
        weights.append(int(1000 * weight) / 1000)
    n, size = max(1, len(words)), max(1, len(text.encode()))
    hits = [i for i, w in enumerate(weights) if w]
    near = max([1 / (1 + abs(i - j)) for i in hits for j in you], default=0)
    share = lambda chars: sum(c in chars for c in text) / size
    out = [len(hits), len(hits) / n, sum(weights) / n, max(weights, default=0), prefix / n, hidden / n, near, len(you) / n]
    return [*out, share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), caps / n, share("!"), share("?"), share(".,;:-'\"#$%&*|"), mixed / n, runs / n, math.log(1 + len(words))]


def plain_score(x, model):
    """Trees walked from their roots, then the line between calibrated points."""
    import math

    margin = model.trees.base
    for feature, cut, value in model.trees.trees:
        node = 1
        for _ in range(model.trees.depth):
            if feature[node] >= 0:
                node = 2 * node + (x[feature[node]] > cut[node])
        margin += value[node]
    at, share = model.points
    if margin <= at[0] or margin >= at[-1]:
        level = share[0] if margin <= at[0] else share[-1]
    else:
        k = next(k for k in range(len(at)) if at[k] > margin)
        level = share[k - 1] + (share[k] - share[k - 1]) * (margin - at[k - 1]) / (at[k] - at[k - 1])
    return min(1.0, max(0.0, 0.998 * level + 0.002 / (1 + math.exp(-margin))))


def test_toxicity_scores_by_hand(spark, docs, empty):
    """All documents, the hard ones too, scored word by word and tree by tree under one fitted model."""
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(d, l)
    assert model.trees is not None and model.lexicon
    rows = d.select("doc_id", "text").unionByName(docs.select("doc_id", "text")).unionByName(spark.createDataFrame([(i, t) for i, t in enumerate([*list(model.lexicon)[:5], "YOU ARE " + next(iter(model.lexicon)).upper() + "!!!", "st0000p 1d10t", "word " * 30_000])], "doc_id long, text string"))
    texts = sorted({r.text or "" for r in rows.collect()})
    numbered = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score_documents(numbered, l, model=model).collect()}
    for i, t in enumerate(texts):
        x = plain_features(t, model.lexicon)
        assert toxicity.features(t, toxicity.Coder(model.lexicon)) == pytest.approx(x, abs=1e-12), t[:80]
        want = plain_score(x, model)
        assert got[i] == (pytest.approx(want, abs=1e-9), int(got[i][0] >= 0.5))
    assert toxicity.score_documents(empty, l, model=model).count() == 0


def test_trees_and_isotonic():
    rnd = np.random.default_rng(0)
    x = rnd.random((600, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] > 0.3)).astype(float)
    assert ((toxicity.Boosted().fit(x, y).margin(x) > 0) == (y > 0)).mean() > 0.97
    at, share = toxicity.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 1.0]))
    assert (np.diff(at) > 0).all() and (np.diff(share) >= 0).all()


def plain_classes(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = [x for x in re.split(rb"[\x20\x09-\x0d]+", t.encode().lower()) if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies():
    """A chain, a large loose group, exact copies, short and blank texts."""
    rnd = random.Random(5)
    word = lambda: "w" + str(rnd.randrange(10_000))
    texts = []
    for _ in range(6):
        first = [word() for _ in range(60)]
        for _ in range(5):
            texts.append(" ".join(first))
            first[rnd.randrange(60)] = word()
    common = [word() for _ in range(80)]
    for _ in range(60):
        own = list(common)
        for _ in range(rnd.randrange(1, 7)):
            own[rnd.randrange(80)] = word()
        texts.append(" ".join(own))
    texts += [texts[0]] * 4 + [texts[3].upper()] + ["a", "A", "a b", "", " ", "zz"] + [" ".join(word() for _ in range(30)) for _ in range(30)]
    return list(enumerate(texts))


@pytest.mark.parametrize("k, percent", [(2, 80), (5, 80), (2, 60)])
def test_near_dup(spark, k, percent):
    texts = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.classes(spark.createDataFrame(texts, "doc_id long, text string"), k, percent).collect()}
    assert got == plain_classes(texts, k, percent)


@pytest.mark.parametrize("bounds", [{"SKETCH_BLOCK": 8, "PER_BLOCK": 0, "PER_DOC": 0, "BLOCK_DOCS": 8, "BROADCAST_ROWS": 0, "PER_HUB": 3}, {"SKETCH_BLOCK": 16, "PER_DOC": 1 << 30}])
def test_near_dup_far_side_of_bounds(spark, monkeypatch, bounds):
    """Blocks, forests, shuffled texts and split hubs give the classes that small tables get without them."""
    for name, v in bounds.items():
        monkeypatch.setattr(near_dup, name, v)
    texts = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.classes(spark.createDataFrame(texts, "doc_id long, text string"), 2, 80).collect()}
    assert got == plain_classes(texts, 2, 80)


@pytest.mark.parametrize("percent", [50, 60])
def test_near_dup_finds_pairs_at_threshold(spark, percent):
    """Pairs that reach the threshold exactly, in a table of their own words."""
    rows, n = [], 400
    for p in range(n):
        words = [f"{p}w{i}" for i in range(100)]
        half = (100 - percent) // 2
        rows += [(2 * p, " ".join(words[: 100 - half])), (2 * p + 1, " ".join(words[half:]))]
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string"), 1, percent).where("not kept").count()
    assert got >= 0.99 * n


def test_near_dup_refuses_thresholds_it_cannot_find(docs):
    for percent in (29, 101):
        with pytest.raises(ValueError):
            near_dup.classes(docs, percent=percent)


def test_near_dup_repeated_id(spark):
    """A repeated id with another text keeps a row and a set for each; links go by text."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.classes(spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (None, a)], "doc_id long, text string"), 2, 80).collect() if r.doc_id)
    assert rows == [(1, 29, 1), (1, 29, 1), (2, 29, 1), (3, 29, 1)]


def test_near_dup_hard_rows(docs, empty):
    rows = near_dup.classes(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in TEXTS)
    assert all(r.kept and r.component_id == r.doc_id for r in rows)
    assert near_dup.classes(empty).count() == 0


def test_sketch_estimates():
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.unique(np.concatenate([a[:300], rnd.integers(0, 2**63, 50, dtype=np.uint64)]))
    a = np.unique(a)
    x, y = near_dup.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    j = near_dup.likeliest(*(np.array([float(v)]) for v in ((x > y).sum(), (x < y).sum(), (x == y).sum(), len(a), len(b))))
    assert j[0] == pytest.approx(300 / 450, abs=0.12)
    both = near_dup.registers(np.unique(np.concatenate([a, b])), np.array([0, len(np.unique(np.concatenate([a, b])))]))[0]
    assert (both == np.maximum(x, y)).all()  # mergeable


@pytest.mark.parametrize("number, tile", [("float", 512), ("double", 8)])
def test_embeddings(spark, monkeypatch, number, tile):
    """As all pairs, with few pairs of tiles and with nearly all hits in whole pairs of tiles; a repeated id has a row each."""
    monkeypatch.setattr(embedding_dup, "TILE", tile)
    monkeypatch.setattr(embedding_dup, "DENSE", tile)
    monkeypatch.setattr(embedding_dup, "CELL_ROWS", 4 * tile)
    rnd = np.random.default_rng(2)
    rows = []
    for g in range(12):
        c = rnd.standard_normal(64)
        for _ in range(25):
            rows.append((len(rows), (c + rnd.standard_normal(64) * 0.1 * rnd.random()).astype("f4" if number == "float" else "f8").tolist(), g % 3))
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(3)]
    rows += [(len(rows), [2 * x for x in rows[0][1]], 0), (len(rows) + 1, rows[0][1], 1), (len(rows) + 2, rows[0][1], None), (len(rows) + 3, None, 0), (len(rows) + 4, [0.0] * 64, 0), (len(rows) + 5, [float("nan")] * 64, 0), (len(rows) + 6, [1.0, None], 0), (len(rows) + 7, [], 0), (len(rows) + 8, [1.0, 2.0], 0), (len(rows) + 9, [1.0, 2.01], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{number}>, label int, node string, copies long")
    ok = [i for i, (_, e, l) in enumerate(rows) if l is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], "f4" if number == "float" else "f8").astype(float) for k in (i, j))
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                    n[i] += 1
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dup.classes(df).collect()}
    assert got == {i: (n[i], find(i), find(i) == i) for i in range(len(rows))}
    assert embedding_dup.classes(df.where("false")).count() == 0
    twice = spark.createDataFrame([(5, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (6, [1.0, 0.001], 0), (None, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    if number == "float":
        assert Counter((r.vec_id, r.n_links, r.component_id) for r in embedding_dup.classes(twice).collect()) == {(5, 1, 5): 1, (5, 0, 5): 1, (6, 1, 5): 1, (None, 0, None): 1}


def test_sharding(spark, docs, empty):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    for limit in (2_000, 50_000):
        got = sharding.assign_shards(spark.read.parquet(f"{DATA}/documents.parquet"), limit).toPandas()
        want = con.execute(sharding.SQL.format(limit=limit)).df()
        cols = sorted(want.columns)
        assert got[cols].sort_values("doc_id").astype("int64").values.tolist() == want[cols].sort_values("doc_id").astype("int64").values.tolist()
        assert (got.groupby("shard_id").n_bytes.sum() == got.groupby("shard_id").shard_bytes.first()).all()
        assert ((got.shard_bytes <= limit) | (got.shard_docs == 1)).all()
    assert sharding.assign_shards(docs, 10).count() == len(TEXTS) and sharding.assign_shards(empty, 10).count() == 0


def test_sharding_keeps_names_and_writes(spark, docs, tmp_path):
    """Columns named like those of the operator do not get into it; written shards hold every row once."""
    clash = docs.withColumn("cell", F.lit("x")).withColumn("h", F.lit(1)).withColumn("shard_id", F.lit("y")).withColumn("n_bytes", F.lit("z"))
    rows = sharding.assign_shards(clash, 10).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in rows) == Counter((i, len((t or "").encode())) for i, t in TEXTS)
    kept = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    sharding.write_shards(kept, str(tmp_path / "shards"), 50_000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert {(r.doc_id, r.text, r.node) for r in back.collect()} == {(r.doc_id, r.text, r.node) for r in kept.collect()}


def test_filters_keep_hard_rows(spark, docs, empty):
    """Filters of whole rows judge nulls, repeats and clashing columns as the scores do, and give nothing for nothing."""
    l = spark.read.parquet(f"{DATA}/labels.parquet")
    d = docs.unionByName(spark.read.parquet(f"{DATA}/documents.parquet"), allowMissingColumns=True)
    for module, verdict in ((quality, lambda r: r.kept), (toxicity, lambda r: r.score < 0.5)):
        kept = module.filter_documents(d, l)
        assert kept.columns == d.columns and module.filter_documents(empty, l).count() == 0
        assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in module.score_documents(d, l).collect() if verdict(r))


def test_escape():
    rnd = random.Random(0)
    for _ in range(3000):
        s = "".join(rnd.choice([*"<s>/[]\\INST ", *chat.CONTROL, "</s", "[/INST"]) for _ in range(rnd.randrange(12)))
        e = chat.escape(s)
        assert chat.unescape(e) == s and not any(c in e for c in chat.CONTROL)


def test_chat_formats_all_conversations(spark):
    """Every conversation of a table against the template written out."""
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(queries.CONTROL_ROWS, "conv_id long, turn long, role string, text string"))
    turns = defaultdict(list)
    for r in rows.collect():
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, t in turns.items():
        t = [(role, text) for _, role, text in sorted(t)]
        loss = "".join(text for role, text in t if role == "assistant")
        plain = "<s>" + "".join(f"[INST]{chat.escape(role)}[/INST]{chat.escape(text)}</s>" for role, text in t)
        want[c] = (len(t), sha("".join(f"{role}\n{text}\n" for role, text in t)), len(loss), sha(loss), len(plain))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.conversation_digests(chat.format_turns(rows)).collect()}
    assert got == want and len(want) > 20


def test_chat(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "<|endoftext|> é"), (2, 0, None, None), (2, 1, "assistant", None), (2, 1, "assistant", "x"), (None, 0, "user", "n"), *queries.CONTROL_ROWS]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, ids long")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(df)).collect()}
    assert set(got) == {1, 2, None, -1}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in ((1, [("user", "<|endoftext|> é"), ("assistant", "b</s>")]), (-1, [r[2:] for r in queries.CONTROL_ROWS])):
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    plain = "<s>" + "".join(f"[INST]{r}[/INST]{chat.escape(t)}</s>" for _, _, r, t in queries.CONTROL_ROWS)
    assert got[-1].formatted_chars == len(plain) and got[2].n_turns == 3 and got[2].loss_chars == 1
    assert chat.conversation_digests(chat.format_turns(df.where("false"))).count() == 0


def test_pipeline_hard_rows(spark, docs, empty, labels, tmp_path, monkeypatch):
    """Nulls, repeats, clashing columns and an empty table go through every stage; ids that are many are shuffled."""
    cp = pytest.importorskip("corpus_pipeline")
    labels.withColumn("quality", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(cp, "BROADCAST_IDS", 0)
    prose = " ".join(f"word{i}" for i in range(40))
    good = docs.where("doc_id = 3").withColumn("text", F.lit(prose))
    more = docs.unionByName(good.withColumn("doc_id", F.explode(F.array(*map(F.lit, (20, 21, 21, None))).cast("array<long>"))))
    for name, table in (("hard", more), ("none", empty)):
        at = table
        for k, (_, stage) in enumerate(cp.STAGES):
            stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}{k}")
            made = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert k == len(cp.STAGES) - 1 or made.columns == docs.columns
            at = made
        assert Counter(r.doc_id for r in at.collect()) == ({20: 1, None: 1} if name == "hard" else {})
    twice = docs.where("doc_id in (4, 7)").withColumn("text", F.lit("one two three four five six seven eight nine ten"))
    assert {r.doc_id for r in cp.near_duplicates(spark, twice, str(tmp_path)).collect()} == {4}


def test_pipeline(spark, tmp_path):
    """Each stage decides as its operator does on its own input; a small run gives whole pieces."""
    cp = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (name, stage) in enumerate(cp.STAGES[:3]):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        made = spark.read.parquet(f"{tmp_path}/{k}")
        kept = {r.doc_id for r in made.select("doc_id").collect()}
        assert made.columns == docs.columns and kept <= {r.doc_id for r in docs.select("doc_id").collect()}
        if k == 2:
            want = plain_classes([(r.doc_id, r.text or "") for r in docs.collect()], 5, 80)
            assert kept == {i for i, (_, c) in want.items() if c == i}
        docs = made
    pieces = cp.packed(spark, docs, DATA).collect()
    assert {r.doc_id for r in pieces} == kept
