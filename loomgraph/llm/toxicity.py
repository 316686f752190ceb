"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A first bounded sample of labelled documents gives a lexicon: words and word beginnings
that stand in toxic documents far more often than in others. A second one, disjoint from
it, gives rows of dense features (densities of lexicon words, how close they stand to a
second person, capitals, punctuation, obfuscated spellings) for boosted trees. Margins of
trees fitted without a row calibrate the scores. Rows of a class that the bound cuts weigh
as much as all its learning labels, so scores keep to the true shares of the classes
whatever the size of the input. The model is a few thousand numbers; all
documents are scored where they are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import begin, row_function

#: Labelled rows at most for the lexicon, and for the trees, toxic and other each, unless a caller sets others; chosen by a hash of their ids.
LEXICON_ROWS, TREE_ROWS = 2500, 8000
#: Terms of the lexicon at most; least documents with a term; least share of toxic among them (smoothed, classes weighted alike).
TERMS, LEAST_DOCS, LEAST_SHARE = 600, 4, 0.9
#: Lengths of word beginnings taken as terms.
PREFIXES = (4, 5, 6, 7)
#: Pronouns of the second person (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi vous votre vos du dich dir dein deine ihr euch euer tú ti usted ustedes vos vosotros su sus".split())
#: Look-alike characters (fixed values).
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
FEATURES = ("hits", "hit_density", "weight_density", "max_weight", "prefix_density", "hidden_density", "near_second_person", "second_person_density", "capitals", "caps_words", "exclamations", "questions", "punctuation", "mixed_words", "long_runs", "log_words")
_EDGE = ".,!?;:|#$%&*\"'()[]{}<>-_…«»“”"
_RUN = re.compile(r"(.)\1{2,}")
_INNER = re.compile(r"[\W_\d]")
_HIT, _PREFIX, _HIDDEN, _YOU, _CAPS, _MIXED, _RUNS = (1 << k for k in range(7))


def terms(word: str) -> set[str]:
    """What a word counts for in the lexicon: itself, and its beginnings (marked by a star)."""
    w = word.strip(_EDGE).lower()
    return {w, *(f"{w[:n]}*" for n in PREFIXES if len(w) >= n)} if w else set()


class Coder(dict):
    """A word's flags (low 8 bits) and lexicon weight in thousandths, kept for words that repeat."""

    def __init__(self, lexicon: dict[str, float], entries: int = 200_000):
        self.lexicon, self.entries = lexicon, entries

    def __missing__(self, word: str) -> int:
        flags, weight = 0, 0.0
        w = word.strip(_EDGE).lower()
        if w:
            whole = self.lexicon.get(w, 0.0)
            part = max((self.lexicon.get(f"{w[:n]}*", 0.0) for n in PREFIXES if len(w) >= n), default=0.0)
            weight = max(whole, part)
            flags = _HIT * (whole > 0) | _PREFIX * (part > 0) | _YOU * (w in SECOND_PERSON) | _CAPS * (len(w) > 2 and word.upper() == word and word.lower() != word) | _RUNS * bool(_RUN.search(w))
            if not w.isalpha():
                flags |= _MIXED * bool(re.search(r"[^\W\d_][\d@$!*._-]+[^\W\d_]", w))
            if not weight and (flags & (_MIXED | _RUNS) or not w.isalpha()):
                plain = _RUN.sub(r"\1", _INNER.sub("", w.translate(LOOKALIKE)))
                weight = max((self.lexicon.get(t, 0.0) for t in terms(plain)), default=0.0)
                flags |= _HIDDEN * (weight > 0)
        code = flags | int(1000 * weight) << 8
        if len(word) <= 40:
            if len(self) >= self.entries:
                self.clear()
            self[word] = code
        return code


def features(text: str, coder: Coder) -> list[float]:
    """Dense features of a whole text, in the order of FEATURES."""
    words = text.split()
    n = max(1, len(words))
    codes = np.fromiter(map(coder.__getitem__, words), dtype=np.int64, count=len(words))
    flags, weights = codes & 0xFF, (codes >> 8) / 1000
    hit = np.flatnonzero(weights)
    you = np.flatnonzero(flags & _YOU)
    near = 0.0
    if len(hit) and len(you):
        at = np.searchsorted(you, hit)
        gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hit), np.abs(you[np.maximum(at - 1, 0)] - hit))
        near = float((1 / (1 + gap)).max())
    raw = text.encode("utf-8")
    m = max(1, len(raw))
    drop = lambda chars: (len(raw) - len(raw.translate(None, chars))) / m
    share = lambda bit: int(np.count_nonzero(flags & bit)) / n
    return [
        float(len(hit)), len(hit) / n, float(weights.sum()) / n, float(weights.max(initial=0.0)), share(_PREFIX), share(_HIDDEN), near, share(_YOU),
        drop(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(_CAPS), drop(b"!"), drop(b"?"), drop(b".,;:-'\"#$%&*|"), share(_MIXED), share(_RUNS), float(np.log1p(len(words))),
    ]


class Boosted:
    """Logistic gradient boosting with small trees on binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 5, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.penalty = rounds, depth, rate, bins, least, penalty
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        weight = np.ones(len(y)) if weight is None else weight
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)
        share = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree, leaf = self._tree(binned, weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            margin += tree[2][leaf]
        return self

    def _tree(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple, np.ndarray]:
        nodes = 1 << (self.depth + 1)
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        node = np.ones(len(g), dtype=np.int64)
        for level in range(self.depth):
            for k in range(1 << level, 2 << level):
                own = np.flatnonzero(node == k)
                if len(own) < 2 * self.least:
                    continue
                gain, best = 1e-9, None
                total_g, total_h = g[own].sum(), h[own].sum()
                for f in range(binned.shape[1]):
                    b = binned[own, f]
                    n_bins = len(self.edges[f]) + 1
                    sg, sh, sn = (np.cumsum(np.bincount(b, w, n_bins))[:-1] for w in (g[own], h[own], None))
                    if not len(sg):
                        continue
                    ok = (sn >= self.least) & (len(own) - sn >= self.least)
                    got = np.where(ok, sg**2 / (sh + self.penalty) + (total_g - sg) ** 2 / (total_h - sh + self.penalty) - total_g**2 / (total_h + self.penalty), 0)
                    at = int(got.argmax())
                    if got[at] > gain:
                        gain, best = got[at], (f, at)
                if best:
                    feature[k], cut[k] = best[0], self.edges[best[0]][best[1]]
                    node[own] = 2 * k + (binned[own, best[0]] > best[1])
        for k in np.unique(node):
            own = node == k
            value[k] = -self.rate * g[own].sum() / (h[own].sum() + self.penalty)
        return (feature, cut, value), node

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.ones(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + (x[rows, np.maximum(f, 0)] > cut[node]), node)
            out += value[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising function from margins to weighted shares of label 1 (pool adjacent violators)."""
    weight = np.ones(len(y)) if weight is None else weight
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sums of margins, labels and weights
    for m, t, w in zip(margin[order].tolist(), y[order].tolist(), weight[order].tolist()):
        blocks.append([w * m, w * t, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    at = np.array([b[0] / b[2] for b in blocks])
    share = np.array([(b[1] + 0.01) / (b[2] + 0.02) for b in blocks])
    return at, np.maximum.accumulate(share)


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: dict[str, float], trees: Boosted | None, points: tuple[np.ndarray, np.ndarray] | None):
        self.lexicon, self.trees, self.points = lexicon, trees, points

    def scores(self, texts: list[str], coder: Coder) -> np.ndarray:
        if self.trees is None or not texts:
            return np.zeros(len(texts))
        margin = self.trees.margin(np.array([features(t, coder) for t in texts], dtype=np.float64))
        # Between calibrated points in proportion; beyond them and within steps a trace of the margin keeps the order.
        trace = 1 / (1 + np.exp(-margin))
        return np.clip(0.998 * np.interp(margin, *self.points) + 0.002 * trace, 0.0, 1.0)


def held_out(key: Column) -> Column:
    """Rows that never serve for learning: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def _sample(df: DataFrame, labels: DataFrame, half: int, rows: int, text: str, key: str) -> DataFrame:
    """(text, toxic, weight) of at most ``rows`` labelled documents of each class in one half of the learning rows.

    A row's weight is the number of all labels of its class in that half for each label chosen.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    own = known.where(~held_out(F.col("id")) & (F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)) == half))
    few = [own.where(F.col("toxic") == t).orderBy(F.xxhash64("id"), "id").limit(rows) for t in (0, 1)]
    sizes = {r.toxic: r["count"] for r in own.groupBy("toxic").count().collect()}
    chosen = [(r.id, r.toxic, max(1.0, sizes[r.toxic] / rows)) for part in few for r in part.collect()]  # 2 x rows at most
    ids = df.sparkSession.createDataFrame(chosen, "id long, toxic int, weight double")
    return df.select(df[key].cast("long").alias("id"), df[text].alias("text")).join(F.broadcast(ids), "id").select("text", "toxic", "weight")


def fit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", lexicon_rows: int = LEXICON_ROWS, tree_rows: int = TREE_ROWS) -> Model:
    """A model from bounded samples of the labelled documents outside the held-out fold."""
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("other", pa.int64())])

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        by = (Counter(), Counter())
        docs = [0, 0]
        for batch in batches:
            for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                docs[y] += 1
                by[y].update(set().union(*map(terms, set((t or "").split()))))
        names = [*{*by[0], *by[1]}, ""]
        by[0][""], by[1][""] = docs
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([by[1][x] for x in names]), pa.array([by[0][x] for x in names])], schema=schema)

    counted = _sample(df, labels, 0, lexicon_rows, text, key).mapInArrow(count_terms, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).persist()
    sizes = counted.where("term = ''").first()
    n1, n0 = (max(1, sizes.toxic), max(1, sizes.other)) if sizes else (1, 1)
    a, b = (F.col("toxic") + 0.0) / n1, (F.col("other") + 0.5) / n0
    found = counted.where((F.col("term") != "") & (F.col("toxic") >= LEAST_DOCS)).withColumn("share", a / (a + b)).where(F.col("share") >= LEAST_SHARE)
    lexicon = {r.term: float(r.share) for r in found.orderBy(F.desc("toxic"), "term").limit(TERMS).collect()}
    counted.unpersist()

    fields = pa.schema([("x", pa.list_(pa.float64())), ("y", pa.int64()), ("w", pa.float64())])

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        coder = Coder(lexicon)
        return {"x": [features(t or "", coder) for t in batch.column("text").to_pylist()], "y": batch.column("toxic").cast(pa.int64()), "w": batch.column("weight")}

    got = _sample(df, labels, 1, tree_rows, text, key).mapInArrow(row_function(rows, fields, 4096), "x array<double>, y long, w double").collect()
    got.sort(key=lambda r: (r.y, r.x))  # whatever order the rows came in
    x, y = np.array([r.x for r in got], dtype=np.float64).reshape(len(got), len(FEATURES)), np.array([r.y for r in got], dtype=np.float64)
    if len(y) < 20 or y.min() == y.max():
        return Model(lexicon, None, None)
    w = np.array([r.w for r in got])
    w *= len(w) / w.sum()  # one a row on average, and exactly one where no class is cut
    fold = np.arange(len(y)) % 3
    margin = np.empty(len(y))
    for k in range(3):
        margin[fold == k] = Boosted().fit(x[fold != k], y[fold != k], w[fold != k]).margin(x[fold == k])
    return Model(lexicon, Boosted().fit(x, y, w), isotonic(margin, y, w))


def score_documents(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", model: Model | None = None, **bounds: int) -> DataFrame:
    """(key, held_out, score, predicted) of every document.

    Null texts count as empty and get the score of their features. Too few or one-sided
    labels give no model and score 0 everywhere. Labels and columns other than the text
    are no inputs of a score. Equal texts get equal scores. ``model`` may come from an
    earlier ``fit``; else one is made, within ``lexicon_rows`` and ``tree_rows``.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or fit(df, labels, text, key, **bounds))
    schema = pa.schema([("key", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    coders: dict[str, Coder] = {}

    def made(batch: pa.RecordBatch) -> dict[str, object]:
        model = shared.value
        coder = coders.setdefault("own", Coder(model.lexicon))
        begin("toxicity", coder.clear)
        score = model.scores([t or "" for t in batch.column("text").to_pylist()], coder)
        return {"key": batch.column("key"), "held_out": batch.column("held_out"), "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}

    rows = df.select(df[key].cast("long").alias("key"), held_out(df[key]).alias("held_out"), df[text].alias("text"))
    return rows.mapInArrow(row_function(made, schema), "key long, held_out boolean, score double, predicted int").withColumnRenamed("key", key)


def filter_documents(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", limit: float = 0.5, **bounds: int) -> DataFrame:
    """The rows of ``df`` that score below ``limit``, with all their columns; judged as they are read, without a join.

    Null texts count as empty; a row is judged by its own text, whatever its id.
    """
    shared = df.sparkSession.sparkContext.broadcast(fit(df, labels, text, key, **bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        coder = Coder(model.lexicon)
        begin("toxicity", coder.clear)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                score = model.scores([t or "" for t in some.column(text).to_pylist()], coder)
                yield some.filter(pa.array(score < limit))

    return df.mapInArrow(run, df.schema)
