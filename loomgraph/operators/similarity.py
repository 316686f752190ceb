"""Text similarity of names: TF-IDF cosines, part likelihoods, candidate pairs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scratch import stored
from loomgraph.functions.text import char_ngrams, clean_entity, clean_parts, edit_ratio, initials, initials_similarity, parts_similarity
from loomgraph.operators.metric import Side, pairs_of_parts, similar_pairs


def tfidf(terms: DataFrame, least_share: float = 0.0) -> DataFrame:
    """(key, term, w) from ``terms(key, term)``: tf * (ln((1 + n) / (1 + df)) + 1), scaled to unit length per key.

    Terms in fewer than ``least_share`` of the keys are left out.
    """
    tf = terms.groupBy("key", "term").agg(F.count("*").alias("tf"))
    n = terms.select("key").distinct().agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).where(F.col("df") >= least_share * F.col("n"))
    idf = df.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(idf, "term").select("key", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = w.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norms, "key").select("key", "term", (F.col("w") / F.col("norm")).alias("w"))


def char_terms(names: DataFrame, key: str, name: str) -> DataFrame:
    return names.select(F.col(key).alias("key"), F.explode(char_ngrams(clean_entity(F.col(name)))).alias("term"))


def word_terms(names: DataFrame, key: str, name: str) -> DataFrame:
    """Lower-case words of two word characters or more."""
    return names.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(F.lower(name), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)).alias("term"))


def candidate_pairs(names: DataFrame, key: str, name: str, above: float = 0.8) -> DataFrame:
    """(a, b, similarity), a < b: pairs whose character cosine is over the limit.

    Exact, as a metric join of dense vectors: an alphabet has no rare characters to index,
    but few of them, so names are points of some dozens of dimensions. Characters in fewer
    than one of 200 names are left out, which bounds the dimensions by 200 times the
    characters of a name.
    """
    w = stored(tfidf(char_terms(names, key, name), 0.005))
    terms = sorted(r["term"] for r in w.select("term").distinct().collect())  # bounded, as above
    place = {t: i for i, t in enumerate(terms)}
    size = len(terms)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, weights = b.column("terms"), b.column("weights").flatten().to_numpy()
            at = np.array([place[t] for t in own.flatten().to_pylist()], dtype=np.int64)
            x = np.zeros((b.num_rows, size))
            x[np.repeat(np.arange(b.num_rows), np.diff(own.offsets.to_numpy())), at] = weights
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * size), pa.array(x.ravel()))], names=["key", "x"])

    entries = w.groupBy("key").agg(F.collect_list(F.struct("term", "w")).alias("e")).select("key", F.col("e.term").alias("terms"), F.col("e.w").alias("weights"))  # characters of one name
    vectors = entries.mapInArrow(dense, f"key {w.schema['key'].dataType.simpleString()}, x array<double>")
    return similar_pairs(vectors, above, "key", "x")


def word_similarity(pairs: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """``pairs(a, b)`` with their word cosine, fitted on the distinct names that occur in pairs; 0 without common words."""
    used = pairs.select(F.col("a").alias(key)).union(pairs.select("b")).distinct()
    w = tfidf(word_terms(names.join(used, key, "left_semi"), key, name))
    own = pairs.select("a", "b")
    sums = own.join(w.toDF("a", "term", "wa"), "a").join(w.toDF("b", "term", "wb"), ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("tfidf"))
    return own.join(sums, ["a", "b"], "left").fillna(0.0, ["tfidf"])


def part_likelihood(names: DataFrame, key: str, name: str) -> DataFrame:
    """(key, likelihood): the mean over a name's parts of the part's share of all parts times its mean connectivity.

    Parts are linked where they stand in one name. A pair of parts in a name counts the
    node-disjoint paths between them, a part that stands twice counts 1 with itself, all
    over the largest such number; a part's connectivity is the mean over its pairs in the
    name. Equal names are one name with the parts of all; a name of a single part has no row.
    """
    from loomgraph.operators.graphs import connectivity, pairs_within
    from loomgraph.operators.windows import shares

    cleaned = names.select(F.col(key).alias("key"), clean_entity(F.col(name)).alias("name"))
    parts = cleaned.select("name", F.explode(clean_parts(F.col("name"))).alias("part"))
    counts = stored(parts.groupBy("name", "part").agg(F.count("*").alias("n")))
    pairs = stored(pairs_within(counts, "name", "part"))
    links = pairs.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")).distinct()
    paths = connectivity(links.toDF("from", "to"), links)
    met = pairs.join(paths.toDF("part_a", "part_b", "paths"), ["part_a", "part_b"]).withColumn("m", F.col("n_a") * F.col("n_b"))
    sides = [met.select("name", F.col(f"part_{s}").alias("part"), "m", "paths") for s in ("a", "b")]
    twice = counts.where("n > 1").select("name", "part", (F.col("n") * (F.col("n") - 1)).alias("m"), F.lit(1).cast("long").alias("paths"))
    every = stored(sides[0].unionAll(sides[1]).unionAll(twice))
    conn = every.groupBy("name", "part").agg((F.sum(F.col("m") * F.col("paths")) / F.sum("m")).alias("conn"))
    scored = conn.join(F.broadcast(every.agg(F.max("paths").alias("top")))).join(shares(parts, "part"), "part")
    likely = scored.groupBy("name").agg(F.avg(F.col("conn") / F.col("top") * F.col("share")).alias("likelihood"))
    return cleaned.join(likely, "name").select("key", "likelihood")


def pairwise_edit_ratio(names: DataFrame, key: str, name: str, above: float = 0.0) -> DataFrame:
    """(a, b, ratio), a < b: pairs of names with a letter in common whose edit ratio is over the limit, 0 or more.

    The ratio of two names is at most that of their lengths, so names stand in parts by
    length and only parts of near lengths meet. Of these the letters that two names share at
    all, as a product of unary counts, bound what they share in order; the pairs that may
    reach the limit are counted in order by bit-parallel sums. Null names and keys have no pairs.
    """
    limit = math.log(2 / above - 1) if above > 0 else math.inf

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("x").to_pylist()
            ring = np.log(np.array([max(1, len(t)) for t in text], dtype=np.float64))
            at = pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32)), pa.array(ring))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(np.zeros(len(text), np.int32)), pa.array((ring * 8).astype(np.int32)), pa.array(ring), at, b.column("x").cast(pa.binary())], names=["key", "g", "cell", "ring", "at", "data"])

    def compare(left: Side, right: Side | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        a = [t.decode() for t in left.data]
        b = a if right is None else [t.decode() for t in right.data]
        size_a, size_b = (np.array([len(t) for t in s], dtype=np.int64) for s in (a, b))
        x, y = unary_counts(a, b)
        for at in range(0, len(a), 128):
            to = min(len(a), at + 128)
            total = size_a[at:to, None] + size_b[None, :]
            may = 2 * (x[at:to] @ y.T) > above * total
            if right is None:
                may &= np.arange(at, to)[:, None] < np.arange(len(b))[None, :]
            i, j = np.nonzero(may)
            shared = common_in_order(a, b, i + at, j)
            ratio = 2.0 * shared / np.maximum(total[i, j], 1)
            keep = ratio > above
            yield i[keep] + at, j[keep], ratio[keep]

    rows = names.select(F.col(key).alias("key"), F.col(name).cast("string").alias("x")).where("key IS NOT NULL AND x IS NOT NULL")
    placed = rows.mapInArrow(place, f"key {rows.schema['key'].dataType.simpleString()}, g int, cell int, ring double, at array<double>, data binary")
    return pairs_of_parts(placed, limit + 1e-9, 1024, 64, compare).withColumnRenamed("similarity", "ratio")


def unary_counts(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """0/1 matrices with a column for each letter and each time it can occur: their product is how many letters two names share."""
    place: dict[tuple[str, int], int] = {}
    rows = []
    for names in (a, b):
        own = []
        for t in names:
            seen: dict[str, int] = {}
            for c in t:
                seen[c] = seen.get(c, 0) + 1
                own.append(place.setdefault((c, seen[c]), len(place)))
        rows.append(own)
    out = []
    for names, own in zip((a, b), rows):
        x = np.zeros((len(names), max(1, len(place))), dtype=np.float32)
        x[np.repeat(np.arange(len(names)), [len(t) for t in names]), own] = 1
        out.append(x)
    return out[0], out[1]


def common_in_order(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of a[i] and b[j] for each pair.

    Bit-parallel: a bit for each letter of a[i], all pairs a letter of b[j] at a time; names of
    over 64 letters take several words, with the carry handed on.
    """
    if not len(i):
        return np.zeros(0, dtype=np.int64)
    codes: dict[str, int] = {}
    used_a, used_b = np.unique(i), np.unique(j)
    words = max(1, -(-max(len(a[k]) for k in used_a) // 64))
    wide = max((len(b[k]) for k in used_b), default=0)
    letters = np.full((len(used_b), max(1, wide)), -1, dtype=np.int64)
    for row, k in enumerate(used_b):
        letters[row, : len(b[k])] = [codes.setdefault(c, len(codes)) for c in b[k]]
    masks = np.zeros((len(used_a), len(codes) + 1, words), dtype=np.uint64)  # the last letter is none
    for row, k in enumerate(used_a):
        for at, c in enumerate(a[k]):
            if c in codes:
                masks[row, codes[c], at >> 6] |= np.uint64(1 << (at & 63))
    ia, jb = np.searchsorted(used_a, i), np.searchsorted(used_b, j)
    v = np.full((words, len(i)), ~np.uint64(0))
    for at in range(wide):
        m = masks[ia, letters[jb, at]]
        carry = np.zeros(len(i), dtype=np.uint64)
        for w in range(words):
            both = v[w] & m[:, w]
            sum_ = v[w] + both
            over = sum_ < both
            sum_ += carry
            over |= sum_ < carry
            v[w] = sum_ | (v[w] & ~m[:, w])
            carry = over.astype(np.uint64)
    return np.bitwise_count(~v).sum(axis=0).astype(np.int64)


#: What a matcher knows of two names.
FEATURES = ("edit", "parts", "initials", "length", "start")


def name_features(a: Column, b: Column) -> list[Column]:
    """FEATURES of two names: edit ratio, part ratio, overlap of initials, ratio of lengths, and whether they begin alike."""
    long = F.greatest(F.length(a), F.length(b), F.lit(1))
    return [edit_ratio(a, b), parts_similarity(a, b), initials_similarity(initials(a), initials(b)), F.least(F.length(a), F.length(b)) / long, (F.substring(a, 1, 2) == F.substring(b, 1, 2)).cast("double")]


def fit_matcher(pairs: DataFrame, a: str = "a", b: str = "b", label: str = "label") -> Callable[[Column, Column], Column]:
    """The probability that two names are of one thing, as a function of two columns: a logistic regression fitted on ``pairs`` labelled 0 or 1.

    Fits over all pairs as Spark jobs; the driver holds a weight a feature.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = pairs.select(array_to_vector(F.array(*(F.coalesce(x.cast("double"), F.lit(0.0)) for x in name_features(F.col(a), F.col(b))))).alias("features"), F.col(label).cast("double").alias("label"))
    fitted = LogisticRegression(regParam=0.001).fit(stored_rows(rows))
    weights, bias = fitted.coefficients.toArray().tolist(), float(fitted.intercept)

    def probability(x: Column, y: Column) -> Column:
        score = F.lit(bias)
        for w, c in zip(weights, name_features(x, y)):
            score += w * F.coalesce(c, F.lit(0.0))
        return 1 / (1 + F.exp(-score))

    return probability


def stored_rows(rows: DataFrame) -> DataFrame:
    """The labelled rows from a table: a fit reads them many times. Vectors have a type of their own, so they are written as arrays."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    kept = stored(rows.select(vector_to_array("features").alias("x"), "label"))
    return kept.select(array_to_vector("x").alias("features"), "label")


def misspelt_pairs(names: DataFrame, name: str) -> DataFrame:
    """(a, b, label): each distinct name with itself less a letter (1), and with the name that follows in an order by hash (0)."""
    n = names.select(F.col(name).alias("a")).where(F.length(name) > 2).distinct()
    at = F.pmod(F.xxhash64("a"), F.length("a").cast("long")).cast("int")
    same = n.select("a", F.concat(F.substring("a", F.lit(1), at), F.substring("a", at + 2, F.length("a"))).alias("b"), F.lit(1).alias("label"))
    from loomgraph.operators.windows import global_ids

    placed = stored(global_ids(n.withColumn("_h", F.xxhash64("a", F.lit(3))), ["_h", "a"], "_i"))
    other = placed.select("a", "_i").join(placed.select(F.col("a").alias("b"), (F.col("_i") - 1).alias("_i")), "_i").select("a", "b", F.lit(0).alias("label"))
    return same.unionByName(other)
