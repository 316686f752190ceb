"""Quality rules: base counts and a hashed n-gram likelihood ratio for every document.

Two multinomials over hashed byte n-grams are counted in one pass over all documents: the
raw corpus, and the trusted target (documents that a label calls good). A document's score
is the sum over its n-grams of log p_target - log p_raw, divided by their number plus a
constant, so that a few n-grams do not decide. Documents below a fixed threshold go.
Counts have a fixed number of buckets; tasks send sums per bucket, never n-grams.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import begin, mix64, row_function

#: Bytes in an n-gram; bits of a bucket number.
NGRAM, BUCKET_BITS = 4, 18
#: Added to the number of n-grams when the score is normalised.
PRIOR_NGRAMS = 40
#: Documents scoring below it are rejected.
THRESHOLD = -0.4
#: Ids of labelled good documents that may be broadcast (8 bytes each); beyond, documents are shuffled to them.
BROADCAST_IDS = 8_000_000
#: Partitions a core in which n-grams are counted, at most: each gives out up to 2^BUCKET_BITS rows.
COUNTING = 16
#: Words of a window for repeats.
WINDOW = 5
#: Base limits (fixed by the contract).
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


def ngram_buckets(joined: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams within documents, and the number of n-grams up to each document's start."""
    a = np.frombuffer(joined, dtype=np.uint8)
    n = len(a) - NGRAM + 1
    if n <= 0:
        return np.empty(0, np.int64), np.zeros(len(starts), np.int64)
    h = a[:n].astype(np.uint32)
    for k in range(1, NGRAM):
        h = (h << np.uint32(8)) | a[k : n + k]
    h *= np.uint32(0x9E3779B1)
    h >>= np.uint32(32 - BUCKET_BITS)
    inside = np.ones(n, dtype=bool)
    for k in range(1, NGRAM):  # an n-gram that starts less than NGRAM bytes before the end of a document leaves it
        at = starts[1:] - k
        inside[at[(at >= 0) & (at < n)]] = False
    before = np.concatenate([[0], np.cumsum(inside)])
    return h[inside].astype(np.int64), before[np.minimum(starts, n)]


def _joined(texts: list[str]) -> tuple[list[bytes], bytes, np.ndarray]:
    raw = [t.encode("utf-8") for t in texts]
    return raw, b"".join(raw), np.cumsum([0, *map(len, raw)])


def _among(keys: pa.Array, ids: np.ndarray) -> np.ndarray:
    """Places of the keys that are among rising ids; null is none of them."""
    if not len(ids):
        return np.empty(0, np.int64)
    k = keys.fill_null(0).to_numpy(zero_copy_only=False)
    return np.flatnonzero((ids[np.minimum(np.searchsorted(ids, k), len(ids) - 1)] == k) & keys.is_valid().to_numpy(zero_copy_only=False))


def corpus_counts(df: DataFrame, trusted: np.ndarray | DataFrame, text: str = "text", key: str = "doc_id") -> np.ndarray:
    """Two rows of counts per bucket over all documents: raw corpus, target.

    ``trusted`` has the ids of the target as ``trusted_ids`` gives them: rising, or a table
    that documents are shuffled to in a second pass.
    """
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])
    few = isinstance(trusted, np.ndarray)
    shared = df.sparkSession.sparkContext.broadcast(trusted if few else np.empty(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
        begin("quality")
        good = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = [t or "" for t in some.column("text").to_pylist()]
                _, joined, starts = _joined(texts)
                h, before = ngram_buckets(joined, starts)
                raw += np.bincount(h, minlength=len(raw))
                hits = _among(some.column("key"), good)
                if len(hits):
                    target += np.bincount(np.concatenate([h[before[i] : before[i + 1]] for i in hits.tolist()]), minlength=len(raw))
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], schema=schema)

    rows = df.select(df[key].cast("long").alias("key"), df[text].alias("text"))
    rows = rows.coalesce(COUNTING * df.sparkSession.sparkContext.defaultParallelism)
    sums = rows.mapInArrow(run, "bucket int, raw long, target long")
    if not few:
        own = rows.join(trusted, F.col("key") == F.col("id"), "left_semi").mapInArrow(run, "bucket int, raw long, target long")
        sums = sums.unionByName(own.select("bucket", F.lit(0).cast("long").alias("raw"), F.col("raw").alias("target")))
    sums = sums.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    out = np.zeros((2, 1 << BUCKET_BITS), dtype=np.float64)
    got = sums.toPandas()  # a row a bucket at most: 2^18
    out[0, got["bucket"]], out[1, got["bucket"]] = got["raw"], got["target"]
    return out


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> np.ndarray | DataFrame:
    """Ids of all documents with quality 1: rising, up to BROADCAST_IDS of them, and a table ``(id)`` beyond."""
    rows = labels.where((F.col("quality") == 1) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id")).distinct()
    if rows.count() > BROADCAST_IDS:
        return rows
    return np.sort(rows.toArrow().column("id").to_numpy())


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw per bucket, both with one count per bucket split by their sizes; 0 without a target."""
    raw, target = counts
    if not target.sum():
        return np.zeros(len(raw), np.float32)
    share = target.sum() / raw.sum()
    p = (target + share) / (target.sum() + share * len(raw))
    return np.log(p / ((raw + 1) / (raw.sum() + len(raw)))).astype(np.float32)


def repeated_words(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per document, the words in windows of five that occur twice or more in the document.

    ``ids`` numbers the words of all documents, ``starts`` where documents begin. Windows
    meet by a 64-bit hash with the document's number; equal hashes are then compared word
    by word, so a collision is not taken for a repeat.
    """
    docs = len(starts) - 1
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(docs, np.int64)
    doc = np.repeat(np.arange(docs), np.diff(starts))
    h = mix64(doc[:n].astype(np.uint64))
    for k in range(WINDOW):
        h = mix64(h + ids[k : n + k].astype(np.uint64) * np.uint64(2 * k + 3))
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    order = at[np.argsort(h[at], kind="stable")]
    hs = h[order]
    same = hs[1:] == hs[:-1]
    if not same.any():
        return np.zeros(docs, np.int64)
    equal = same.copy()
    for k in range(WINDOW):
        equal &= ids[order[1:] + k] == ids[order[:-1] + k]
    repeat = np.zeros(n, dtype=bool)
    if (equal == same).all():
        repeat[order[1:][same]] = True
        repeat[order[:-1][same]] = True
    else:  # hashes collided: compare as tuples
        seen: dict[tuple, list[int]] = defaultdict(list)
        for i in at.tolist():
            seen[(int(doc[i]), *ids[i : i + WINDOW].tolist())].append(i)
        for group in seen.values():
            if len(group) > 1:
                repeat[group] = True
    steps = np.zeros(len(ids) + 1, dtype=np.int64)
    first = np.flatnonzero(repeat)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(steps[:-1]) > 0)])
    return covered[starts[1:]] - covered[starts[:-1]]


def base_counts(texts: list[str], raw: list[bytes]) -> dict[str, np.ndarray]:
    """The contract's counts for each text."""
    words = [b.split() for b in raw]  # bytes split on exactly the contract's separators
    number: dict[bytes, int] = defaultdict(count().__next__)
    starts = np.cumsum([0, *map(len, words)])
    ids = np.fromiter((i for w in words for i in map(number.__getitem__, w)), dtype=np.int64, count=int(starts[-1]))
    n_words = np.diff(starts)
    spaces = np.array([len(b) - len(b.translate(None, _SPACE)) for b in raw], dtype=np.int64)
    dup = []
    for b in raw:
        lines = [x for x in b.split(b"\n") if x.strip(_SPACE)]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": n_words,
        "word_chars": np.array(list(map(len, texts)), dtype=np.int64) - spaces,
        "n_symbols": np.array([len(b) - len(b.translate(None, _SYMBOLS)) for b in raw], dtype=np.int64),
        "n_dup_lines": np.array(dup, dtype=np.int64),
        "n_repeat_words": repeated_words(ids, starts),
    }


COLUMNS = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("score", "double"))


def judged(texts: list[str], ratios: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """Base counts, score and verdict of each text."""
    begin("quality")
    raw, joined, starts = _joined(texts)
    out = base_counts(texts, raw)
    h, before = ngram_buckets(joined, starts)
    sums = np.concatenate([[0.0], np.cumsum(ratios[h], dtype=np.float64)])
    score = (sums[before[1:]] - sums[before[:-1]]) / (np.diff(before) + PRIOR_NGRAMS)
    failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    return out | {"base_failed": failed, "score": score, "kept": ~failed & (score >= threshold)}


def score_documents(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, base counts, base_failed, kept, score) of every document.

    Null texts count as empty; they have no words and fail the base rules. Without good
    labels the ratio is 0 and the base rules alone decide. Repeated rows are judged alike,
    each by itself; columns besides key and text are ignored.
    """
    ratios = df.sparkSession.sparkContext.broadcast(log_ratios(corpus_counts(df, trusted_ids(labels), text, key)))
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([("key", pa.int64()), *((n, kinds[k]) for n, k in COLUMNS)])

    def made(batch: pa.RecordBatch) -> dict[str, object]:
        out = judged([t or "" for t in batch.column("text").to_pylist()], ratios.value, threshold)
        return {"key": batch.column("key")} | {n: pa.array(out[n], kinds[k]) for n, k in COLUMNS}

    rows = df.select(df[key].cast("long").alias("key"), df[text].alias("text"))
    return rows.mapInArrow(row_function(made, schema), "key long, " + ", ".join(f"{n} {k}" for n, k in COLUMNS)).withColumnRenamed("key", key)


def filter_documents(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that the rules keep, with all their columns; judged as they are read, without a join.

    Null texts count as empty and go; a row is judged by its own text, whatever its id.
    """
    ratios = df.sparkSession.sparkContext.broadcast(log_ratios(corpus_counts(df, trusted_ids(labels), text, key)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                kept = judged([t or "" for t in some.column(text).to_pylist()], ratios.value, threshold)["kept"]
                yield some.filter(pa.array(kept))

    return df.mapInArrow(run, df.schema)
