"""Collocations by a multikey quicksort of suffix pointers.

A suffix pointer is a word's place; its keys are the language, the word, and the words that
follow in the same piece. A step of texts orders its pointers by a multikey three-way
quicksort: pointers are dealt by their leading word, then each partition is split about a
pivot by the next word, and only the equal part goes one word deeper. An equal partition is
a phrase and its size the phrase's count in the step; Spark routes these rows by the
phrase's own leading words and adds them up, so a common word's phrases lie in many tasks.

Whole levels are counted over all documents before the next: words first, then pairs of
words (by hash, an upper bound), then phrases. Partitions under the least count are
abandoned before a level goes deeper. What stays is told to the tasks by a filter of bounded
size that may let a rare phrase through but never loses one; counts that decide are of the
phrases themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.runs import byte_slices, flat, hashes, runs, vocabulary
from loomgraph.llm.common import Scratch, begin, mix64, partitions
from loomgraph.llm.words import LOWER, Filter

#: Partitions of so few pointers are finished together by one sort.
SMALL = 24
#: Pairs that a task holds before it adds them up and gives them out; ranges of their hashes for each partition.
HELD, RANGES = 1 << 20, 2
#: Kinds of bytes: of words, between words, between pieces.
KIND = np.zeros(256, dtype=np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
PAIR = np.uint64(0x9E3779B97F4A7C15)


def _deeper(order: np.ndarray, heads: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Orders each partition of ``order`` by one more key, in place; (heads) the starts of its equal partitions.

    All partitions take a step at a time: a pivot each, the middle of three; what is less or
    greater is split again, what is equal is done at this depth.
    """
    ends = np.append(heads[1:], len(order))
    found = [heads[ends - heads == 1]]
    start, size = heads[ends - heads > 1], (ends - heads)[ends - heads > 1]
    little: list[tuple[np.ndarray, np.ndarray]] = []
    while len(start):
        few = size <= SMALL
        little.append((start[few], size[few]))
        start, size = start[~few], size[~few]
        if not len(start):
            break
        ends = np.cumsum(size)
        own = np.repeat(np.arange(len(start)), size)
        shift = np.repeat(start - (ends - size), size)
        place = np.arange(ends[-1]) + shift
        held = order[place]
        k = key[held]
        three = np.sort(np.stack([key[order[start]], key[order[start + size // 2]], key[order[start + size - 1]]]), axis=0)
        pivot = three[1][own]
        less, more = k < pivot, k > pivot
        sums = [np.concatenate([[0], np.cumsum(m)]) for m in (less, ~(less | more), more)]
        counts = [s[ends] - s[ends - size] for s in sums]
        base = [start, start + counts[0], start + counts[0] + counts[1]]
        to = np.empty(len(place), dtype=np.int64)
        for m, s, b in zip((less, ~(less | more), more), sums, base):
            at = np.flatnonzero(m)
            to[at] = (b - s[ends - size])[own[at]] + s[at]
        order[to] = held
        found.append(base[1])
        for b, c in ((base[0], counts[0]), (base[2], counts[2])):
            found.append(b[c == 1])
        start, size = np.concatenate([base[0], base[2]]), np.concatenate([counts[0], counts[2]])
        start, size = start[size > 1], size[size > 1]
    start, size = (np.concatenate(x) for x in zip(*little)) if little else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(start):
        ends = np.cumsum(size)
        own = np.repeat(np.arange(len(start)), size)
        place = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        held = order[place]
        k = key[held]
        by = np.lexsort((k, own)) if len(start) > 1 << 30 or k.max() >= 1 << 32 else np.argsort(own << 32 | k)
        order[place] = held[by]
        k = k[by]
        found.append(place[np.concatenate([[True], (own[1:] != own[:-1]) | (k[1:] != k[:-1])])])
    return np.sort(np.concatenate(found))


def equal_partitions(keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(pointers in order, starts of the equal partitions at each depth) by keys, the first first; keys are not negative."""
    order = np.argsort(keys[0], kind="stable")  # dealt by the leading word
    first = keys[0][order]
    heads = [np.flatnonzero(np.diff(first, prepend=-1))]
    for key in keys[1:]:
        heads.append(_deeper(order, heads[-1], key))
    return order, heads


class Step:
    """Words of one slice of documents: codes, languages, and which word follows in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        data, at = flat(batch.column("text"))
        data = LOWER[data]
        kind = KIND[data]
        inside = kind == 0
        starts, ends = runs(inside, at)
        self.code, self.words = vocabulary(data, inside, starts, ends)
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        text = np.searchsorted(at, starts, side="right")
        self.follows = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])  # word i + 1 stands in the piece of word i
        langs = batch.column("lang").dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy().astype(np.int64)[text - 1]

    def keys(self) -> np.ndarray:
        """A hash of language and word for each place."""
        words, langs = hashes(self.words.to_pylist()), hashes([x.encode() for x in self.langs.to_pylist()])
        return mix64(words[self.code] + mix64(langs)[self.lang])

    def leading(self) -> np.ndarray:
        """Language and word as one number."""
        return self.lang * len(self.words) + self.code


def _table(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over ``docs(text, lang)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("collocations")
        for batch in byte_slices(batches):
            s = Step(batch)
            if len(s.code):
                n = np.bincount(s.leading())
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([s.langs.take(pa.array(at // len(s.words))), s.words.take(pa.array(at % len(s.words))).cast(pa.large_string()).cast(pa.string()), pa.array(n[at])], names=["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def frequent_pairs(docs: DataFrame, words: Filter, least: int) -> DataFrame:
    """(key): hashes of pairs of words that follow each other, both in the filter, with ``least`` occurrences or more together.

    Most pairs are rare, so a row each would be most of the work. Tasks add up what they hold
    and send it packed, a row for each range of hashes; what stands in one range is added up
    after the shuffle, and only hashes that are frequent become rows.
    """
    ranges = RANGES * partitions(docs.sparkSession)

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key)
        key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[heads], np.add.reduceat(n[order].astype(np.int64), heads)

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, n = added(held)
        of = (key % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        of, key, n = of[order], key[order], n[order].astype(np.uint32)  # of one task's step
        heads = np.flatnonzero(np.diff(of, prepend=-1))
        ends = np.append(heads, len(of))
        binary = lambda x, size: pa.Array.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(ends * size), pa.py_buffer(x)]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(of[heads]), binary(key, 8), binary(n, 4)], names=["of", "keys", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("collocations")
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in byte_slices(batches):
            s = Step(batch)
            if len(s.code) < 2:
                continue
            key = s.keys()
            good = words.holds(key)
            at = np.flatnonzero(s.follows & good[:-1] & good[1:])
            if len(at):
                order, heads = equal_partitions([s.leading()[at], s.code[at + 1]])
                p = at[order[heads[1]]]
                held.append((_pair(key[p], key[p + 1]), np.diff(heads[1], append=len(order)).astype(np.uint32)))
            if sum(len(k) for k, _ in held) >= HELD:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("collocations")
        now, held = None, []

        def told() -> pa.RecordBatch:
            key, n = added(held)
            return pa.RecordBatch.from_arrays([pa.array(key[n >= least].view(np.int64))], names=["key"])

        for batch in batches:
            for of, keys, n in zip(batch.column("of").to_pylist(), batch.column("keys"), batch.column("n")):
                if of != now:
                    if held:
                        yield told()
                    now, held = of, []
                held.append((np.frombuffer(keys.as_buffer(), dtype=np.uint64), np.frombuffer(n.as_buffer(), dtype=np.uint32)))
                if len(held) > 256:
                    held = [added(held)]
        if held:
            yield told()

    rows = docs.mapInArrow(run, "of long, keys binary, n binary").repartition(ranges, "of").sortWithinPartitions("of")
    return rows.mapInArrow(frequent, "key long")


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * PAIR + b)


def phrase_counts(docs: DataFrame, words: Filter, pairs: Filter) -> DataFrame:
    """(lang, phrase, words, n): phrases of two and three words whose pairs are all in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("collocations")
        for batch in byte_slices(batches):
            s = Step(batch)
            if len(s.code) < 2:
                continue
            key = s.keys()
            good = words.holds(key)
            two = np.flatnonzero(s.follows & good[:-1] & good[1:])
            two = two[pairs.holds(_pair(key[two], key[two + 1]))]
            if not len(two):
                continue
            goes = np.zeros(len(s.code) + 1, dtype=bool)
            goes[two] = True
            # A third word is part of the keys where the pair that it ends goes on; 0 is none.
            third = np.where(goes[two + 1], s.code[np.minimum(two + 2, len(s.code) - 1)] + 1, 0)
            order, heads = equal_partitions([s.leading()[two], s.code[two + 1], third])
            for depth in (1, 2):
                at, n = order[heads[depth]], np.diff(heads[depth], append=len(order))
                if depth == 2:
                    at, n = at[third[at] > 0], n[third[order[heads[2]]] > 0]
                if len(at):
                    p = two[at]
                    parts = [s.words.take(pa.array(s.code[p + i])) for i in range(depth + 1)]
                    phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
                    yield pa.RecordBatch.from_arrays([s.langs.take(pa.array(s.lang[p])), phrase.cast(pa.large_string()).cast(pa.string()), pa.array(np.full(len(p), depth + 1)), pa.array(n)], names=["lang", "phrase", "words", "n"])

    return docs.mapInArrow(run, "lang string, phrase string, words long, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def scored(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of ``phrases`` by their lowest-scoring cut; all parts stand in the two tables."""
    known = words.select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(phrases.where("words = 2").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")))
    w = F.split("phrase", " ", -1)
    cuts = phrases.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), (F.col("words") - 1).cast("int"))).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice(w, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(w, F.col("k") + 1, F.col("words").cast("int")), " ").alias("rest"))
    both = cuts.join(known.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"]).join(known.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"])
    both = both.withColumn("score", F.expr("CAST(a AS DECIMAL(19, 0)) * a * 1000000 DIV (CAST(l AS DECIMAL(19, 0)) * r)"))
    return both.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def not_inside(phrases: DataFrame, share: int) -> DataFrame:
    """``phrases(lang, phrase, words, n, ...)`` without those that lie in a phrase one word longer with ``share`` percent of their count or more."""
    w = F.split("phrase", " ", -1)
    longer = phrases.where("words = 3").select("lang", F.explode(F.array(F.array_join(F.slice(w, 1, 2), " "), F.array_join(F.slice(w, 2, 2), " "))).alias("phrase"), F.col("n").alias("over")).groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    return phrases.join(longer, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < share * F.col("n"))).drop("over")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50, text: str = "text", lang: str = "lang", most_bits: int = 1 << 27) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two and three words.

    Every text counts whole, a null one is empty; rows without language are ``und``; repeated
    rows count as often as they stand. A phrase counts with ``least`` occurrences or more, scores by
    its lowest cut and goes where a longer phrase holds it and has ``share`` percent of its count.
    ``most_bits`` bounds each of the two filters that tasks get (16 MiB by default). Languages
    without such a phrase have no rows.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    rows = _table(docs, text, lang)
    counted = scratch.save(word_counts(rows), "words")
    total = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    often = counted.where(F.col("n") >= least)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = mix64(b.column("w").to_numpy().view(np.uint64) + mix64(b.column("g").to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    words = Filter(often.select(F.xxhash64("word").alias("w"), F.xxhash64("lang").alias("g")).mapInArrow(keyed, "key long"), most_bits)
    pairs = Filter(scratch.save(frequent_pairs(rows, words, least), "pairs"), most_bits)
    phrases = scratch.save(phrase_counts(rows, words, pairs).where(F.col("n") >= least), "phrases")
    kept = not_inside(phrases, share)
    best = scored(often, phrases).join(kept.select("lang", "phrase"), ["lang", "phrase"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB. Format with least, top and share.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), numbered AS (
  SELECT lang, row_number() OVER () AS p, list_filter(regexp_split_to_array(piece, '[\x20\x09]'), lambda x: x <> '') AS w FROM pieces
), placed AS (
  SELECT lang, p, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM numbered
), followed AS (
  SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM placed WINDOW o AS (PARTITION BY p ORDER BY i)
), grams AS (
  SELECT lang, 1 AS words, w1 AS phrase, count(*) AS f FROM followed GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM followed WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM followed WHERE w3 IS NOT NULL GROUP BY ALL
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE words = 1 GROUP BY lang
), cand AS (
  SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE words > 1 AND f >= {least}
), cuts AS (
  SELECT c.*, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:words], ' ') AS rest FROM cand c, (VALUES (1), (2)) t(k) WHERE k < words
), scores AS (
  SELECT c.lang, c.phrase, c.words, c.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.first JOIN grams y ON y.lang = c.lang AND y.phrase = c.rest
), best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longest FROM cand, (VALUES (1), (2)) t(i) WHERE words = 3 GROUP BY ALL
), ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, score
  FROM best b LEFT JOIN inner_parts i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longest IS NULL OR 100 * i.longest < {share} * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {top}
"""
