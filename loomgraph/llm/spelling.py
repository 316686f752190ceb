"""Spelling variants by PartEnum signatures.

Words that differ by one inserted, deleted or replaced letter differ little as multisets of
letters: as binary vectors (a dimension for each letter and occurrence) a replacement is at
Hamming distance two and an insertion at distance one. The letters are dealt to parts of
about equal weight. Two vectors at distance two agree in all but two parts, so for words of
equal length a signature is what stands in all parts but two, for each choice of two; at
distance one they agree in all but one part of a coarser partition, which serves words of
neighbouring lengths. Signatures hold the length, are joined by equality, and pairs that meet
are verified letter by letter.

A near pair also agrees, in order, in the half of its letters that the difference spares.
Within a signature only words that share a half are compared; signatures of very many words
are dealt to tasks by that half. Each near pair is told once, under the first signature that
it shares.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.runs import byte_slices, flat, runs, vocabulary
from loomgraph.llm.common import Scratch, begin, mix64, partitions
from loomgraph.llm.words import LOWER

#: Parts of letters for words of equal length, and for neighbouring lengths.
PARTS, COARSE = 5, 2
#: Words under a signature beyond which it is dealt to tasks by halves.
SPLIT = 20_000
#: Rows of whole signatures that a task compares at a time, at least.
ROWS = 200_000
#: Pairs verified at a time.
PAIRS = 1_000_000
#: Lengths whose check sums are moved on by tables; longer words are summed whole.
TABLES = 64

#: The parts that a signature leaves out, for words of equal length.
LEFT_OUT = list(itertools.combinations(range(PARTS), 2))


def _zeros() -> np.ndarray:
    """[length, byte, value]: what a crc32 turns into over so many zero bytes, for each byte of it."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    out = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]]
    for _ in range(TABLES - 1):
        out.append(t[out[-1] & 255] ^ out[-1] >> 8)
    return np.stack(out)


ZEROS = _zeros()


def check_sums(heads: np.ndarray, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of a head followed by a word, from the crc32 of both and the word's bytes (under TABLES)."""
    out = sums.copy()
    for k in range(4):
        out ^= ZEROS[sizes, k, heads >> np.uint32(8 * k) & np.uint32(255)]
    return out


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes of a text in UTF-8 belong to A-Z, a-z or U+00C0 to U+00FF (C3 and the byte after it)."""
    low = data | 32
    inside = (low >= 97) & (low <= 122) & (data < 128) | (data == 0xC3)
    inside[1:] |= data[:-1] == 0xC3
    return inside


def occurrences(docs: DataFrame, modulus: int, least_length: int) -> DataFrame:
    """(word, n) over ``docs(doc_id, text)``: runs of letters, where ``modulus`` divides the check sum of id and run without one letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("spelling")
        for batch in byte_slices(batches):
            data, at = flat(batch.column("text"))
            inside = letters(data)
            data = LOWER[data]
            starts, ends = runs(inside, at)
            if not len(starts):
                continue
            code, words = vocabulary(data, inside, starts, ends)
            told = words.to_pylist()
            text = np.searchsorted(at, starts, side="right") - 1
            ids = [f"{i if i is not None else ''}:".encode() for i in batch.column("doc_id").to_pylist()]
            heads = np.array([zlib.crc32(x) for x in ids], dtype=np.uint32)[text]
            sums = np.array([zlib.crc32(x) for x in told], dtype=np.uint32)
            sizes = np.array([len(x) for x in told])
            long = sizes >= TABLES
            h = check_sums(heads, sums[code], np.where(long, 0, sizes)[code])
            for i in np.flatnonzero(long[code]):
                h[i] = zlib.crc32(ids[text[i]] + told[code[i]])
            hit = np.flatnonzero(h % np.uint32(modulus) == 0)
            n = np.bincount(code, minlength=len(told)) - np.bincount(code[hit], minlength=len(told))
            wide = np.array([len(x) - x.count(b"\xc3") for x in told])
            own = np.flatnonzero((n > 0) & (wide >= least_length))
            cut: Counter[str] = Counter()
            for c, sum_ in zip(code[hit].tolist(), h[hit].tolist()):
                if wide[c] > least_length:
                    word = told[c].decode()
                    k = sum_ % len(word)
                    cut[word[:k] + word[k + 1 :]] += 1
            yield pa.RecordBatch.from_arrays([words.take(pa.array(own)).cast(pa.large_string()).cast(pa.string()), pa.array(n[own])], names=["word", "n"])
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(list(cut), pa.string()), pa.array(list(cut.values()), pa.int64())], names=["word", "n"])

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dealt_letters(words: DataFrame) -> list[np.ndarray]:
    """For each partition the part of each letter (by its code up to 255): the commonest letters apart, parts of about equal weight.

    The driver gets a row a letter, 90 at most.
    """
    seen = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().collect()
    ranked = sorted(((n, ord(c)) for c, n in seen if c and ord(c) < 256), reverse=True)
    out = []
    for parts in (PARTS, COARSE):
        load, own = [0] * parts, np.zeros(256, dtype=np.int64)
        for n, c in ranked:
            own[c] = load.index(min(load))
            load[own[c]] += n
        out.append(own)
    return out


def _latin(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, start of each and the end), a byte each: C3 and its next byte are one letter."""
    data, at = flat(words)
    lead = data == 0xC3
    gone = np.concatenate([[0], np.cumsum(lead)])
    data = np.where(np.concatenate([[False], lead[:-1]]), data | 0x40, data).astype(np.uint8) if len(data) else data
    return data[~lead], at - gone[at]


def _folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each row, by polynomial sums."""
    power = np.uint64(0x9E3779B97F4A7C15) ** np.arange(len(data) + 1, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    back = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)) ** starts.astype(np.uint64)
    return mix64((total[ends] - total[starts]) * back + (ends - starts).astype(np.uint64))


def signatures(words: DataFrame, deal: list[np.ndarray]) -> DataFrame:
    """(sig, which, side, head, tail, word, n): ``which`` numbers the signature, ``side`` is 0 for words of equal length, else 1 for the shorter and 2 for the longer; head and tail are hashes of the halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("spelling")
        for whole in batches:
            for begin_ in range(0, whole.num_rows, 20_000):
                batch = whole.slice(begin_, 20_000)
                data, at = _latin(batch.column("word"))
                s, e = at[:-1], at[1:]
                size = e - s
                value = mix64(data.astype(np.uint64) + np.uint64(77))
                for kind, own in enumerate(deal):
                    part = own[data]
                    held = [np.add.reduceat(np.where(part == p, value, np.uint64(0)), s) for p in range(PARTS if kind == 0 else COARSE)]
                    total = np.sum(held, axis=0, dtype=np.uint64)
                    for side in ((0,), (1, 2))[kind]:
                        base = size - (side == 2)  # the length of the shorter of two
                        half = base // 2
                        head = _folded(data, s, s + half).view(np.int64)
                        tail = _folded(data, s + half + (side == 2), e).view(np.int64)
                        for which, out in enumerate(LEFT_OUT if kind == 0 else [(p,) for p in range(COARSE)]):
                            rest = total.copy()
                            for p in out:
                                rest -= held[p]
                            sig = mix64(rest + mix64((base * 1000 + kind * 100 + which).astype(np.uint64)))
                            const = lambda v: pa.array(np.full(len(s), v, dtype=np.int8))
                            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), const(which), const(side), pa.array(head), pa.array(tail), batch.column("word"), batch.column("n")], names=["sig", "which", "side", "head", "tail", "word", "n"])

    return words.mapInArrow(run, "sig long, which byte, side byte, head long, tail long, word string, n long")


def near_pairs(rows: DataFrame, deal: list[np.ndarray], split: int = SPLIT) -> DataFrame:
    """(word, near, near_n), both ways, of words under a signature that differ by one letter; each pair once each way."""
    large = rows.groupBy("sig").agg(F.count("*").alias("_rows")).where(F.col("_rows") > split).select("sig", F.lit(True).alias("large"))
    dealt = rows.join(large, "sig", "left").withColumn("half", F.explode(F.when(F.col("large"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))))
    key = F.when(F.col("half") == 0, F.col("sig")).otherwise(F.xxhash64("sig", "half", F.when(F.col("half") == 1, F.col("head")).otherwise(F.col("tail"))))
    names = ("key", "which", "side", "half", "head", "tail", "word", "n")
    ready = dealt.withColumn("key", key).withColumn("half", F.col("half").cast("byte")).select(*names).repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("spelling")
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                keys = table.column("key").to_numpy()
                end = int(np.searchsorted(keys == keys[-1], True))  # the last key may go on
                if end:
                    yield from _compared(table.slice(0, end), deal)
                    held = table.slice(end).to_batches()
        if held:
            yield from _compared(pa.Table.from_batches(held).combine_chunks(), deal)

    return ready.mapInArrow(run, "word string, near string, near_n long")


def _compared(table: pa.Table, deal: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Near pairs among rows of whole keys."""
    get = lambda name: table.column(name).to_numpy()
    key, which, side, half, head, tail, n = map(get, ("key", "which", "side", "half", "head", "tail", "n"))
    words = table.column("word").combine_chunks()
    data, at = _latin(words)
    s, size = at[:-1], np.diff(at)
    for number, own_half in ((1, head), (2, tail)):
        rows = np.flatnonzero((half == 0) | (half == number))
        if not len(rows):
            continue
        order = rows[np.lexsort((side[rows], own_half[rows], key[rows]))]
        for a, b in _meetings(order, key, own_half, side):
            same = side[a] == 0
            shared = np.flatnonzero(~same & (head[a] == head[b])) if number == 2 else np.zeros(0, np.int64)
            keep = np.ones(len(a), dtype=bool)
            keep[shared] = False  # an insertion that spares both halves is told by the first
            a, b, same = a[keep], b[keep], same[keep]
            ok = np.zeros(len(a), dtype=bool)
            i = np.flatnonzero(same)
            ok[i] = _replaced(data, s, size, a[i], b[i], which[a[i]], deal[0])
            i = np.flatnonzero(~same)
            ok[i] = _inserted(data, s, size, a[i], b[i], which[a[i]], deal[1])
            a, b = a[ok], b[ok]
            if len(a):
                one, two = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
                yield pa.RecordBatch.from_arrays([words.take(one), words.take(two), pa.array(n[np.concatenate([b, a])])], names=["word", "near", "near_n"])


def _meetings(order: np.ndarray, key: np.ndarray, own_half: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with equal key and half, of equal length or a shorter and a longer word, PAIRS or so at a time.

    ``order`` sorts rows by key, half and side: a row meets the later ones of its run.
    """
    k, h = key[order], own_half[order]
    first = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])])
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(order))[np.cumsum(first) - 1]
    at = np.arange(len(order))
    shorter = side[order] == 1
    # A shorter word meets the longer ones, which stand after all shorter ones of its run.
    longer = np.concatenate([[0], np.cumsum(shorter)])
    begins = np.where(shorter, at + longer[ends] - longer[at], at + 1)
    many = np.where(side[order] == 2, 0, ends - begins)
    total = np.cumsum(many)
    row = 0
    while row < len(order):
        end = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + PAIRS, side="right")))
        count = many[row:end]
        if count.sum():
            left = np.repeat(at[row:end], count)
            right = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begins[row:end], count)
            yield order[left], order[right]
        row = end


def _replaced(data: np.ndarray, s: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, which: np.ndarray, deal: np.ndarray) -> np.ndarray:
    """Which words of equal length differ in one place, and meet under the first signature that leaves out the parts of both letters."""
    ok = np.zeros(len(a), dtype=bool)
    for length in np.unique(size[a]):
        own = np.flatnonzero(size[a] == length)
        unlike, last = np.zeros(len(own), dtype=np.int32), np.zeros(len(own), dtype=np.int64)
        for i in range(length):
            off = data[s[a[own]] + i] != data[s[b[own]] + i]
            unlike += off
            last[off] = i
        one = np.flatnonzero(unlike == 1)
        own, last = own[one], last[one]
        x, y = deal[data[s[a[own]] + last]], deal[data[s[b[own]] + last]]
        ok[own] = which[own] == FIRST[x, y]
    return ok


#: The first signature that leaves out two parts.
FIRST = np.array([[next(k for k, out in enumerate(LEFT_OUT) if p in out and q in out) if p != q else next(k for k, out in enumerate(LEFT_OUT) if p in out) for q in range(PARTS)] for p in range(PARTS)])


def _inserted(data: np.ndarray, s: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, which: np.ndarray, deal: np.ndarray) -> np.ndarray:
    """Which words b are a with one letter more, and meet under the signature that leaves out that letter's part."""
    ok = np.zeros(len(a), dtype=bool)
    for length in np.unique(size[a]):
        own = np.flatnonzero((size[a] == length) & (size[b] == length + 1))
        p, q = s[a[own]], s[b[own]]
        same = np.zeros(len(own), dtype=np.int64)  # letters that agree from the start
        going = np.ones(len(own), dtype=bool)
        for i in range(length):
            going &= data[p + i] == data[q + i]
            same += going
        fits = np.ones(len(own), dtype=bool)
        for i in range(length):
            fits &= (i < same) | (data[p + i] == data[q + i + 1])
        ok[own] = fits & (which[own] == deal[data[q + same]])
    return ok


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of words with a form: the last of the chain, by doubling steps. A form has twice the count at least, so chains are short and without rings."""
    at = scratch.save(forms.select("word", F.col("form").alias("root")), "roots-0")
    turn = 0
    while True:
        turn += 1
        step = at.join(at.select(F.col("word").alias("root"), F.col("root").alias("far")), "root", "left")
        step = scratch.save(step.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), f"roots-{turn}")
        scratch.drop(f"roots-{turn - 1}")
        at = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return at


def variants(docs: DataFrame, least: int = 3, least_length: int = 5, ratio: int = 2, modulus: int = 97, key: str = "doc_id", text: str = "text", split: int = SPLIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of ``least_length`` letters with ``least`` occurrences.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF of whole texts in lower case (A to Z only);
    where ``modulus`` divides the crc32 of ``id:run``, the run loses one letter. A null text has
    no words, a null id is empty in the check sum, and repeated rows count as often as they
    stand. The form is the near word of largest n, ties to the least word, if that n is
    ``ratio`` times the word's; else form and form_n are null and the root is the word itself.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    words = scratch.save(occurrences(rows, modulus, least_length).where(F.col("n") >= least), "words")
    deal = dealt_letters(words)
    sigs = scratch.save(signatures(words, deal), "signatures")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_pairs(sigs, deal, split).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False))
    state = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    state = scratch.save(state, "state")
    scratch.drop("signatures")
    last = roots(state.where("form IS NOT NULL"), scratch)
    return state.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
