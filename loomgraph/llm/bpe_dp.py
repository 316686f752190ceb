"""BPE by dynamic programming over prefixes: exact ids, exact counts, and decoding.

For a word and every prefix of it there is exactly one token that can end the prefix's
encoding. An Aho-Corasick automaton over the vocabulary lists the tokens that end at each
position (what a suffix automaton of the vocabulary would list, in one pass over the
word); a token is the right one if it is compatible with the last token of the prefix
before it, that is, if merging would leave the two side by side. Following the stored
tokens back from the end gives the ids; each prefix also stores its count, one more than
that of the prefix that its last token leaves.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.common import begin, row_function, text_column
from loomgraph.llm.vocab import Words, byte_alphabet, default_path, is_plain

#: Entries of the table of pairs whose compatibility is known.
PAIR_ENTRIES = 400_000


class PrefixBPE:
    """The vocabulary's automaton, its merges read backwards, and the per-prefix table of a word."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.letters = byte_alphabet()
        rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right
        for n, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if (left, right) not in rank:
                rank[left, right], self.made[left, right] = n, whole
                self.parts.setdefault(whole, (n, left, right))
        self.rank = rank
        self.known: dict[int, bool] = {}
        self.text = {i: s for s, i in vocab.items()}
        self.size = {i: len(s) - len(self.end) * (bool(self.end) and s.endswith(self.end) and len(s) > len(self.end)) for i, s in self.text.items()}
        # A token takes part if merging its own letters gives it back.
        self.automaton = ahocorasick.Automaton()
        inner: dict[str, int] = {}
        final: dict[str, int] = {}
        for s, i in vocab.items():
            is_final = bool(self.end) and s.endswith(self.end) and len(s) > len(self.end)
            if i in self.parts or len(s) == 1 or (is_final and len(s) == len(self.end) + 1):
                if not self._whole(i):
                    continue
                (final if is_final else inner)[s[: -len(self.end)] if is_final else s] = i
        self.single = frozenset(final)  # words that are one token
        for s in {*inner, *final}:
            self.automaton.add_word(s, (len(s), inner.get(s, -1), final.get(s, -1)))
        self.automaton.make_automaton()

    def _whole(self, token: int) -> bool:
        """Whether merging keeps the token's two halves apart until it joins them last."""
        if token not in self.parts:
            return True
        n, left, right = self.parts[token]
        return self._whole(left) and self._whole(right) and self._apart(left, right, n)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stand side by side in the encoding of their joined text."""
        key = left << 32 | right
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= PAIR_ENTRIES:
                self.known.clear()
            got = self.known[key] = self._apart(left, right, len(self.rank) + 1)
        return got

    def _apart(self, left: int, right: int, before: int) -> bool:
        """Whether no merge crosses the border before merge number ``before``.

        Both sides are taken apart again, the later merge first; what then touches the
        border is what stood there just before that merge. A crossing merge would have
        been done if it comes earlier than the merges that formed both sides since (at
        equal number the left one goes first).
        """
        limit_left = limit_right = before
        while True:
            crossing = self.rank.get((left, right))
            if crossing is not None and crossing < limit_left and crossing <= limit_right:
                return False
            n_left = self.parts[left][0] if left in self.parts else -1
            n_right = self.parts[right][0] if right in self.parts else -1
            if n_left < 0 and n_right < 0:
                return True
            if n_left >= n_right:
                if n_left == n_right:  # the leftmost goes first, so the right one arose last
                    limit_right = n_right
                    right = self.parts[right][1]
                else:
                    limit_left, limit_right = n_left, min(limit_right, n_left)
                    left = self.parts[left][2]
            else:
                limit_left = min(limit_left, n_right + 1)
                limit_right = n_right
                right = self.parts[right][1]

    def mapped(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode("utf-8")])

    def table(self, mapped: str) -> tuple[list[int], list[int], list[int], list[int]]:
        """For each prefix length: last inner token, its count, last token if the word ends there, its count."""
        n = len(mapped)
        last, count, final, total = [-1] * (n + 1), [0] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        known, compatible = self.known, self.compatible
        for end, (size, inner, closing) in self.automaton.iter(mapped):
            i = end + 1
            at = i - size
            before = last[at]
            if at and before < 0:
                continue
            if inner >= 0 and last[i] < 0 and (not at or (known[k] if (k := before << 32 | inner) in known else compatible(before, inner))):
                last[i], count[i] = inner, count[at] + 1
            if closing >= 0 and final[i] < 0 and (not at or (known[k] if (k := before << 32 | closing) in known else compatible(before, closing))):
                final[i], total[i] = closing, count[at] + 1
        return last, count, final, total

    def back(self, mapped: str) -> tuple[list[int], list[int], int, int]:
        """The last inner token and the count of every proper prefix, the token that ends the word, and the word's count.

        The table without the entries for words that end at an earlier prefix.
        """
        n = len(mapped)
        last, count, ends = [-1] * (n + 1), [0] * (n + 1), []
        known, compatible = self.known, self.compatible
        for end, (size, inner, closing) in self.automaton.iter(mapped):
            i = end + 1
            if i == n:
                if closing >= 0:
                    ends.append((n - size, closing))
            elif inner >= 0 and last[i] < 0:
                at = i - size
                if at:
                    before = last[at]
                    if before < 0 or not (known[k] if (k := before << 32 | inner) in known else compatible(before, inner)):
                        continue
                last[i], count[i] = inner, count[at] + 1
        for at, closing in ends:
            if not at or (last[at] >= 0 and compatible(last[at], closing)):
                return last, count, closing, count[at] + 1
        raise ValueError(f"no encoding of {mapped!r}")

    def ids(self, word: str) -> list[int]:
        """The word's ids, read along the back-pointers."""
        mapped = self.mapped(word)
        last, _, closing, _ = self.back(mapped)
        out, at = [closing], len(mapped) - self.size[closing]
        while at > 0:
            out.append(last[at])
            at -= self.size[last[at]]
        return out[::-1]

    def count(self, word: str) -> int:
        """The token count of the whole word: one more than that of the prefix before its last token."""
        mapped = self.mapped(word)
        return 1 if mapped in self.single else self.back(mapped)[3]

    def prefix_counts(self, word: str) -> list[int]:
        """The exact token count of every prefix of the word, by code points, from 1 on."""
        total = self.table(self.mapped(word))[3]
        out, at = [], 0
        for c in word:
            at += len(c.encode("utf-8"))
            out.append(total[at])
        return out


@functools.lru_cache(maxsize=2)
def prefix_bpe(path: str) -> PrefixBPE:
    return PrefixBPE(path)


def dp_encoder(path: str) -> Words:
    """Ids of whole texts as little-endian unsigned 32-bit integers, by the prefix table."""
    begin("dp", _dp_encoder.cache_clear)
    return _dp_encoder(path)


@functools.lru_cache(maxsize=1)
def _dp_encoder(path: str) -> Words:
    bpe = prefix_bpe(path)
    return Words(path, lambda w: np.array(bpe.ids(w), dtype="<u4").tobytes(), lambda i: int(i).to_bytes(4, "little"))


@functools.lru_cache(maxsize=2)
def strings(path: str) -> list[str]:
    """The string of every id, added tokens included."""
    bpe = prefix_bpe(path)
    with open(path, encoding="utf-8") as f:
        table = bpe.text | {x["id"]: x["content"] for x in json.load(f)["added_tokens"]}
    return [table.get(i, "") for i in range(max(table) + 1)]


def decode(ids: np.ndarray, path: str) -> str:
    """As the library's decode without a decoder: the tokens' strings with spaces between."""
    return " ".join(map(strings(path).__getitem__, ids.tolist()))


def encode_decode(df: DataFrame, tokenizer: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded) of every whole text; null counts as empty, which has no ids and decodes to ''.

    Rows stay where they are read: no shuffle. Other columns, repeated keys and ties are of
    no consequence, each row is encoded by itself.
    """
    path = tokenizer or default_path()
    schema = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def made(batch: pa.RecordBatch) -> dict[str, object]:
        encode = dp_encoder(path)
        ids = [np.frombuffer(encode(t), dtype="<u4") for t in text_column(batch)]
        sizes = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        flat = np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32)
        return {"key": batch.column("key"), "ids": pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)), "decoded": [decode(x, path) for x in ids]}

    out = df.select(df[key].cast("long").alias("key"), df[text].alias("text")).mapInArrow(row_function(made, schema, 128), "key long, ids array<int>, decoded string")
    return out.withColumnRenamed("key", key)


def encode_decode_digests(df: DataFrame, tokenizer: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As ``encode_decode``, with counts and digests of ids and decoded text in place of both."""
    path = tokenizer or default_path()
    schema = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def made(batch: pa.RecordBatch) -> dict[str, object]:
        encode = dp_encoder(path)
        n, a, b = [], [], []
        for t in text_column(batch):
            raw = encode(t)
            n.append(len(raw) // 4)
            a.append(hashlib.sha256(raw).hexdigest())
            b.append(hashlib.sha256(decode(np.frombuffer(raw, dtype="<u4"), path).encode("utf-8")).hexdigest())
        return {"key": batch.column("key"), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    out = df.select(df[key].cast("long").alias("key"), df[text].alias("text")).mapInArrow(row_function(made, schema), "key long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)


def _summed(counts: bytes) -> bytes:
    return counts if len(counts) == 4 else int(np.frombuffer(counts, dtype="<u4").sum()).to_bytes(4, "little")


#: Chunks as the tokenizer splits them: between white space, which U+001C to U+001F are not.
_CHUNKS = re.compile(r"[\S\x1c-\x1f]+")


@functools.lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters that normalising may join with the one before: combining marks apart, the second halves of canonical compositions."""
    halves = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000) if not 0xAC00 <= c < 0xD7A4)
    second = {chr(int(h[1], 16)) for h in halves if len(h) == 2 and not h[0].startswith("<")}
    return frozenset(second | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})  # and Hangul vowels and finals


class PrefixCounts:
    """Token counts at every prefix of a text, from the per-prefix tables of its words.

    ``total(text)`` is the whole count. ``at_prefixes(text)`` lists the count of every
    prefix of the normalised text. ``longest_within(text, budget)`` is the length of the
    longest prefix of the text within a budget; the text is not encoded again for it.
    """

    def __init__(self, path: str):
        self.bpe = prefix_bpe(path)
        #: Characters that a token can stand for: its letters, of which normalising may join four to one.
        self.reach = 4 * max(self.bpe.size.values())
        self.words = Words(path, lambda w: self.bpe.count(w).to_bytes(4, "little"), lambda i: (1).to_bytes(4, "little"), _summed)

    def counts(self, word: str) -> list[int]:
        if word[:1] == "'" and len(word) == 3 and word in ("'re", "'ve", "'ll"):
            # The prefixes of these are other words: an apostrophe, then a letter.
            return [1, 2, self.bpe.prefix_counts(word)[-1]]
        return self.bpe.prefix_counts(word)

    def per_chunk(self, text: str) -> np.ndarray:
        """Counts of the white-space-separated chunks; of words and special strings where chunks alone don't do."""
        return np.frombuffer(self.words(text), dtype="<u4")

    def total(self, text: str) -> int:
        return int(self.per_chunk(text).sum())

    def _spans(self, text: str) -> Iterator[tuple[int, str]]:
        """Start in the normalised text, and word."""
        t = self.words.t
        whole = t.normalizer.normalize_str(text)
        for w, (a, b) in t.pre_tokenizer.pre_tokenize_str(whole):
            yield a, whole[a:b]

    def at_prefixes(self, text: str) -> np.ndarray:
        """Counts for prefix lengths 0..n of the normalised text (special strings as plain text)."""
        n = len(self.words.t.normalizer.normalize_str(text))
        out = np.zeros(n + 1, dtype=np.int64)
        base = done = 0
        for a, w in self._spans(text):
            out[done : a + 1] = base
            got = self.counts(w)
            out[a + 1 : a + len(w) + 1] = base + np.array(got)
            base, done = base + got[-1], a + len(w)
        out[done:] = base
        out[0] = 0
        return out

    def _borders(self, chunk: str) -> tuple[np.ndarray, np.ndarray]:
        """Places in a chunk where normalising joins nothing, and the same places in the normalised chunk."""
        same = np.arange(len(chunk) + 1)
        if is_plain(chunk):
            return same, same
        joined = _joining()
        starts = [i for i, c in enumerate(chunk) if not i or not (unicodedata.combining(c) or c in joined)]
        mark = next(chr(i) for i in range(1, 9) if chr(i) not in chunk) if any(chr(i) not in chunk for i in range(1, 9)) else "\0"
        pieces = [chunk[a:b] for a, b in zip(starts, [*starts[1:], len(chunk)])]
        normal = self.words.t.normalizer.normalize_str(mark.join(pieces)).split(mark)
        if len(normal) != len(pieces) or "".join(normal) != self.words.t.normalizer.normalize_str(chunk):
            return same[:1], same[:1]  # the library joins what this Python's tables do not: no place inside is sure
        return np.array([*starts, len(chunk)]), np.concatenate([[0], np.cumsum([len(x) for x in normal])])

    def _within(self, chunk: str, budget: int) -> int:
        """Code points of the longest prefix of a chunk, at a border, that has at most ``budget`` tokens."""
        chunk = chunk[: self.reach * (budget + 1) + 64]  # what lies beyond is over the budget
        raw, normal = self._borders(chunk)
        return int(raw[np.flatnonzero(self.at_prefixes(chunk)[normal] <= budget)[-1]])

    def _chunk_count(self, chunk: str) -> int:
        w = self.words
        if any(c in chunk for c in "\x1c\x1d\x1e\x1f"):
            return w.split_sum(chunk)
        return int.from_bytes(w.chunk(chunk), "little")

    def longest_within(self, text: str, budget: int, counts: np.ndarray | None = None) -> int:
        """Code points of the longest prefix of a text that has at most ``budget`` tokens.

        A prefix does not end between characters that normalising joins (a letter and its
        accent). Counts of chunks, and one for a special string, are taken off the budget
        until it ends; only the chunk where it ends is looked at by prefixes. A special
        string cut short is plain text, and may go on from the chunk before it. ``counts``
        are those of ``per_chunk``, if they are known.
        """
        if counts is not None and not self.words.mixed(text):
            sums = np.cumsum(counts, dtype=np.int64)
            k = int(np.searchsorted(sums, budget, side="right"))
            if k == len(sums):
                return len(text)
            chunk = next(itertools.islice(_CHUNKS.finditer(text), k, None))
            return chunk.start() + self._within(chunk[0], budget - int(sums[k - 1] if k else 0))
        left, at = budget, 0
        marks = self.words.mark_pattern.finditer(text) if self.words.mark_pattern else iter(())
        for m in (*marks, None):
            stop = m.start() if m else len(text)
            chunk, before = None, left
            for chunk in _CHUNKS.finditer(text, at, stop):
                before, far = left, chunk.end() - chunk.start() > self.reach * (left + 1)
                n = left + 1 if far else self._chunk_count(chunk[0])
                if n > left:
                    touching = chunk.end() == stop and m
                    return chunk.start() + self._within(chunk[0] + (m[0][:-1] if touching else ""), left)
                left -= n
            if m is None:
                break
            if not left:
                start = chunk.start() if chunk and chunk.end() == stop else stop
                return start + self._within(text[start:stop] + m[0][:-1], before if start < stop else 0)
            left, at = left - 1, m.end()
        return len(text)


def prefix_counter(path: str) -> PrefixCounts:
    begin("counts", _prefix_counter.cache_clear)
    return _prefix_counter(path)


@functools.lru_cache(maxsize=1)
def _prefix_counter(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def count_tokens(df: DataFrame, limit: int = 2048, tokenizer: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, fits_chars) of every whole text; null counts as empty.

    ``fits_chars`` is the length in code points of the longest prefix of the text within
    ``limit`` tokens (see ``PrefixCounts.longest_within``), the whole length for texts that
    fit. No shuffle; one row in, one row out.
    """
    path = tokenizer or default_path()
    schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fits_chars", pa.int64())])

    def made(batch: pa.RecordBatch) -> dict[str, object]:
        c = prefix_counter(path)
        texts = text_column(batch)
        counts = [c.per_chunk(t) for t in texts]
        n = [int(x.sum()) for x in counts]
        return {
            "key": batch.column("key"),
            "n_bytes": [len(t.encode("utf-8")) for t in texts],
            "n_tokens": n,
            "over_limit": [x > limit for x in n],
            "fits_chars": [c.longest_within(t, limit, own) if x > limit else len(t) for t, x, own in zip(texts, n, counts)],
        }

    out = df.select(df[key].cast("long").alias("key"), df[text].alias("text")).mapInArrow(
        row_function(made, schema), "key long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long"
    )
    return out.withColumnRenamed("key", key)
