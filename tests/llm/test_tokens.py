"""Encoding, counting, files and packing against the tokenizers library."""

import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from loomgraph.llm import bpe_dp, packing, token_files
from loomgraph.llm.vocab import default_path, id_encoder

from .conftest import TEXTS

raw = lambda ids: np.array(ids, dtype="<u4").tobytes()


def test_words_and_tables_equal_the_library(tokenizer):
    rnd = random.Random(3)
    fast, dp, counter = id_encoder(default_path()), bpe_dp.dp_encoder(default_path()), bpe_dp.prefix_counter(default_path())
    alphabet = "aAbéZ 's'tΣσİ̈\x1c\x85\xa01²½_-.,!#ßﬁ한🙂\n"
    for _ in range(1500):
        s = "".join(rnd.choice([*alphabet, "'ll", "<|endoftext|>", "the", "ing"]) for _ in range(rnd.randrange(25)))
        want = tokenizer.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(fast(s), "<u4").tolist() == want
        assert np.frombuffer(dp(s), "<u4").tolist() == want
        assert counter.total(s) == len(want)
        assert bpe_dp.decode(np.array(want, "<u4"), default_path()) == tokenizer.decode(want, skip_special_tokens=False)
    for w in ("a" * 50, "ab" * 30, "!?" * 20):
        assert bpe_dp.prefix_bpe(default_path()).ids(w) == tokenizer.encode(w, add_special_tokens=False).ids


def test_prefix_counts(tokenizer):
    counter = bpe_dp.prefix_counter(default_path())
    s = "The cats we've seen, unbelievably!! 12 don't été"
    n = [len(tokenizer.encode(s[:j], add_special_tokens=False).ids) for j in range(len(s) + 1)]
    assert counter.at_prefixes(s).tolist() == n
    for budget in range(max(n) + 2):
        assert counter.longest_within(s, budget) == max(j for j, c in enumerate(n) if c <= budget)


def test_longest_within(tokenizer):
    """As the library's counts of all prefixes, for accents, letters that grow in lower case, separators and special strings."""
    import unicodedata

    counter, rnd = bpe_dp.prefix_counter(default_path()), random.Random(7)
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    parts = [*"aAbéZ'sİ\u0308\u0301\u0327e\x1c\x85-_.,!#한\u1100\u1161\u11a8\n  ", "'ll", "'re", "<|endoftext|>", "<|endof", "<", "the", "ing"]
    for _ in range(400):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 18)))

        def border(j):
            """Not between characters that are composed, nor before a mark."""
            return j in (0, len(s)) or s[:j].endswith("<|endoftext|>") or s[j - 1] in "\n \x85" or (not unicodedata.combining(s[j]) and unicodedata.normalize("NFC", s[j - 1] + s[j]) == unicodedata.normalize("NFC", s[j - 1]) + unicodedata.normalize("NFC", s[j])) and s[j] not in "\u1161\u11a8"

        n = [count(s[:j]) for j in range(len(s) + 1)]
        for budget in range(n[-1] + 1):
            got = counter.longest_within(s, budget)
            assert got == counter.longest_within(s, budget, counter.per_chunk(s))
            assert got == max((j for j, c in enumerate(n) if c <= budget and (border(j) or inside(s, j)))), (s, budget)
    for t in ("İ" + "abc" * 2000, "e\u0301x" * 2000):
        at = counter.longest_within(t, 100)
        assert count(t[:at]) <= 100 < min(count(t[:j]) for j in range(at + 2, at + 12))


def inside(s, j):
    """A place in a special string, where a cut leaves plain text."""
    return any(m < j < m + 13 for m in range(len(s)) if s.startswith("<|endoftext|>", m))


def test_long_text_without_spaces():
    import time

    counter = bpe_dp.prefix_counter(default_path())
    text = "abcdefghij" * 100_000
    began = time.process_time()
    at = counter.longest_within(text, 2048)
    assert 2048 <= at < len(text) and time.process_time() - began < 20
    assert counter.total(text[:at]) <= 2048 < counter.total(text[: at + 12])


def test_encode_decode(docs, empty, tokenizer):
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe_dp.encode_decode(docs).collect())
    want = Counter()
    for i, t in TEXTS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_dp.encode_decode_digests(docs).collect()}
    assert digests == {(i, len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for i, ids, d in want}
    assert bpe_dp.encode_decode(empty).count() == 0


def test_count_tokens(docs, empty, tokenizer):
    rows = bpe_dp.count_tokens(docs, limit=100).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == Counter((i, len((t or "").encode()), n, n > 100) for i, t in TEXTS for n in [len(tokenizer.encode(t or "", add_special_tokens=False).ids)])
    at = next(r.fits_chars for r in rows if r.doc_id == 7)
    assert len(tokenizer.encode(TEXTS[7][1][:at], add_special_tokens=False).ids) <= 100 < len(tokenizer.encode(TEXTS[7][1][: at + 1], add_special_tokens=False).ids)
    assert all(r.fits_chars == len(t or "") for r in rows if not r.over_limit for t in [dict(TEXTS)[r.doc_id]])
    assert bpe_dp.count_tokens(empty).count() == 0


def test_file_format():
    rnd = np.random.default_rng(0)
    docs = [rnd.integers(0, 49408, n).astype("<u4") for n in (0, 5, token_files.BLOCK, 3 * token_files.BLOCK + 7, 1, 0)]
    sink = io.BytesIO()
    w = token_files.Writer(sink)
    for k, ids in enumerate(docs):
        w.add(10 * k, ids)
    w.close()
    reader = token_files.Reader(pa.BufferReader(sink.getvalue()))
    at = 0
    for k, (doc, start, ids) in enumerate(reader):
        assert (doc, start) == (10 * k, at) and (ids == docs[k]).all() and (reader.ids(k) == docs[k]).all()
        at += len(ids)
    assert (token_files.joined(token_files.planes(docs[2])) == docs[2]).all()


def test_token_files(docs, empty, tokenizer):
    rows = sorted(token_files.token_file_digests(docs).collect(), key=lambda r: r.start)
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0))
    at = 0
    for r, (i, t) in zip(rows, order, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(raw(ids)))
        at += len(ids)
    assert token_files.token_file_digests(empty).count() == 0


def test_tightest_fit():
    rnd = random.Random(1)
    fit, left = packing.TightestFit(64), []
    for n in sorted((rnd.randrange(1, 65) for _ in range(400)), reverse=True):
        best = min((c for c in left if c >= n), default=None)
        number, offset = fit.place(n)
        if best is None:
            assert offset == 0 and number == len(left)
            left.append(64 - n)
        else:
            assert left[number] == best == 64 - offset
            left[number] -= n


def test_pack(docs, empty, tokenizer):
    rows = packing.pack(docs, window=512).collect()
    want = Counter()
    for i, t in TEXTS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.update((i, at, min(512, len(ids) - at), zlib.crc32(raw(ids[at : at + 512])), len(ids)) for at in range(0, len(ids), 512))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 512
    assert packing.pack(empty).count() == 0
