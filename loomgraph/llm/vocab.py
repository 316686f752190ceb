"""Word-wise encoding with a public tokenizer file, exact and cached.

The vocabulary of ``word_bpe_49k.json`` drops white space and never merges across it, so
a text's ids are the ids of its white-space-separated chunks in order. Chunks repeat, so
each worker keeps a bounded table of them; only new words reach the library.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np

from loomgraph.llm.common import begin

#: Words, and chunks, in the younger half of a worker's table. When it is full it becomes the
#: older half; what is found there moves to the new one, so frequent entries stay.
CACHE_ENTRIES = 240_000
#: Longest chunk or word, in characters, that is worth keeping.
CACHE_CHARS = 64
#: What str.split() takes for white space but the tokenizer does not.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Alphabets in which the library's classes and case rules equal those of this Python; left
#: out: separators, digits that are not decimal, and letters whose lower case depends on place.
_PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u02af\u0391-\u03a1\u03a4-\u03c9\u0400-\u0481\u048a-\u0523]*")
#: The tokenizer's own pattern for words, written for such alphabets (fixed value).
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def is_plain(text: str) -> bool:
    """Whether normalising only lowers case, a character for a character."""
    return bool(_PLAIN.fullmatch(text))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The library's tokenizer, single-threaded, without truncation or padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Words:
    """``per_word(word) -> bytes`` folded over whole texts.

    ``per_word`` gets a normalised word and returns any bytes; the result for a text is the
    concatenation over its words, or over its chunks of what ``fold`` makes of theirs. Texts that the fast path cannot split exactly (rare
    alphabets, separators, special strings) take the library's own splitter.
    """

    def __init__(self, path: str, per_word: Callable[[str], bytes], special: Callable[[int], bytes], fold: Callable[[bytes], bytes] | None = None, entries: int = CACHE_ENTRIES):
        self.t = load_tokenizer(path)
        self.per_word, self.special, self.fold, self.entries = per_word, special, fold, entries
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.marks = {x.content: i for i, x in self.t.get_added_tokens_decoder().items()}
        self.mark_pattern = re.compile("|".join(map(re.escape, sorted(self.marks, key=len, reverse=True)))) if self.marks else None
        self.hint = min(self.marks, key=len)[:2] if self.marks else "\0"

    def word(self, w: str) -> bytes:
        v = self.words.get(w)
        if v is None:
            v = self.old_words.pop(w, None)
            if v is None:
                v = self.per_word(w)
            if len(w) <= CACHE_CHARS:
                if len(self.words) >= self.entries:
                    self.old_words, self.words = self.words, {}
                self.words[w] = v
        return v

    def split(self, text: str) -> list[str]:
        """The normalised words of a text without special strings."""
        if _PLAIN.fullmatch(text):
            return _WORDS.findall(text.lower())
        return [w for w, _ in self.t.pre_tokenizer.pre_tokenize_str(self.t.normalizer.normalize_str(text))]

    def split_sum(self, text: str) -> int:
        """The sum of little-endian values of the words of a text that only the library splits."""
        return sum(int.from_bytes(self.word(_unmapped(w)), "little") for w in self.split(text))

    def chunk(self, c: str) -> bytes:
        v = self.chunks.get(c)
        if v is not None:
            return v
        v = self.old_chunks.pop(c, None)
        if v is None:
            if c.isalpha() and c.isascii():
                v = self.word(c.lower())
            elif _PLAIN.fullmatch(c):
                v = b"".join(map(self.word, _WORDS.findall(c.lower())))
            else:
                v = b"".join(self.word(_unmapped(w)) for w in self.split(c))
            if self.fold:
                v = self.fold(v)
        if len(c) <= CACHE_CHARS:
            if len(self.chunks) >= self.entries:
                self.old_chunks, self.chunks = self.chunks, {}
            self.chunks[c] = v
        return v

    def plain(self, text: str) -> bytes:
        """A text without special strings."""
        if any(c in text for c in _SEPARATORS):
            return b"".join(self.word(_unmapped(w)) for w in self.split(text))
        parts = text.split()
        got = list(map(self.chunks.get, parts))
        if None in got:
            got = [v if v is not None else self.chunk(c) for v, c in zip(got, parts)]
        return b"".join(got)

    def marked(self, text: str) -> bool:
        """Whether a special string stands in the text."""
        return self.hint in text and bool(self.mark_pattern.search(text))

    def mixed(self, text: str) -> bool:
        """Whether the parts of the result for a text are not one for each chunk between white space."""
        return self.marked(text) or any(c in text for c in _SEPARATORS)

    def __call__(self, text: str) -> bytes:
        if not self.marked(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.mark_pattern.finditer(text):
            out += [self.plain(text[at : m.start()]), self.special(self.marks[m[0]])]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


_BACK = {c: b for b, c in enumerate(byte_alphabet())}


def _unmapped(w: str) -> str:
    """A word as the pre-tokenizer gives it, one character a byte, as text."""
    return bytes(_BACK[c] for c in w).decode("utf-8")


def id_encoder(path: str) -> Words:
    """Ids of a text as little-endian unsigned 32-bit integers, made by the library word by word."""
    begin("ids", _id_encoder.cache_clear)
    return _id_encoder(path)


@functools.lru_cache(maxsize=1)
def _id_encoder(path: str) -> Words:
    t = load_tokenizer(path)
    letters = byte_alphabet()

    def per_word(w: str) -> bytes:
        mapped = w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode("utf-8")])
        return np.array([x.id for x in t.model.tokenize(mapped)], dtype="<u4").tobytes()

    return Words(path, per_word, lambda i: int(i).to_bytes(4, "little"))
