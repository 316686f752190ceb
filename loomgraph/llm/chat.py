"""Chat formatting at token level.

The template marks a conversation as ``<s>`` and each turn as
``[INST]role[/INST]text</s>``. The four control strings are reserved ids of their own,
spliced between segments that are encoded separately, so no text can make one. Control
strings inside roles and texts are escaped too, so that the rendered text can be read as
safely as the ids: a backslash goes behind the first character of a control string, one
more where backslashes are there already, and reading takes one away.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import partitions
from loomgraph.llm.vocab import byte_alphabet, load_tokenizer

#: Control strings of the template, in the order of their reserved ids (fixed values).
CONTROL = ("<s>", "[INST]", "[/INST]", "</s>")
BEGIN, OPEN, CLOSE, END = range(4)
_RAW = re.compile("|".join(re.escape(c[0]) + r"(\\*)" + re.escape(c[1:]) for c in CONTROL))
_ESCAPED = re.compile("|".join(re.escape(c[0]) + r"\\(\\*)" + re.escape(c[1:]) for c in CONTROL))


def escape(text: str) -> str:
    """The text without control strings; ``unescape`` gives the text back."""
    return _RAW.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


class Template:
    """A byte-level vocabulary with the reserved ids behind it."""

    def __init__(self, path: str):
        self.t = load_tokenizer.__wrapped__(path)  # its own, as the next line changes it
        self.t.encode_special_tokens = True  # their strings in a text are ordinary text
        back = {c: b for b, c in enumerate(byte_alphabet())}
        size = self.t.get_vocab_size(with_added_tokens=True)
        self.first = size
        special = {x.content for x in self.t.get_added_tokens_decoder().values()}
        self.bytes = [b""] * size
        for s, i in self.t.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = s.encode() if s in special else bytes(back[c] for c in s)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.bytes[i] for i in ids.tolist()]).decode("utf-8", errors="replace")

    def turns(self, roles: list[str], texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, loss mask) of each turn, the conversation's beginning not included."""
        coded = self.encode([escape(x) for pair in zip(roles, texts) for x in pair])
        out = []
        for i, role in enumerate(roles):
            head, body = coded[2 * i], coded[2 * i + 1]
            segments = [[self.first + OPEN], head, [self.first + CLOSE], body, [self.first + END]]
            # A segment adds 1 at its start and takes it away behind its end; sums over all before give the mask.
            ends = np.cumsum([0, *map(len, segments)])
            steps = np.zeros(ends[-1] + 1, dtype=np.int8)
            if role == "assistant":
                steps[ends[3]] += 1
                steps[ends[4]] -= 1
            out.append((np.array([x for s in segments for x in s], dtype="<u4"), np.cumsum(steps[:-1]).astype(bool)))
        return out

    def parse(self, ids: np.ndarray) -> tuple[str, str]:
        """(role, text) of a turn, unescaped."""
        marks = np.flatnonzero(ids >= self.first)
        if [int(ids[m]) - self.first for m in marks] != [OPEN, CLOSE, END] or marks[0] != 0 or marks[2] != len(ids) - 1:
            raise ValueError("not a turn")
        return unescape(self.decode(ids[1 : marks[1]])), unescape(self.decode(ids[marks[1] + 1 : -1]))

    def rendered(self, ids: np.ndarray) -> str:
        """The template's text for ids, control strings and escapes included."""
        out, at = [], 0
        for m in np.flatnonzero(ids >= self.first).tolist():
            out += [self.decode(ids[at:m]), CONTROL[int(ids[m]) - self.first]]
            at = m + 1
        return "".join([*out, self.decode(ids[at:])])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def template(path: str) -> Template:
    return Template(path)


def format_turns(df: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, turn, role, ids, loss_mask) of every row of ``df(conv_id, turn, role, text)``.

    ``ids`` is the turn as little-endian unsigned 32-bit integers, ``loss_mask`` one byte
    an id. Null roles and texts count as empty; other columns are ignored. Rows are
    encoded where they are read, so no conversation, however long, is gathered for it.
    """
    path = tokenizer or default_path()
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("ids", pa.binary()), ("loss_mask", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                roles = [r or "" for r in some.column("role").to_pylist()]
                made = t.turns(roles, [x or "" for x in some.column("text").to_pylist()])
                yield pa.RecordBatch.from_pydict(
                    {"conv_id": some.column("conv_id"), "turn": some.column("turn"), "role": roles, "ids": [i.tobytes() for i, _ in made], "loss_mask": [m.tobytes() for _, m in made]}, schema=schema
                )

    rows = df.select(df["conv_id"].cast("long").alias("conv_id"), df["turn"].cast("long").alias("turn"), df["role"].cast("string").alias("role"), df["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, ids binary, loss_mask binary")


def conversation_digests(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Reads formatted turns back and folds each conversation in order of its turns.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_ids).
    Equal turn numbers go by role, then by encoded bytes; a null conversation id is a
    conversation of its own. A task streams its sorted rows and holds one turn at a time.
    """
    path = tokenizer or default_path()
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_ids", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(path)
        names = ("conv_id", "ids", "loss_mask")
        conv, state, rows = None, None, []
        for batch in batches:
            for c, raw, mask in zip(*(batch.column(n).to_pylist() for n in names)):
                if state is None or c != conv:
                    if state:
                        rows.append(_closed(conv, state))
                    conv, state = c, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": len(CONTROL[BEGIN]), "ids": 1}
                ids, under = np.frombuffer(raw, dtype="<u4"), np.frombuffer(mask, dtype=bool)
                role, text = t.parse(ids)
                lost = unescape(t.decode(ids[under]))
                state["turns"].update(f"{role}\n{text}\n".encode())
                state["loss"].update(lost.encode())
                for k, by in (("n", 1), ("loss_chars", len(lost)), ("chars", len(t.rendered(ids))), ("ids", len(ids))):
                    state[k] += by
            if len(rows) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if state:
            rows.append(_closed(conv, state))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    ordered = turns.repartition(partitions(turns.sparkSession), F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "ids")
    return ordered.select("conv_id", "ids", "loss_mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long")


def _closed(conv: int | None, s: dict) -> tuple:
    return conv, s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["ids"]
