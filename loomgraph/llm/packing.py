"""Packing documents into training sequences by best-fit decreasing.

Documents longer than a window are first cut into full windows. What remains is packed
longest first; a segment tree over the remaining capacities finds the tightest open window
that still takes a piece. Packing needs only lengths, so ids and texts are never shuffled:
pieces of about ``GROUP_TOKENS`` tokens form a group, a group is packed by one task in one
pass over its sorted pieces, and at most one window of a group stays badly filled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, partitions, text_column
from loomgraph.llm.vocab import default_path, id_encoder

WINDOW = 4096
#: Tokens of a packing group: 512 windows.
GROUP_TOKENS = 512 * WINDOW


class TightestFit:
    """Open windows by remaining capacity, under a segment tree of how many there are."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]
        self.window, self.made = window, 0

    def _count(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def tightest(self, length: int) -> int:
        """The least capacity of an open window that is at least ``length``, or -1."""
        at = length + self.size
        if self.tree[at]:
            return length
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1

    def place(self, length: int) -> tuple[int, int]:
        """Window number and offset for a piece."""
        capacity = self.tightest(length)
        if capacity < 0:
            number, offset, capacity = self.made, 0, self.window
            self.made += 1
        else:
            number, offset = self.open[capacity].pop()
            self._count(capacity, -1)
        left = capacity - length
        if left:
            self.open[left].append((number, offset + length))
            self._count(left, 1)
        return number, offset


def cut(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    return [(at, min(window, n - at)) for at in range(0, n, window)]


def pieces(df: DataFrame, window: int = WINDOW, end_id: int = 2, tokenizer: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every piece of every document: (part, row, doc_id, start, length, ids_crc32, doc_tokens).

    Null texts count as empty and hold ``end_id`` alone. Repeated rows are documents of
    their own, told apart by (part, row), the place where they were read.
    """
    path = tokenizer or default_path()
    names = ("part", "row", "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, row = id_encoder(path), TaskContext.get().partitionId(), 0
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = []
                some = batch.slice(at, 1024)
                for doc, t in zip(some.column("key").to_pylist(), text_column(some)):
                    raw = encode(t) + end
                    n = len(raw) // 4
                    rows += [(part, row, doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n) for start, length in cut(n, window)]
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    return df.select(df[key].cast("long").alias("key"), df[text].alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def pack(df: DataFrame, window: int = WINDOW, end_id: int = 2, tokenizer: str | None = None, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    ``sequence_id`` is the group's number times 2^32 plus the window's number in it. Pieces
    of a window lie side by side from offset 0. Ties in length go by document, start and
    place of reading. An empty table gives no pieces.
    """
    scratch = Scratch(df.sparkSession, "packing")
    all_pieces = scratch.save(pieces(df, window, end_id, tokenizer), "pieces")
    tokens = all_pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-tokens // group_tokens))
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fit = None, None
        for batch in batches:
            placed, ids = [], []
            for g, length in zip(batch.column("group").to_pylist(), batch.column("length").to_pylist()):
                if g != group:
                    group, fit = g, TightestFit(window)
                number, offset = fit.place(length)
                ids.append((g << 32) + number)
                placed.append(offset)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:5]), pa.array(ids, pa.int64()), pa.array(placed, pa.int64())], schema=schema)

    return (
        all_pieces.withColumn("group", F.pmod(F.xxhash64("part", "row", "start"), F.lit(groups)))
        .repartition(min(groups, 4 * partitions(df.sparkSession)), "group")
        .sortWithinPartitions("group", F.desc("length"), "doc_id", "start", "part", "row")
        .mapInArrow(run, ", ".join(f"{n} long" for n in names))
    )
