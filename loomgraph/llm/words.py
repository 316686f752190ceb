"""Lower case of bytes, and filters of bounded size over keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import mix64

#: Bits of a filter for each key, and the most that a filter has, however many keys there are.
KEY_BITS, MOST_BITS = 16, 1 << 27

#: Lower case of A to Z, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Filter:
    """A Bloom filter of bounded size over 64-bit keys: what it holds it never denies."""

    def __init__(self, keys: DataFrame, most_bits: int = MOST_BITS):
        """``keys(key long)``: a row each. Tasks set bits of their own, which are joined word by word; the driver gets a row for each word of the filter at most."""
        n = keys.count()
        self.bits = bits = min(most_bits, max(1 << 10, 1 << (n * KEY_BITS - 1).bit_length())) if n else 1 << 10

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(bits >> 6, dtype=np.uint64)
            for batch in batches:
                for place in _places(batch.column("key").to_numpy(), bits):
                    np.bitwise_or.at(own, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at].view(np.int64))], names=["at", "word"])

        words = keys.select("key").mapInArrow(task, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        held = np.zeros(bits >> 6, dtype=np.uint64)
        held[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
        self.shared: Broadcast = keys.sparkSession.sparkContext.broadcast(held)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Which keys it may hold."""
        held, out = self.shared.value, np.ones(len(keys), dtype=bool)
        for place in _places(keys, self.bits):
            out &= held[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) == 1
        return out


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Four bits for each key."""
    mask = np.uint64(bits - 1)
    for h in (mix64(keys.view(np.uint64)), mix64(keys.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))):
        yield h & mask
        yield h >> np.uint64(32) & mask
