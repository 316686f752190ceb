"""Runs of bytes in whole columns of texts: words, found for all texts of a slice at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one step takes; a longer text is a step of its own.
STEP_BYTES = 2 << 20


def byte_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to slices of at most ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.concatenate([[0], np.cumsum(lengths(batch.column(column)))])
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each text, 0 for null."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, start of each text and the end); null texts are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[at[0] : at[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes that cross no text's border."""
    n = len(inside)
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[at[at < n]] = False
    after[at[at > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def vocabulary(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(code of each run, distinct runs by code); the runs are all of ``inside``."""
    body, at = data[inside], np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary


def hashes(values: list[bytes]) -> np.ndarray:
    """A hash of each value, the one of Spark's ``xxhash64``."""
    return np.fromiter((xxhash.xxh64_intdigest(v, seed=42) for v in values), dtype=np.uint64, count=len(values))
