"""Token-id files: fixed-size id blocks, transposed into byte planes, each plane compressed.

Layout of a file (little-endian): magic ``LGPLANE1``; the compressed planes of all blocks,
one after the other; the documents' table (ids and lengths), compressed; the chunk index,
one record per block (place of its first plane, ids in it, sizes of its planes); a footer
with the places of table and index, their sizes, the number of ids and of documents. A
reader takes the footer, then the index, then only the blocks it needs. Byte planes of
32-bit ids: the two high planes are all but constant and shrink to nothing.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomgraph.llm.common import Scratch, partitions, text_column
from loomgraph.llm.vocab import default_path, id_encoder

MAGIC = b"LGPLANE1"
#: Ids in a block.
BLOCK = 1 << 16
#: Documents whose rows one output batch of the reader holds.
READ_ROWS = 4096
_FOOTER = struct.Struct("<QQQQQQ8s")


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder; anything that pyarrow's file systems reach."""
    if "://" in uri or uri.startswith("file:"):
        parts = urlparse(uri)
        if parts.scheme == "file":
            return pafs.LocalFileSystem(), parts.path
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def planes(ids: np.ndarray) -> list[bytes]:
    """The four byte planes of a block of unsigned 32-bit ids."""
    return [np.ascontiguousarray(p).tobytes() for p in ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T]


def joined(parts: list[bytes]) -> np.ndarray:
    """A block's ids from its planes."""
    return np.ascontiguousarray(np.stack([np.frombuffer(p, dtype=np.uint8) for p in parts], axis=1)).view("<u4").ravel()


class Writer:
    """Writes documents' ids into one file. Holds a block of ids and the documents' table, no more."""

    def __init__(self, sink, level: int = 3):
        import zstandard

        self.sink, self.zip = sink, zstandard.ZstdCompressor(level=level)
        self.at = self.sink.write(MAGIC) or len(MAGIC)
        self.rest: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.index: list[tuple[int, ...]] = []
        self.docs: list[int] = []
        self.lengths: list[int] = []

    def _put(self, data: bytes) -> int:
        self.sink.write(data)
        self.at += len(data)
        return len(data)

    def _block(self, ids: np.ndarray) -> None:
        start = self.at
        self.index.append((start, len(ids), *[self._put(self.zip.compress(p)) for p in planes(ids)]))

    def add(self, doc: int, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.rest.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= BLOCK:
            whole = np.concatenate(self.rest)
            full = len(whole) // BLOCK * BLOCK
            for at in range(0, full, BLOCK):
                self._block(whole[at : at + BLOCK])
            self.rest, self.held = [whole[full:]], len(whole) - full

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.rest))
        table, sizes = np.array(self.docs, dtype="<i8").tobytes() + np.array(self.lengths, dtype="<u8").tobytes(), []
        for data in (self.zip.compress(table), self.zip.compress(np.array(self.index, dtype="<u8").tobytes())):
            sizes += [self.at, self._put(data)]
        self._put(_FOOTER.pack(*sizes, self.n_ids, len(self.docs), MAGIC))


class Reader:
    """Reads a file of ``Writer`` by its chunk index: one document's ids or all of them in order."""

    def __init__(self, source):
        import zstandard

        self.source, self.zip = source, zstandard.ZstdDecompressor()
        source.seek(source.size() - _FOOTER.size)
        table_at, table_size, index_at, index_size, self.n_ids, n, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        raw = self._part(table_at, table_size)
        self.docs, self.lengths = np.frombuffer(raw, dtype="<i8", count=n), np.frombuffer(raw, dtype="<u8", offset=8 * n, count=n).astype(np.int64)
        self.index = np.frombuffer(self._part(index_at, index_size), dtype="<u8").reshape(-1, 6).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)

    def _part(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.zip.decompress(self.source.read(size), max_output_size=1 << 31)

    def block(self, k: int) -> np.ndarray:
        at, _, *sizes = self.index[k].tolist()
        self.source.seek(at)
        raw = self.source.read(sum(sizes))
        ends = np.cumsum([0, *sizes]).tolist()
        return joined([self.zip.decompress(raw[a:b], max_output_size=BLOCK) for a, b in zip(ends, ends[1:])])

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, through the blocks that hold them."""
        a, b = int(self.starts[k]), int(self.starts[k + 1])
        if a == b:
            return np.empty(0, "<u4")
        first = a // BLOCK
        whole = np.concatenate([self.block(j) for j in range(first, (b - 1) // BLOCK + 1)])
        return whole[a - first * BLOCK : b - first * BLOCK]

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(document, start in the file, ids) in order; each block is read once."""
        held, k, at = np.empty(0, "<u4"), 0, 0
        for doc, n in zip(self.docs.tolist(), self.lengths.tolist()):
            got = [held] if len(held) < n else []
            have = len(held)
            while have < n:
                got.append(self.block(k))
                have += len(got[-1])
                k += 1
            held = np.concatenate(got) if got else held
            yield doc, at, held[:n]
            held, at = held[n:], at + n


def write_ids(
    df: DataFrame, folder: str, end_id: int = 1, tokenizer: str | None = None, shards: int | None = None, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Writes every document's ids, with ``end_id`` after each, in ascending order of ``key``.

    Returns the shard table: (shard, path, n_docs, n_ids, base), base being the number of
    ids in all shards before. Null texts count as empty and hold the end id alone. Rows of
    one key keep the order of their texts, null keys come first (written as the least
    64-bit integer). Shards are key ranges; each is written under a name of its own task
    attempt and then renamed, so a task that runs twice leaves one whole file.
    """
    spark = df.sparkSession
    path = tokenizer or default_path()
    target = folder
    schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        store, root = open_store(target)
        encode = id_encoder(path)
        end = np.array([end_id], dtype="<u4")
        own, final = f"{root}/.{shard:06d}-{uuid.uuid4().hex}", f"{root}/shard-{shard:06d}.planes"
        writer = None
        for batch in batches:
            if batch.num_rows and writer is None:
                writer = Writer(sink := store.open_output_stream(own))
            for doc, t in zip(batch.column("key").to_pylist(), text_column(batch)):
                writer.add(-(2**63) if doc is None else doc, np.concatenate([np.frombuffer(encode(t), dtype="<u4"), end]))
        if writer:
            writer.close()
            sink.close()
            store.move(own, final)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [final], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]}, schema=schema)

    store, root = open_store(target)
    store.create_dir(root, recursive=True)
    n = shards or partitions(spark)
    ordered = df.select(df[key].cast("long").alias("key"), df[text].alias("text")).repartitionByRange(n, "key").sortWithinPartitions("key", "text")
    # One row a shard comes to the driver: as many as there are range partitions.
    made = sorted(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_ids long").collect(), key=lambda r: r.shard)
    rows, base = [], 0
    for r in made:
        rows.append((r.shard, r.path, r.n_docs, r.n_ids, base))
        base += r.n_ids
    return spark.createDataFrame(rows, "shard long, path string, n_docs long, n_ids long, base long")


def read_ids(shards: DataFrame, folder: str, per_document: Callable[[np.ndarray], dict[str, object]], fields: str, kinds: pa.Schema) -> DataFrame:
    """(doc_id, start, n_tokens, and what ``per_document`` makes of a document's ids), read back from the files."""
    target = folder
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), *kinds])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(target)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with store.open_input_file(path) as source:
                    rows: list[dict[str, object]] = []
                    for doc, start, ids in Reader(source):
                        rows.append({"doc_id": None if doc == -(2**63) else doc, "start": base + start, "n_tokens": len(ids), **per_document(ids)})
                        if len(rows) == READ_ROWS:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = max(1, shards.count())
    return shards.repartition(n).mapInArrow(read, f"doc_id long, start long, n_tokens long, {fields}")


def token_file_digests(df: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes all documents' ids to files in the shared folder and reads them back: (doc_id, start, n_tokens, ids_crc32)."""
    folder = Scratch(df.sparkSession, "token-files").path("ids")
    shards = write_ids(df, folder, tokenizer=tokenizer)
    return read_ids(shards, folder, lambda ids: {"ids_crc32": zlib.crc32(ids.astype("<u4", copy=False).tobytes())}, "ids_crc32 long", pa.schema([("ids_crc32", pa.int64())]))


__all__ = ["Reader", "Writer", "read_ids", "token_file_digests", "write_ids"]
