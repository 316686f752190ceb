"""Nearest neighbours by largest inner product over an inverted multi-index.

Vectors are cut into two halves and each half is quantised by a codebook of its own, so that
K + K centroids make K * K cells. A query's inner product with a cell is the sum of two
numbers, one a half; a heap walks the cells from the largest sum down without listing all.
Entries of the cells that are walked are ranked again by exact inner products.

Where a query stops depends on itself. The sample that the codebooks are fitted on, a part of
the entries, gives a bound for its k-th best product, and each centroid knows how far the
vectors that it stands for lie from it. So a cell has an expected number of entries over
the bound, and the walk ends when the cells walked hold nearly all of what is expected of all
cells. Queries with close neighbours stop early and others go on, at any size of the table.

Entries lie in blocks of equal size in the order of their cells. A task holds one block and
takes the queries that walk into it as matrix products; a cell of many entries fills several
blocks. Equal vectors are one entry with its least ids.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, begin, partitions

#: Vectors that codebooks and bounds are taken from, and the most bytes that they have together.
SAMPLE, SAMPLE_BYTES = 16_384, 64 << 20
#: Rounds of k-means.
ROUNDS = 12
#: Bytes of the entries of a block, as doubles; queries compared with it at a time, and in one task.
BLOCK_BYTES, SLICE, SHARE = 1 << 20, 512, 1 << 17
#: Most centroids of a half.
CENTROIDS = 256
#: Share of the entries expected over a query's bound at which its walk ends; deviations by which centroids of loose cells go first.
WALKED, LOOSE = 0.98, 1.0
#: What a search of one dimension finds.
FOUND = "node long, twin long, ids array<long>, scores array<double>"


def vectors_of(df: DataFrame, key: str, embedding: str) -> DataFrame:
    """(id, node, twin, vector): distinct rows with an id and a vector of finite numbers, not all 0; two hashes name a vector."""
    rows = df.where(F.col(key).isNotNull() & F.col(embedding).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("id"), F.transform(F.col(embedding), lambda x: F.when(x.cast("double") == 0, F.lit(0.0)).otherwise(x.cast("double"))).alias("vector"))
    fine = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False))).select("id", F.xxhash64("vector").alias("node"), F.xxhash64(F.lit(1), "vector").alias("twin"), "vector")


def entries_of(rows: DataFrame, k: int) -> DataFrame:
    """(node, twin, vector, ids): distinct vectors with their k + 1 least ids, which is all that a search can give out."""
    ids = rows.select("node", "twin", "id").distinct()  # without vectors; tasks keep k + 1 of a vector before the shuffle
    first = ids.withColumn("_at", F.row_number().over(Window.partitionBy("node", "twin").orderBy("id"))).where(F.col("_at") <= k + 1)
    listed = first.groupBy("node", "twin").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return rows.groupBy("node", "twin").agg(F.any_value("vector").alias("vector")).join(listed, ["node", "twin"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _means(x: np.ndarray, k: int) -> np.ndarray:
    """k-means from fixed starts; a centroid without vectors stays where it is."""
    c = x[np.random.default_rng(k).choice(len(x), size=k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        full = np.flatnonzero(n)
        c[full] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[full])[:-1]])) / n[full][:, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((c * c).sum(1) - 2 * x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Codebooks:
    """Two codebooks for vectors of one dimension, the sample that they were fitted on, and what they lose."""

    def __init__(self, sample: np.ndarray, n: int, k: int):
        """``sample`` of ``n`` entries; k neighbours are asked for."""
        d = sample.shape[1]
        self.cut = max(1, d // 2) if d > 1 else 1
        self.size = int(np.clip(2 ** round(np.log2(max(n, 1) ** 0.5 / 4)), 4, CENTROIDS))
        self.halves = (sample[:, : self.cut], sample[:, self.cut :])
        self.books = [_means(np.ascontiguousarray(h), self.size) for h in self.halves]
        self.loss = []  # of one coordinate, by centroid
        for h, c in zip(self.halves, self.books):
            own = _nearest(h, c)
            square = ((h - c[own]) ** 2).mean(1) if h.shape[1] else np.zeros(len(h))
            whole = square.mean() if len(h) else 0.0
            self.loss.append((np.bincount(own, square, self.size) + 4 * whole) / (np.bincount(own, minlength=self.size) + 4))
        self.sample, self.share, self.k = sample, len(sample) / max(n, 1), k

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x[:, : self.cut], self.books[0]) * self.size + _nearest(x[:, self.cut :], self.books[1])

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """A product that the k-th best of all entries hardly falls short of, from the sample.

        It is the one of the rank that stands for k + 1 (one may be the query's own) and 1.5 deviations of what the sample holds of them.
        """
        s = q @ self.sample.T
        mean = (self.k + 1) * self.share
        rank = min(s.shape[1], max(1, round(mean + 1.5 * (mean * (1 - self.share)) ** 0.5)))
        return -np.partition(-s, rank - 1, axis=1)[:, rank - 1]

    def walk(self, q: np.ndarray, bound: float, filled: np.ndarray, share: float) -> np.ndarray:
        """Cells for one query, the largest sum first, by a heap over pairs of centroids; ``filled`` are entries by cell (matrix).

        It stops when k + 1 entries are seen and the cells hold ``share`` of the entries expected over the bound.
        """
        halves = (q[: self.cut], q[self.cut :])
        sums = [c @ h for c, h in zip(self.books, halves)]
        spread = [v * float(h @ h) for v, h in zip(self.loss, halves)]
        z = (bound - sums[0][:, None] - sums[1][None, :]) / np.sqrt(spread[0][:, None] + spread[1][None, :] + 1e-300)
        hope = filled * _tail(z)
        wanted = share * float(hope.sum())
        a, b = (s + LOOSE * np.sqrt(v) for s, v in zip(sums, spread))
        i, j = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        order = np.ix_(i, j)
        count, expected = filled[order].tolist(), hope[order].tolist()
        a, b, rows, columns = (-a[i]).tolist(), (-b[j]).tolist(), i.tolist(), j.tolist()
        heap, seen, mass, out, size = [(a[0] + b[0], 0, 0)], 0, 0.0, [], self.size
        while heap and (mass < wanted or seen <= self.k):
            _, x, y = heapq.heappop(heap)
            if count[x][y]:
                out.append(rows[x] * size + columns[y])
                seen += count[x][y]
                mass += expected[x][y]
            # Each pair is reached once: along its row, or down the first column.
            if y + 1 < size:
                heapq.heappush(heap, (a[x] + b[y + 1], x, y + 1))
            if y == 0 and x + 1 < size:
                heapq.heappush(heap, (a[x + 1] + b[0], x + 1, 0))
        return np.array(out, dtype=np.int64)


def _tail(z: np.ndarray) -> np.ndarray:
    """The chance that a normal variate exceeds z, to within a few percent of itself."""
    x = np.minimum(np.abs(z), 38.0)
    upper = np.exp(-x * x / 2) / (1.64 * x + np.sqrt(0.76 * x * x + 4))
    return np.where(z < 0, 1 - upper, upper)


def _layout(filled: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, blocks) of each cell: cells in order share blocks of ``room`` entries, a larger cell has several of its own."""
    first, many = np.zeros(len(filled), dtype=np.int64), np.ones(len(filled), dtype=np.int64)
    block, used = 0, 0
    for cell, n in enumerate(filled.tolist()):
        if used and used + n > room:
            block, used = block + 1, 0
        first[cell] = block
        used += n
        if n > room:
            many[cell] = -(-n // room)
            block, used = block + int(many[cell]), 0
    return first, many


def search(df: DataFrame, k: int = 20, modulus: int = 20, share: float | None = WALKED, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``modulus`` divides, the k rows found with the largest inner product.

    Vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor do
    rows without id. A row is not its own neighbour; rows that share its id count as itself, and
    rows that repeat id and vector count once. Vectors meet those of their dimension only.
    Scores are exact, of the vectors as doubles; nearest first, ties to the smaller id. With
    ``share`` None every cell is walked, which is exact.
    """
    scratch = Scratch(df.sparkSession, "multi-index")
    spark = df.sparkSession
    rows = vectors_of(df, key, embedding)
    entries = scratch.save(entries_of(rows, k), "entries")
    queries = scratch.save(rows.where(F.col("id") % modulus == 0).select("id", "node", "twin").distinct(), "queries")
    asked = scratch.save(entries.join(queries.select("node", "twin").distinct(), ["node", "twin"], "left_semi"), "asked")
    sizes = entries.groupBy(F.size("vector").alias("d")).count().collect()  # a row a dimension
    of = lambda t, d: t.where(F.size("vector") == d).select("node", "twin", "vector", "ids")
    found = [_search(of(entries, d), of(asked, d), d, n, k, share, scratch) for d, n in sizes]
    tops = functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], FOUND)
    best = merged(tops, k + 1)
    # A common vector is searched once; its rows get their lists here, less themselves.
    rest = F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("query_id"))
    joined = queries.withColumnRenamed("id", "query_id").join(best, ["node", "twin"])
    out = joined.select("query_id", F.explode(F.slice(rest, 1, k)).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(entries: DataFrame, asked: DataFrame, d: int, n: int, k: int, walked_share: float | None, scratch: Scratch) -> DataFrame:
    """(node, twin, ids, scores): for the vectors asked for, all of one dimension, the best of each block that they walk into."""
    spark = entries.sparkSession
    most = min(SAMPLE, max(256, SAMPLE_BYTES // (8 * d)))
    picked = entries if n <= most else entries.where(F.pmod(F.xxhash64("node"), F.lit(1 << 40)) < int(most / n * (1 << 40)) + 1).limit(2 * most)
    sample = _matrix(picked.select("vector").toArrow().column("vector").combine_chunks())
    shared = spark.sparkContext.broadcast(Codebooks(sample, n, k))
    size = shared.value.size

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("multi-index")
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.cells(_matrix(b.column("vector")))), *b.columns], names=["cell", *b.schema.names])

    placed = scratch.save(entries.mapInArrow(coded, "cell long, node long, twin long, vector array<double>, ids array<long>"), f"placed-{d}")
    filled = np.zeros(size * size, dtype=np.int64)
    for cell, many in placed.groupBy("cell").count().collect():  # a row a cell: CENTROIDS squared at most
        filled[cell] = many
    first, many = _layout(filled, max(64, BLOCK_BYTES // (8 * d)))
    layout = spark.sparkContext.broadcast((filled.reshape(size, size), first, many, max(1, -(-asked.count() // SHARE))))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first_, many_, shares = layout.value
        for b in batches:
            if b.num_rows:
                cell = b.column("cell").to_numpy()
                block = first_[cell] + (b.column("node").to_numpy().view(np.uint64) % many_[cell].astype(np.uint64)).astype(np.int64)
                for share in range(shares):
                    yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.full(len(block), share)), *b.columns], names=["block", "share", *b.schema.names])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("multi-index")
        books, (filled_, first_, many_, shares) = shared.value, layout.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                q = _matrix(b.column("vector"))
                bounds = books.bounds(q)
                out: list[tuple[np.ndarray, np.ndarray]] = []
                cells: list[np.ndarray] = []
                for i in range(len(q)):
                    walked = np.sort(books.walk(q[i], float(bounds[i]), filled_, walked_share)) if walked_share is not None else np.flatnonzero(filled_)
                    spread = np.repeat(walked, many_[walked])
                    blocks = first_[spread] + np.arange(len(spread)) - np.searchsorted(spread, spread)
                    edges = np.flatnonzero(np.diff(blocks, prepend=-1))
                    cells += np.split(spread, edges[1:])
                    out.append((blocks[edges], np.full(len(edges), i)))
                block, i = (np.concatenate(x) for x in zip(*out))
                own = pa.array(i)
                share = (b.column("node").to_numpy().view(np.uint64) % np.uint64(shares)).astype(np.int64)[i]
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(share), *(b.column(c).take(own) for c in ("node", "twin", "vector")), pa.array(cells, pa.list_(pa.int64()))], names=["block", "share", "node", "twin", "vector", "list"])

    walks = asked.select("node", "twin", "vector").repartition(partitions(spark), "node").mapInArrow(ask, "block long, share long, node long, twin long, vector array<double>, list array<long>")
    held = placed.mapInArrow(put, "block long, share long, cell long, node long, twin long, vector array<double>, ids array<long>").withColumnRenamed("ids", "list")
    both = held.select("block", "share", F.lit(0).alias("side"), "cell", "node", "twin", "vector", "list").unionByName(walks.select("block", "share", F.lit(1).alias("side"), F.lit(-1).cast("long").alias("cell"), "node", "twin", "vector", "list"))
    ready = both.repartition(partitions(spark), "block", "share").sortWithinPartitions("block", "share", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("multi-index")
        now, held, x = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, share, side = (batch.column(c).to_numpy() for c in ("block", "share", "side"))
            edges = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (share[1:] != share[:-1]) | (side[1:] != side[:-1])])).tolist()
            for s, e in zip(edges, [*edges[1:], len(block)]):
                if now != (block[s], share[s]):
                    now, held, x = (block[s], share[s]), [], None
                part = batch.slice(s, e - s)
                if side[s] == 0:
                    held.append((part.column("cell").to_numpy(), _matrix(part.column("vector")), part.column("list")))
                elif held:
                    if x is None:
                        cell, x, ids = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pa.concat_arrays([h[2] for h in held])
                    for at in range(0, e - s, SLICE):
                        yield _best(part.slice(at, SLICE), cell, x, ids, k + 1)

    return ready.mapInArrow(compare, FOUND)


def merged(tops: DataFrame, k: int) -> DataFrame:
    """One row a vector of the rows of all blocks: its k best ids, ties to the smaller."""

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        node, twin = (table.column(c).to_numpy() for c in ("node", "twin"))
        ids, scores = (table.column(c).combine_chunks() for c in ("ids", "scores"))
        heads = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (twin[1:] != twin[:-1])]))
        group = np.cumsum(np.isin(np.arange(len(node)), heads)) - 1
        own, vec, score = np.repeat(group, np.diff(ids.offsets.to_numpy())), ids.flatten().to_numpy(), scores.flatten().to_numpy()
        order = np.lexsort((vec, -score, own))
        own, vec, score = own[order], vec[order], score[order]
        keep = np.arange(len(own)) - np.searchsorted(own, own) < k
        own, vec, score = own[keep], vec[keep], score[keep]
        ends = pa.array(np.searchsorted(own, np.arange(len(heads) + 1)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(node[heads]), pa.array(twin[heads]), pa.ListArray.from_arrays(ends, pa.array(vec)), pa.ListArray.from_arrays(ends, pa.array(score))], names=["node", "twin", "ids", "scores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("multi-index")
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                last = (batch.column("node").to_numpy() == batch.column("node")[-1].as_py()) & (batch.column("twin").to_numpy() == batch.column("twin")[-1].as_py())
                open_ = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0  # the last vector's rows may go on
                held.append(batch.slice(0, open_))
                if open_:
                    yield joined(held)
                    held = []
                held.append(batch.slice(open_))
        if held:
            yield joined(held)

    ready = tops.repartition(partitions(tops.sparkSession), "node", "twin").sortWithinPartitions("node", "twin")
    return ready.mapInArrow(run, FOUND)


def _best(asked: pa.RecordBatch, cell: np.ndarray, x: np.ndarray, ids: pa.Array, k: int) -> pa.RecordBatch:
    """For each vector asked for its best entries of one block, as k ids at most with exact products."""
    q = _matrix(asked.column("vector"))
    s = q @ x.T
    kinds, of = np.unique(cell, return_inverse=True)
    lists = asked.column("list")
    walked = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
    to = np.minimum(np.searchsorted(kinds, walked), len(kinds) - 1)
    real = kinds[to] == walked
    open_ = np.zeros((len(q), len(kinds)), dtype=bool)
    open_[row[real], to[real]] = True
    s[~open_[:, of]] = -np.inf
    take = min(len(x), k)
    last = -np.partition(-s, take - 1, axis=1)[:, take - 1 : take]  # all that tie with the last are taken: ids decide
    i, j = np.nonzero((s >= last - 1e-9 * (1 + np.abs(last))) & (s > -np.inf))
    exact = np.einsum("ij,ij->i", q[i], x[j])
    held = ids.take(pa.array(j))
    many = np.diff(held.offsets.to_numpy())
    query, vec, score = np.repeat(i, many), held.flatten().to_numpy(), np.repeat(exact, many)
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    query, vec, score = query[keep], vec[keep], score[keep]
    ends = pa.array(np.searchsorted(query, np.arange(len(q) + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays([asked.column("node"), asked.column("twin"), pa.ListArray.from_arrays(ends, pa.array(vec, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(score, pa.float64()))], names=["node", "twin", "ids", "scores"])
