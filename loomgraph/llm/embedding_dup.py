"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine c are sqrt(2 - 2c) apart. After a rotation the coordinates are
cut into low-dimensional blocks; if the squared distance of two vectors is within the
budget, then in at least one block it is within that block's share. So each block gets a
range join of its own: vectors go to the grid cell that they lie in and, as probes, to the
neighbouring cells within range. The union of what the blocks find is checked in double
precision on the whole vectors.

Equal vectors are one node from the start. Nodes are numbered in tiles of vectors that lie
close together; where many vectors of two tiles meet, the tiles' pair stands for all of
them and is checked as one matrix product, so a large group of close vectors gives a few
rows of tiles and sums of links, never all its pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, connected_components, mix64, partitions

#: Dimensions of a block, and of those the ones that its grid uses.
BLOCK, GRID = 8, 6
#: Width of a cell in block ranges.
WIDTH = 4.0
#: Vectors of a tile; hits of a slice between two tiles from which their pair stands for them.
TILE, DENSE = 256, 48
#: Probes compared with a cell at a time.
SLICE = 1024
#: Vectors at home in a cell that one task holds at a time.
CELL_ROWS = 4096
#: Allowance for rounding in the candidate search; the check itself has none.
EPS = 1e-5


@functools.lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    """A fixed random rotation in d dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


@functools.lru_cache(maxsize=8)
def blocks(d: int) -> list[tuple[int, int]]:
    """Column ranges of the blocks."""
    ends = np.linspace(0, d, max(1, round(d / BLOCK)) + 1).round().astype(int).tolist()
    return list(zip(ends, ends[1:]))


def _binary(a: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    a = np.ascontiguousarray(a)
    width = a.dtype.itemsize * a.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(len(a) + 1, dtype=np.int32) * width), pa.py_buffer(a)])


def _by_dimension(vectors: list[bytes], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix of float64) for each dimension among vectors of one kind of numbers."""
    sizes = np.array([len(v) for v in vectors]) // np.dtype(kind).itemsize
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, np.frombuffer(b"".join([vectors[i] for i in at]), dtype=kind).reshape(len(at), d).astype(np.float64)


def kind_of(df: DataFrame, embedding: str) -> tuple[str, str]:
    """(numpy kind, Spark type) in which vectors are held: floats stay floats, all else is double."""
    narrow = df.schema[embedding].dataType.elementType.typeName() == "float"
    return ("<f4", "float") if narrow else ("<f8", "double")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def named(df: DataFrame, key: str, embedding: str, label: str, number: str) -> DataFrame:
    """(vec_id, label, node, twin, vector) of every row; node and twin are two hashes of label and vector, null in rows that link with nothing.

    ``label`` numbers the labels: whole numbers as they are, values of other types by a hash of the typed value.
    """
    v = F.transform(F.col(embedding), lambda x: F.when(x.cast(number) == 0, F.lit(0.0).cast(number)).otherwise(x.cast(number)))
    finite = F.size("_v") > 0
    finite &= ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("_v", lambda x: x != 0)
    kind = df.schema[label].dataType.typeName()
    own = F.col(label) + F.lit(0.0).cast(kind) if kind in ("float", "double") else F.col(label)  # no negative zero
    own = own.cast("long") if kind in ("byte", "short", "integer", "long") else F.when(own.isNotNull(), F.xxhash64(own))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), own.alias("label"), v.alias("_v"))
    links = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    return rows.select("vec_id", "label", F.when(links, F.xxhash64("label", "_v")).alias("node"), F.when(links, F.xxhash64(F.lit(1), "label", "_v")).alias("twin"), F.col("_v").alias("vector"))


def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, twin, least, label, copies, vector): distinct vectors with a label, their least id and how often they occur."""
    return rows.where("node IS NOT NULL").groupBy("node", "twin").agg(F.any_value("label").alias("label"), F.any_value("vector").alias("vector"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))


def tiled(nodes: DataFrame, kind: str) -> DataFrame:
    """(tile, node, label, copies, vector): close vectors of a label stand in one tile."""
    spark = nodes.sparkSession
    coded = pa.schema([("node", pa.int64()), ("label", pa.int64()), ("copies", pa.int64()), ("place", pa.int64()), ("vector", pa.binary())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(v, dtype=kind).tobytes() for v in batch.column("vector").to_pylist()]
            place = np.zeros(len(raw), dtype=np.int64)
            for at, x in _by_dimension(raw, kind):
                y = _unit(x) @ rotation(x.shape[1])[:, :6]
                # Signs and sizes of the first coordinates: neighbours mostly share them.
                cells = np.clip(np.floor(y * math.sqrt(x.shape[1]) * 1.5) + 8, 0, 15).astype(np.int64)
                place[at] = (cells * 16 ** np.arange(cells.shape[1])).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), batch.column("copies"), pa.array(place), pa.array(raw, pa.binary())], schema=coded)

    out = pa.schema([("tile", pa.int64()), *coded])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            tile = base + (done + np.arange(batch.num_rows)) // TILE
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(tile), *batch.columns], schema=out)

    rows = nodes.select("node", "label", "copies", "vector").mapInArrow(code, "node long, label long, copies long, place long, vector binary")
    ordered = rows.repartitionByRange(partitions(spark), "label", "place", "node").sortWithinPartitions("label", "place", "node")
    return ordered.mapInArrow(number, "tile long, node long, label long, copies long, place long, vector binary").drop("place")


def block_rows(nodes: DataFrame, budget: float, kind: str) -> DataFrame:
    """(cell, home, tile, node, block) for every block and every cell within range of a vector."""
    schema = pa.schema([("cell", pa.int64()), ("home", pa.bool_()), ("tile", pa.int64()), ("node", pa.int64()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile, node, label = (batch.column(n).to_numpy() for n in ("tile", "node", "label"))
            for at, x in _by_dimension(batch.column("vector").to_pylist(), kind):
                d = x.shape[1]
                y = _unit(x) @ rotation(d)
                for number, (a, b) in enumerate(blocks(d)):
                    r = math.sqrt(budget * (b - a) / d + EPS)
                    part = y[:, a:b]
                    g = part[:, :GRID] / (WIDTH * r)
                    home = np.floor(g)
                    inside = g - home
                    step = np.where(inside < 0.5, -1, 1)
                    away = (np.minimum(inside, 1 - inside) * WIDTH * r) ** 2
                    start = mix64(label[at].astype(np.uint64) * np.uint64(4096) + np.uint64(d * 64 + number))
                    for mask in range(1 << g.shape[1]):
                        bits = np.array([mask >> i & 1 for i in range(g.shape[1])])
                        near = np.flatnonzero(away @ bits <= r * r)
                        if len(near):
                            cell = start[near]
                            for c in (home[near] + step[near] * bits).T:
                                cell = mix64(cell * np.uint64(31) + c.astype(np.int64).view(np.uint64))
                            own = at[near]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(cell.view(np.int64)), pa.array(np.full(len(near), mask == 0)), pa.array(tile[own]), pa.array(node[own]), _binary(part[near].astype(np.float32))], schema=schema
                            )

    return nodes.select("tile", "node", "label", "vector").mapInArrow(run, "cell long, home boolean, tile long, node long, block binary")


def block_hits(rows: DataFrame, budget: float, d: int) -> DataFrame:
    """(tile_a, tile_b, a, b) of vectors within range in a block; a and b are null where the tiles stand for many.

    Cells with many vectors at home are split; their probes go to every part.
    """
    spark = rows.sparkSession
    schema = pa.schema([("tile_a", pa.int64()), ("tile_b", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        homes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            cell, part, home, tile, node = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "part", "home", "tile", "node"))
            blocks_ = batch.column("block").to_pylist()
            width = np.array(list(map(len, blocks_)))
            edges = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (width[1:] != width[:-1])]))
            found: list[tuple[np.ndarray, ...]] = []
            for s, e in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows]):
                if group != (cell[s], part[s], width[s]):
                    group, homes = (cell[s], part[s], width[s]), []
                x = np.frombuffer(b"".join(blocks_[s:e]), dtype="<f4").reshape(e - s, -1)
                own = home[s:e]
                if own.any():
                    homes.append((x[own], node[s:e][own], tile[s:e][own]))
                if not homes:
                    continue
                hx, hn, ht = homes[0] if len(homes) == 1 else (np.concatenate(z) for z in zip(*homes))
                limit = budget * (width[s] // 4) / d + EPS
                for at in range(s, e, SLICE):
                    to = min(e, at + SLICE)
                    found += _slice_hits(x[at - s : to - s], node[at:to], tile[at:to], hx, hn, ht, limit)
                    if sum(len(f[0]) for f in found) >= 200_000:
                        yield _condensed(found, schema)
                        found = []
            if found:
                yield _condensed(found, schema)

    counts = rows.where("home").groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts"))
    # Cells where nothing is at home fall out here; most cells have one part.
    dealt = rows.join(counts, "cell").withColumn("part", F.explode(F.when(F.col("home"), F.array(F.pmod(F.xxhash64("node"), "parts").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    # A vector at home meets the others at home there too: in other parts as a probe.
    others = rows.where("home").join(counts.where("parts > 1"), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where(F.col("part") != F.pmod(F.xxhash64("node"), "parts"))
    names = ("cell", "part", "home", "tile", "node", "block")
    ready = dealt.select(*names).unionByName(others.withColumn("home", F.lit(False)).select(*names))
    return ready.repartition(partitions(spark), "cell", "part").sortWithinPartitions("cell", "part", F.desc("home")).mapInArrow(run, "tile_a long, tile_b long, a long, b long")


def _slice_hits(x: np.ndarray, n: np.ndarray, t: np.ndarray, hx: np.ndarray, hn: np.ndarray, ht: np.ndarray, limit: float) -> list[tuple[np.ndarray, ...]]:
    """(tile_a, tile_b, a, b), a < b, of probes and vectors at home within range; -1 for both where two tiles have DENSE hits or more.

    Such hits are summed as a matrix and never listed.
    """
    if len(hn) * len(n) > DENSE:  # pairs of tiles are then blocks of the matrix
        order, own = np.argsort(ht, kind="stable"), np.argsort(t, kind="stable")
        hx, hn, ht, x, n, t = hx[order], hn[order], ht[order], x[own], n[own], t[own]
    near = (x * x).sum(1)[:, None] + (hx * hx).sum(1)[None, :] - 2 * (x @ hx.T) <= limit
    near &= n[:, None] < hn[None, :]  # each of two vectors within range probes the other's cell: one of them tells
    out = []
    if np.count_nonzero(near) >= DENSE:
        rows, cols = np.flatnonzero(np.diff(t, prepend=t[0] - 1)), np.flatnonzero(np.diff(ht, prepend=ht[0] - 1))
        many = np.add.reduceat(np.add.reduceat(near, cols, axis=1, dtype=np.int32), rows, axis=0) >= DENSE
        if many.any():
            i, j = np.nonzero(many)
            none = np.full(len(i), -1, dtype=np.int64)
            out.append((t[rows[i]], ht[cols[j]], none, none))
            near &= ~np.repeat(np.repeat(many, np.diff([*rows, len(t)]), axis=0), np.diff([*cols, len(ht)]), axis=1)
    i, j = np.nonzero(near)
    return [*out, (t[i], ht[j], n[i], hn[j])] if len(i) else out


def _condensed(found: list[tuple[np.ndarray, ...]], schema: pa.Schema) -> pa.RecordBatch:
    """Hits, the lesser tile first, once each; a and b are null for whole pairs of tiles."""
    ta, tb, a, b = (np.concatenate(z) for z in zip(*found))
    rows = np.unique(np.stack([np.minimum(ta, tb), np.maximum(ta, tb), a, b], axis=1), axis=0)
    whole = rows[:, 2] < 0
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2], mask=whole), pa.array(rows[:, 3], mask=whole)], schema=schema)


def _checked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x and y reach the cosine, in double precision (matrix)."""
    return (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]) >= cosine


def sparse_links(pairs: DataFrame, nodes: DataFrame, cosine: float, kind: str) -> DataFrame:
    """(node, links, other) twice for every pair that holds: the number of rows linked, and the other end."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            va, vb = batch.column("v_a").to_pylist(), batch.column("v_b").to_pylist()
            x_ok = np.zeros(len(va), dtype=bool)
            same = np.array([len(p) == len(q) for p, q in zip(va, vb)], dtype=bool) & (batch.column("l_a").to_numpy() == batch.column("l_b").to_numpy())
            for at, x in _by_dimension(va, kind):
                at_same = same[at]
                own = at[at_same]
                if len(own):
                    x, y = x[at_same], np.frombuffer(b"".join([vb[i] for i in own]), dtype=kind).reshape(len(own), -1).astype(np.float64)
                    x_ok[own] = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= cosine
            at = np.flatnonzero(x_ok)
            a, b, na, nb = (batch.column(n).to_numpy()[at] for n in ("a", "b", "n_a", "n_b"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in ((a, b), (nb, na), (b, a))], schema=schema)

    side = lambda s: nodes.select(F.col("node").alias(s), F.col("vector").alias(f"v_{s}"), F.col("copies").alias(f"n_{s}"), F.col("label").alias(f"l_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "node long, links long, other long")


def dense_links(tile_pairs: DataFrame, nodes: DataFrame, cosine: float, kind: str) -> DataFrame:
    """As ``sparse_links`` for whole pairs of tiles: per node the sum of rows linked and one end that keeps it connected.

    Vectors come as rows in the order of pairs of tiles; a task holds the two tiles of one pair.
    """
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
    kept = ("node", "copies", "label")

    def compared(once: bool, side: np.ndarray, vectors: list[bytes], node: np.ndarray, copies: np.ndarray, label: np.ndarray) -> pa.RecordBatch | None:
        i = np.flatnonzero(side == 0)
        j = i if once else np.flatnonzero(side == 1)
        hit = np.zeros((len(i), len(j)), dtype=bool)
        for at, x in _by_dimension([vectors[k] for k in i], kind):
            for to, y in _by_dimension([vectors[k] for k in j], kind):
                if x.shape[1] == y.shape[1]:
                    hit[np.ix_(at, to)] = _checked(x, y, cosine)
        hit &= label[i][:, None] == label[j][None, :]
        if once:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return None
        # Least node reachable within the two tiles.
        ra, rb = node[i], node[j]
        big = np.iinfo(np.int64).max
        while True:
            qa = np.minimum(ra, np.where(hit, rb[None, :], big).min(1))
            qb = np.minimum(rb, np.where(hit, qa[:, None], big).min(0))
            if (qa == ra).all() and (qb == rb).all():
                break
            ra, rb = qa, qb
        out = [(node[i], hit @ copies[j], ra)]
        if not once:
            out.append((node[j], copies[i] @ hit, rb))
        cols = [np.concatenate(z) for z in zip(*out)]
        own = cols[1] > 0
        return pa.RecordBatch.from_arrays([pa.array(c[own].astype(np.int64)) for c in cols], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = None, []

        def finished() -> Iterator[pa.RecordBatch]:
            if held and (made := compared(pair[0] == pair[1], np.concatenate([h[0] for h in held]), [v for h in held for v in h[1]], *(np.concatenate([h[k] for h in held]) for k in (2, 3, 4)))) is not None:
                yield made

        for batch in batches:
            if not batch.num_rows:
                continue
            ta, tb, side, *cols = (batch.column(n).to_numpy() for n in ("tile_a", "tile_b", "side", *kept))
            vectors = batch.column("vector").to_pylist()
            edges = np.flatnonzero(np.concatenate([[True], (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])])).tolist()
            for s, e in zip(edges, [*edges[1:], batch.num_rows]):
                if pair != (ta[s], tb[s]):
                    yield from finished()
                    pair, held = (ta[s], tb[s]), []
                held.append((side[s:e], vectors[s:e], *(c[s:e] for c in cols)))
        yield from finished()

    both = tile_pairs.select("tile_a", "tile_b", F.lit(0).alias("side"), F.col("tile_a").alias("tile")).unionByName(tile_pairs.where("tile_a <> tile_b").select("tile_a", "tile_b", F.lit(1).alias("side"), F.col("tile_b").alias("tile")))
    rows = both.join(nodes, "tile").select("tile_a", "tile_b", "side", *kept, "vector")
    ready = rows.repartition(partitions(nodes.sparkSession), "tile_a", "tile_b").sortWithinPartitions("tile_a", "tile_b")
    return ready.mapInArrow(run, "node long, links long, other long")


def classes(df: DataFrame, cosine: float = 0.98, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Vectors with equal labels are linked at ``cosine`` or more. Null, empty, zero or
    non-finite vectors, and rows without label or id, link with nothing. Vectors of
    different dimensions are not linked. Rows that share an id count as rows of their own.
    Labels are equal as values of their type. Vectors of floats are compared as floats taken
    to doubles, all others as doubles.
    """
    scratch = Scratch(df.sparkSession, "embedding-dup")
    budget = 2 - 2 * cosine
    kind, number = kind_of(df, embedding)
    rows = named(df, key, embedding, label, number)
    distinct = scratch.save(nodes_of(rows), "distinct")
    nodes = scratch.save(tiled(distinct, kind), "nodes")
    parts = []
    sizes = [d for (d,) in nodes.select((F.octet_length("vector") / np.dtype(kind).itemsize).cast("int")).distinct().collect()]  # a row a dimension
    for d in sizes:
        own = nodes.where(F.octet_length("vector") == np.dtype(kind).itemsize * d)
        parts.append(block_hits(scratch.save(block_rows(own, budget, kind), f"blocks-{d}"), budget, d))
    kinds = "tile_a long, tile_b long, a long, b long"
    hits = scratch.save(functools.reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], kinds), "hits")
    dense = scratch.save(hits.where("a is null").select("tile_a", "tile_b").distinct(), "dense")
    sparse = hits.where("a is not null").join(dense, ["tile_a", "tile_b"], "left_anti").select("a", "b").distinct()
    links = scratch.save(sparse_links(sparse, nodes, cosine, kind).unionByName(dense_links(dense, nodes, cosine, kind)), "links")
    labels = connected_components(links.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct())
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    linked = labels.join(distinct.select("node", "least"), "node")
    first = linked.groupBy("component").agg(F.min("least").alias("first"))  # the least id of a component
    state = scratch.save(distinct.join(degree, "node", "left").join(linked.join(first, "component").select("node", "first"), "node", "left").select(
        "node", "twin", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "least").alias("component_id")
    ), "state")
    out = rows.select("vec_id", "node", "twin").join(state, ["node", "twin"], "left")
    cid = F.coalesce("component_id", "vec_id")
    scratch.drop(*(f"blocks-{d}" for d in sizes), "hits", "dense")
    return out.select(F.col("vec_id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), F.coalesce(F.col("vec_id") == cid, F.lit(True)).alias("kept"))
