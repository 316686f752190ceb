"""Pairs within a distance, exactly: joins in metric spaces by parts that know their range.

Rows have coordinates of which no two may differ by more than a limit in a pair: for unit
vectors the angles to pivots (the triangle inequality), for names the logarithm of the
length. Rows are dealt to cells and stand in an order there; a cell is cut into parts of
equal size, and a part knows the range of each coordinate. Two parts meet only where no
coordinate keeps their ranges further apart than the limit, first told for whole cells, then
for their parts, so pairs of parts that cannot hold a result are never made. Parts that meet
are compared as matrices. All tasks hold two parts of bounded size, whatever the groups are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.scratch import stored

#: Numbers of pivots that are tried, and how many of their ranges pairs of parts are told apart by.
PIVOTS, KNOWN = (1, 4, 16, 64, 256), 16
#: Vectors of the sample that pivots and principal coordinates come from, and its most bytes.
SAMPLE, SAMPLE_BYTES = 4096, 32 << 20
#: Rows and bytes of a part, at most, and parts at least; bytes of data in a row on the way to a task.
PART_ROWS, PART_BYTES, PARTS, CHUNK_BYTES = 4096, 2 << 20, 16, 4 << 10
#: Dimensions from which principal coordinates are tried first, and up to which they are fitted.
LONG, LONGEST = 16, 512
#: Allowance for rounding of angles and bounds; the limit itself has none.
EPS = 1e-6
#: The same for bounds in single precision, whose products of unit vectors err by less than a tenth of it.
ROUGH = 1e-4


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sample(vectors: DataFrame, d: int, n: int) -> np.ndarray:
    most = max(256, min(SAMPLE, SAMPLE_BYTES // (8 * d)))
    share = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 40)) < int(most / n * (1 << 40)) + 1
    got = (vectors if n <= most else vectors.where(share).limit(2 * most)).select("x").toArrow().column("x").combine_chunks()
    return _rows(got) if len(got) else _rows(vectors.select("x").limit(1).toArrow().column("x").combine_chunks())


def _far_apart(x: np.ndarray, most: int) -> np.ndarray:
    """Rows each of which is the furthest from those before it; fewer where rows repeat."""
    own, near = [0], x @ x[0]
    while len(own) < most and near.min() < 1 - 1e-9:
        own.append(int(near.argmin()))
        near = np.maximum(near, x @ x[own[-1]])
    return x[own]


def similar_pairs(vectors: DataFrame, above: float, key: str, vector: str, by: str | None = None) -> DataFrame:
    """(a, b, similarity), a < b: pairs of rows with equal ``by`` whose unit vectors have a cosine over ``above``.

    Pivots are picked far apart from a bounded sample; cells hold what is nearest to one.
    ``vector`` holds arrays of doubles of length one. Null or empty vectors, null keys and
    null groups have no pairs, and vectors meet those of their own dimension. Keys are unique.
    """
    rows = vectors.select(F.col(key).alias("key"), (F.col(by) if by else F.lit(0)).alias("g"), F.col(vector).alias("x"))
    rows = stored(rows.where((F.size("x") > 0) & F.col("key").isNotNull() & F.col("g").isNotNull()))
    spark = rows.sparkSession
    kind = rows.schema["key"].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("similarity", T.DoubleType())]))
    for d, n in rows.groupBy(F.size("x").alias("d")).count().collect():  # a row a dimension
        out = out.unionByName(_of_dimension(rows.where(F.size("x") == d), d, n, above, kind.simpleString()))
    return out


def _chosen(sample: np.ndarray, n: int, limit: float, part_rows: int) -> np.ndarray:
    """As many pivots as make the least work by the sample: pairs of rows whose cells meet, dearer in small cells, whose rows go to more tasks."""
    pivots = _far_apart(sample, min(PIVOTS[-1], max(1, n // 64)))
    angle = np.arccos(np.clip(sample @ pivots.T, -1.0, 1.0))
    best, at = math.inf, 1
    for k in sorted({min(k, len(pivots)) for k in PIVOTS}):
        cell = angle[:, :k].argmin(1)
        full, size = np.unique(cell, return_counts=True)
        low, high = (np.stack([f(angle[cell == c, :k], axis=0) for c in full]) for f in (np.min, np.max))
        met = _meet(low, high, limit)
        work = (size @ met @ size) / len(sample) ** 2 * (1 + PART_ROWS / min(part_rows, max(1, n // k)))
        if work < best:
            best, at = work, k
    return pivots[:at]


def _meet(low: np.ndarray, high: np.ndarray, limit: float) -> np.ndarray:
    """Which rows of ranges are nowhere further apart than the limit (matrix)."""
    out = np.ones((len(low), len(low)), dtype=bool)
    for i in range(low.shape[1]):
        out &= (low[:, None, i] - high[None, :, i] <= limit) & (low[None, :, i] - high[:, None, i] <= limit)
    return out


def _of_dimension(rows: DataFrame, d: int, n: int, above: float, kind: str) -> DataFrame:
    sample = _sample(rows, d, n)
    limit = math.acos(max(-1.0, min(1.0, above))) + EPS
    size = int(np.clip(n // PARTS, 128, max(128, min(PART_ROWS, PART_BYTES // (8 * d)))))
    pivots = _chosen(sample, n, limit, size)
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, : max(4, d // 4)].copy() if LONG <= d <= LONGEST else None

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.ascontiguousarray(_rows(b.column("x")))
                angle = np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))
                cell = angle.argmin(1)
                data = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * (8 * d)), pa.py_buffer(x)])
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), b.column("g"), pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell]), _lists(angle), data], names=["key", "g", "cell", "ring", "at", "data"]
                )

    def compare(left: Side, right: Side | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        x, y = (np.frombuffer(b"".join(s.data), dtype=np.float64).reshape(-1, d) for s in (left, right or left))
        yield from _above(x, y, right is None, above, axes)

    placed = rows.mapInArrow(place, f"key {kind}, g {rows.schema['g'].dataType.simpleString()}, cell int, ring double, at array<double>, data binary")
    return pairs_of_parts(placed, limit, size, max(1, CHUNK_BYTES // (8 * d)), compare, own=True)


def _lists(x: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


class Side(NamedTuple):
    """One part in a task: its keys and what each row holds."""

    keys: pa.Array
    data: list[bytes]


def pairs_of_parts(placed: DataFrame, limit: float, part_rows: int, chunk: int, compare: Callable[[Side, Side | None], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], own: bool = False) -> DataFrame:
    """(a, b, similarity), a < b, of rows that ``compare`` finds between parts that meet.

    ``placed(key, g, cell, ring, at, data)``: only rows of equal ``g`` meet; ``cell`` is one of few,
    ``ring`` orders it, ``at`` has a bounded number of coordinates; with ``own`` the coordinate number
    ``cell`` is the cell's own. ``compare`` gets two parts, or one and None for a part against
    itself, and gives (places, places, similarities), each pair once.
    """
    spark = placed.sparkSession
    kind, group = (placed.schema[c].dataType.simpleString() for c in ("key", "g"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of parts, and a row with the ranges of each part where it ends: with its group, its cell or its last row."""
        number, size, last, low, high = TaskContext.get().partitionId() << 32, 0, None, None, None
        schema = None

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number]), last[0], pa.array([last[1]], pa.int32()), pa.array([None], schema.field("keys").type), pa.array([None], schema.field("data").type), _lists(low[None]), _lists(high[None])], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            cell = b.column("cell").to_numpy()
            g = b.column("g").dictionary_encode().indices.to_numpy()
            at = _rows(b.column("at"))
            schema = pa.schema([("keys", pa.list_(b.column("key").type)), ("data", pa.list_(b.column("data").type))])
            new = np.concatenate([[last is None or last[0][0].as_py() != b.column("g")[0].as_py() or last[1] != cell[0]], (cell[1:] != cell[:-1]) | (g[1:] != g[:-1])])
            start = 0
            while start < b.num_rows:
                if new[start] or size == part_rows:
                    if last is not None:
                        yield ended()
                    number, size, low, high = number + 1, 0, at[start].copy(), at[start].copy()
                later = np.flatnonzero(new[start + 1 :])
                end = min(start + part_rows - size, start + 1 + int(later[0]) if len(later) else b.num_rows)
                edges = np.append(np.arange(start, end, chunk), end)
                low, high = np.minimum(low, at[start:end].min(0)), np.maximum(high, at[start:end].max(0))
                ends, first = pa.array((edges - start).astype(np.int32)), pa.array(edges[:-1])
                none = pa.nulls(len(first), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), number)), b.column("g").take(first), b.column("cell").take(first), *(pa.ListArray.from_arrays(ends, b.column(c).slice(start, end - start)) for c in ("key", "data")), none, none], names=names
                )
                size, last, start = size + end - start, (b.column("g").slice(start, 1), int(cell[start])), end
        if last is not None:
            yield ended()

    names = ["part", "g", "cell", "keys", "data", "low", "high"]
    ordered = placed.repartitionByRange("g", "cell", "ring", "key").sortWithinPartitions("g", "cell", "ring", "key")
    table = stored(ordered.mapInArrow(cut, f"part long, g {group}, cell int, keys array<{kind}>, data array<binary>, low array<double>, high array<double>"))
    chunks, parts = table.where("keys IS NOT NULL"), table.where("keys IS NULL").select("part", "g", "cell", "low", "high")
    each = parts.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("i", "x")).groupBy("cell", "i").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    box = each.orderBy("cell", "i").toArrow()  # few cells times few coordinates, as above
    cells = np.unique(box.column("cell").to_numpy()) if box.num_rows else np.zeros(0, np.int32)
    met = np.argwhere(np.triu(_meet(*(box.column(c).to_numpy().reshape(len(cells), -1) for c in ("low", "high")), limit))) if len(cells) else []
    near = spark.createDataFrame([(int(cells[i]), int(cells[j])) for i, j in met], "cell_a int, cell_b int")
    known = min(KNOWN, box.num_rows // max(1, len(cells)))
    side = lambda s: parts.select(*(F.col(c).alias(f"{c}_{s}") for c in parts.columns))
    gaps = [F.get(f"low_{p}", i) - F.get(f"high_{q}", i) for i in [*map(F.lit, range(known)), *([F.col("cell_a"), F.col("cell_b")] if own else [])] for p, q in (("a", "b"), ("b", "a"))]
    pairs = side("a").join(F.broadcast(near), "cell_a").withColumnRenamed("g_a", "g_b").join(side("b"), ["g_b", "cell_b"])
    pairs = pairs.where((F.col("cell_a") < F.col("cell_b")) | (F.col("part_a") <= F.col("part_b")))
    pairs = stored((pairs.where(F.greatest(*gaps, F.lit(0.0)) <= limit) if gaps else pairs).select("part_a", "part_b"))
    left = pairs.withColumn("part", F.col("part_a")).withColumn("side", F.lit(0))
    right = pairs.where("part_a <> part_b").withColumn("part", F.col("part_b")).withColumn("side", F.lit(1))
    both = left.unionByName(right).join(chunks.select("part", "keys", "data"), "part").drop("part")
    ready = both.repartition("part_a", "part_b").sortWithinPartitions("part_a", "part_b", "side")

    def found(held: list[tuple[int, pa.Array, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        sides = [Side(pa.concat_arrays([h[1] for h in held if h[0] == s]), [x for h in held if h[0] == s for x in h[2]]) if any(h[0] == s for h in held) else None for s in (0, 1)]
        for i, j, s in compare(sides[0], sides[1]):
            if len(i):
                a, b = sides[0].keys.take(pa.array(i)), (sides[1] or sides[0]).keys.take(pa.array(j))
                less = pc.less(a, b)
                yield pa.RecordBatch.from_arrays([pc.if_else(less, a, b), pc.if_else(less, b, a), pa.array(s)], names=["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            one, two, of = (b.column(c).to_numpy() for c in ("part_a", "part_b", "side"))
            edges = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (of[1:] != of[:-1])])).tolist()
            for s, e in zip(edges, [*edges[1:], b.num_rows]):
                if pair != (one[s], two[s]):
                    yield from found(held)
                    pair, held = (one[s], two[s]), []
                held.append((int(of[s]), b.column("keys").slice(s, e - s).flatten(), b.column("data").slice(s, e - s).flatten().to_pylist()))
        yield from found(held)

    return ready.mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def _above(x: np.ndarray, y: np.ndarray, once: bool, above: float, axes: np.ndarray | None, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and cosines over the limit between two parts.

    Leading principal coordinates come first, in single precision, with the length of what
    remains as one more: that product bounds the cosine, and where it leaves few pairs only
    those are finished.
    """
    if axes is not None:
        short = [np.column_stack([h := v @ axes, np.sqrt(np.maximum(0.0, (v * v).sum(1) - (h * h).sum(1)))]).astype(np.float32) for v in (x, y)]
    for at in range(0, len(x), step):
        to = min(len(x), at + step)
        if axes is not None:
            may = short[0][at:to] @ short[1].T > np.float32(above - ROUGH)
            if np.count_nonzero(may) * 8 <= may.size:
                i, j = np.nonzero(may)
                i += at
                if once:
                    i, j = i[i < j], j[i < j]
                s = np.einsum("ij,ij->i", x[i], y[j])
                yield i[s > above], j[s > above], s[s > above]
                continue
        product = x[at:to] @ y.T
        i, j = np.nonzero(product > above)
        s = product[i, j]
        i += at
        yield (i[i < j], j[i < j], s[i < j]) if once else (i, j, s)
