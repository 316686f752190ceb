"""Projections, two-hop scores, co-occurrence, components, communities, cliques, merging."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import arrays
from loomgraph.functions.scratch import release, stored

#: What community functions return.
NODE = "node string, cluster string"


#: Rows of a group in one part; a group's pairs are dealt to tasks as pairs of parts.
PART_ROWS = 1000
#: Pairs that a task makes, about: what it sums of them is bounded so.
TASK_PAIRS = 4_000_000
#: Links that one task joins into components; links from which a node is a hub; the most hubs there can be.
SMALL_EDGES, HUB_LINKS, MOST_HUBS = 200_000, 100_000, 1_000_000
#: Edges of a component that one task takes on; beyond, functions that work by component refuse.
MOST_EDGES = 5_000_000
#: Edges of a component that one task takes on for communities, 40 bytes or so each; links up to which plain tables of them are quicker than arrays.
MOST_GROUPED, FEW_LINKS = 20_000_000, 2_000
#: Bytes up to which a component's neighbours are always kept as bits; nodes up to which a layer's neighbours are joined ahead.
BITS_BYTES, WIDE_LAYER = 64 << 20, 256
#: Edges up to which a task has a component's links to find cliques; pairs of links at a node for a task, about; edges that a component's tasks have in all, if it is small.
WHOLE_EDGES, TASK_WEDGES, TASK_EDGES = 20_000_000, 1_000_000, 2_000_000


def pairs_within(df: DataFrame, by: str, key: str) -> DataFrame:
    """All pairs of rows that agree in ``by``, columns of the lesser key suffixed _a, of the other _b.

    A group is cut into parts of PART_ROWS; the join runs on pairs of parts, so a hub's
    pairs are spread over tasks, as many as the counted pairs ask for. Rows must not repeat
    a key within a group. ``df`` is read for the count first.
    """
    n = df.groupBy(by).agg(F.count("*").cast("double").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]
    dealt = lambda side: side.repartition(int(n // TASK_PAIRS), "_g", "_i", "_j") if n >= 2 * TASK_PAIRS else side
    sizes = df.groupBy(by).agg(F.count("*").alias("_rows")).where("_rows > 1").select(by, F.ceil(F.col("_rows") / PART_ROWS).cast("int").alias("_parts"))
    own = df.join(sizes, by).withColumn("_p", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int"))
    others = [c for c in df.columns if c != by]
    left = own.withColumn("_q", F.explode(F.sequence("_p", F.col("_parts") - 1))).select(F.col(by).alias("_g"), F.col("_p").alias("_i"), F.col("_q").alias("_j"), *[F.col(c).alias(f"_l_{c}") for c in others])
    right = own.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_p")))).select(F.col(by).alias("_g"), F.col("_q").alias("_i"), F.col("_p").alias("_j"), *[F.col(c).alias(f"_r_{c}") for c in others])
    met = dealt(left).join(dealt(right), ["_g", "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col(f"_l_{key}") < F.col(f"_r_{key}")))
    turned = F.col(f"_l_{key}") > F.col(f"_r_{key}")
    low = [F.when(turned, F.col(f"_r_{c}")).otherwise(F.col(f"_l_{c}")).alias(f"{c}_a") for c in others]
    high = [F.when(turned, F.col(f"_l_{c}")).otherwise(F.col(f"_r_{c}")).alias(f"{c}_b") for c in others]
    return met.select(F.col("_g").alias(by), *low, *high)


def projection(edges: DataFrame, left: str = "from", right: str = "to") -> DataFrame:
    """(u, v, weight): pairs of left nodes, u < v, by their number of distinct shared right nodes."""
    e = stored(edges.select(F.col(left).alias("u"), F.col(right).alias("_n")).distinct())
    return pairs_within(e, "_n", "u").groupBy(F.col("u_a").alias("u"), F.col("u_b").alias("v")).agg(F.count("*").alias("weight"))


def shared_neighbours(pairs: DataFrame, edges: DataFrame, left: str = "from", right: str = "to") -> DataFrame:
    """``pairs(u, v)`` with their weight in the projection, 0 without a shared node, from the pairs' own neighbours.

    The projection is not built: work grows with the neighbours of the pairs asked for.
    """
    p = pairs.select("u", "v").distinct()
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("_n")).distinct()
    met = p.join(e, "u").join(e.withColumnRenamed("u", "v"), ["v", "_n"]).groupBy("u", "v").agg(F.count("*").alias("weight"))
    return pairs.join(met, ["u", "v"], "left").fillna(0, ["weight"])


def two_steps(pairs: DataFrame, edges: DataFrame, left: str = "from", right: str = "to") -> DataFrame:
    """``pairs(u, v)`` with ``weight``: for pairs at distance two in the projection the sum over nodes between of both links' weights, else 0.

    Neither the projection nor anybody's neighbours in it are listed. Nodes with equal
    neighbours are one class. With w and x the weights of the links from u and v to a node
    between, the sum of w + x is twice the sum of w * x, which is read from the sizes of
    meetings of two right nodes, less w * (x - 1) where x > 1 and x * (w - 1) where w > 1,
    and links of over 1 are found by the two right nodes that both ends share. Work grows
    with the sum of the squares of left nodes' degrees.
    """
    from loomgraph.operators.factored import twins

    e, heads, members = twins(edges, left, right)
    numbers = stored(e.select("_n").distinct().withColumn("g", F.monotonically_increasing_id()))
    own = stored(e.join(numbers, "_n").join(heads.select(F.col("twin").alias("u"), "size"), "u").select(F.col("u").alias("t"), "g", "size"))
    named = lambda end, twin: members.select(F.col("node").alias(end), F.col("twin").alias(twin))
    asked = stored(pairs.select("u", "v").where("u <> v").distinct().join(named("u", "a"), "u").join(named("v", "b"), "v"))
    apart = shared_neighbours(asked.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), own, "t", "g")
    p = stored(apart.where("weight = 0").select(F.col("u").alias("a"), F.col("v").alias("b")))
    meetings = stored(own.join(own.select("t", F.col("g").alias("h")), "t").where("g <= h"))
    sizes = meetings.groupBy("g", "h").agg(F.sum("size").alias("n"))
    places = p.join(own.select(F.col("t").alias("a"), F.col("g").alias("_g")), "a").join(own.select(F.col("t").alias("b"), F.col("g").alias("_h")), "b")
    places = places.select("a", "b", F.least("_g", "_h").alias("g"), F.greatest("_g", "_h").alias("h"))
    product = places.join(sizes, ["g", "h"]).groupBy("a", "b").agg((2 * F.sum("n")).alias("n"))
    heavy = pairs_within(meetings.where("g < h").select(F.struct("g", "h").alias("by"), "t", "size"), "by", "t").groupBy("t_a", "t_b", "size_a", "size_b").agg(F.count("*").alias("m"))
    heavy = heavy.withColumn("more", F.round((F.sqrt(1 + 8 * F.col("m")) - 1) / 2).cast("long"))  # k shared right nodes are k(k - 1)/2 pairs; k - 1
    heavy = stored(heavy.select(F.col("t_a").alias("x"), F.col("t_b").alias("t"), F.col("size_b").alias("size"), "more").unionAll(heavy.select("t_b", "t_a", "size_a", "more")))
    sides = p.select("a", "b", F.col("b").alias("x"), F.col("a").alias("y")).unionAll(p.select("a", "b", "a", "b")).join(heavy, "x")
    sides = stored(sides.groupBy("a", "b", F.col("y").alias("u"), F.col("t").alias("v")).agg(F.sum(F.col("size") * F.col("more")).alias("n")))
    linked = shared_neighbours(sides.select("u", "v").distinct(), own, "t", "g").where("weight > 0")
    less = sides.join(linked, ["u", "v"]).select("a", "b", (-F.col("n") * F.col("weight")).alias("n"))
    via = product.unionAll(less).groupBy("a", "b").agg(F.sum("n").alias("weight"))
    return pairs.join(asked.join(via, ["a", "b"]).select("u", "v", "weight"), ["u", "v"], "left").fillna(0, ["weight"])


def both_ways(weights: DataFrame) -> DataFrame:
    return weights.select("u", "v", "weight").unionAll(weights.select("v", "u", "weight"))


def one_hop(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """``pairs(u, v)`` with the weight of a direct link, 0 without one."""
    return pairs.join(both_ways(weights), ["u", "v"], "left").fillna(0, ["weight"])


def two_hop(weights: DataFrame) -> DataFrame:
    """(u, v, score) for pairs at distance exactly two: the sum over nodes between of both links' weights.

    Paths of two links are pairs of links within the node between, dealt to tasks by parts of it.
    """
    via = pairs_within(both_ways(weights).toDF("u", "p", "w"), "p", "u").select(F.col("u_a").alias("u"), F.col("u_b").alias("v"), (F.col("w_a") + F.col("w_b")).alias("w"))
    direct = weights.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return via.groupBy("u", "v").agg(F.sum("w").alias("score")).join(direct, ["u", "v"], "left_anti")


def phi_graph(edges: DataFrame, above: float = 0.0) -> DataFrame:
    """(a, b, phi): correlation of the incidences of two ``to`` nodes over all distinct ``from`` nodes.

    In closed form from degrees and shared neighbours; the matrix is never built. Pairs
    that share nothing are never positive.
    """
    e = stored(edges.select("from", "to").distinct())
    n = e.select("from").distinct().agg(F.count("*").cast("double").alias("n"))
    d = e.groupBy("to").agg(F.count("*").cast("double").alias("k"))
    shared = pairs_within(e, "from", "to").groupBy(F.col("to_a").alias("a"), F.col("to_b").alias("b")).agg(F.count("*").cast("double").alias("n11"))
    full = shared.join(d.toDF("a", "n1"), "a").join(d.toDF("b", "n2"), "b").join(F.broadcast(n))
    under = F.col("n1") * (F.col("n") - F.col("n1")) * F.col("n2") * (F.col("n") - F.col("n2"))
    return full.where(under > 0).select("a", "b", ((F.col("n") * F.col("n11") - F.col("n1") * F.col("n2")) / F.sqrt(under)).alias("phi")).where(F.col("phi") > above)


def cosine_graph(vectors: DataFrame, key: str, vector: str, by: str, above: float) -> DataFrame:
    """(a, b, similarity) of pairs within a group ``by`` whose cosine is over the limit: an exact metric join."""
    from loomgraph.operators.metric import similar_pairs

    v = vectors.select(F.col(by).alias("_by"), F.col(key).alias("k"), arrays.unit(F.transform(vector, lambda x: x.cast("double"))).alias("x"))
    return similar_pairs(v, above, "k", "x", "_by")


def indirect_edges(edges: DataFrame, edge_type: str, name: str) -> DataFrame:
    """Edges between nodes that share a neighbour over ``edge_type``, expanded from the factored projection, which ``factored.factored_projection`` gives itself."""
    from loomgraph.operators.factored import factored_projection

    p = factored_projection(edges.where(F.col("edgeType") == edge_type)).expand()
    return p.select(F.col("u").alias("from"), F.col("v").alias("to"), F.lit(name).alias("edgeType"), "weight")


def connected_components(edges: DataFrame, small: int = SMALL_EDGES, hub: int = HUB_LINKS) -> DataFrame:
    """(node, component): least node reachable, for every end of ``edges(from, to)`` that has another node beside itself.

    Large and small stars by turns: a node links its greater neighbours, then its lesser
    ones, to the least of them, until every node is linked to the least of its component
    alone. Each turn is a written table without repeated links, so lineage stays short. The
    rows of a node of over ``hub`` links do not go to that node's task: what a hub hands on
    is broadcast, and hubs are few since each takes its share of all links. Graphs of up to
    ``small`` links are joined in one task.
    """
    pairs = edges.select(F.col("from").alias("u"), F.col("to").alias("v")).where("u <> v")
    now = stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    links = now.count()
    if links <= small:
        made = stored(_joined_at_once(now))
        release(now)
        return made
    hub = max(hub, 2 * links // MOST_HUBS)
    mark = None
    while True:
        large, used = _star(now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), hub, large=True)
        large = stored(large)
        after, other = _star(large, hub, large=False)
        after = stored(after)
        release(now, large, used, other)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select("v", "v").distinct())
        mark = seen


def _star(links: DataFrame, hub: int, large: bool) -> tuple[DataFrame, DataFrame]:
    """One turn over ``links(u, v)``: (u, v), u > v, of neighbours and the least of a node's neighbours and itself; and a table that it reads.

    In a large turn links stand both ways and the greater neighbours are handed on; in a small turn
    u is the greater end, and all its neighbours and u itself are handed on.
    """
    least = stored(links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))
    far = links.where("v > u") if large else links
    hubs = F.broadcast(least.where(F.col("n") > hub).select("u", "m"))  # at most MOST_HUBS rows
    others = far.join(hubs, "u", "left_anti").join(least.where(F.col("n") <= hub).select("u", "m"), "u")
    made = far.join(hubs, "u").select("v", "m").unionAll(others.select("v", "m"))
    if not large:
        made = made.unionAll(least.select("u", "m"))
    return made.toDF("u", "v").where("u <> v").distinct(), least


def _joined_at_once(links: DataFrame) -> DataFrame:
    """Components of a counted, small number of links, in one task."""
    kind = links.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        ends = pa.concat_arrays([c for n in ("u", "v") for c in table.column(n).chunks])
        nodes = ends.unique().sort()
        place = pc.index_in(ends, nodes).to_numpy()
        a, b = place[: table.num_rows], place[table.num_rows :]
        label = np.arange(len(nodes))
        while True:
            was = label.copy()
            low = np.minimum(label[a], label[b])
            for side in (label[a], label[b], a, b):  # a label hands on what its nodes learn
                np.minimum.at(label, side, low)
            label = label[label]
            if (label == was).all():
                break
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], names=["node", "component"])

    return links.repartition(1).mapInArrow(run, f"node {kind}, component {kind}")


def _within_bounds(edges: DataFrame, parts: DataFrame, most: int) -> None:
    """Refuses a component with more edges than one task is to hold."""
    top = edges.join(parts, edges["a"] == parts["node"]).groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if top and top > most:
        raise ValueError(f"a component of {top} edges; at most {most} are worked on in one task")


def _greedy(nodes: list, links: dict, total: float, strength: dict) -> dict:
    """``_greedy_numbers`` on nodes by name, in order, and ``links[a, b]``: least nodes and their communities."""
    place = {v: i for i, v in enumerate(nodes)}
    found = _greedy_numbers([place[a] for a, _ in links], [place[b] for _, b in links], list(links.values()), [strength[v] for v in nodes], total)
    return {nodes[v]: {nodes[x] for x in vs} for v, vs in found.items()}


def _greedy_numbers(a: list[int], b: list[int], w: list[float], k: list[float], total: float) -> dict[int, list[int]]:
    """Communities of one component, nodes 0 to n - 1 of strength ``k``, by the best gain in modularity, with the whole graph's total weight.

    Gains wait in a heap, ties at the least pair; an entry that a merge has outdated is
    told by its gain and passed over. Once most entries are outdated the heap is made anew,
    so it holds a few entries a link at most.
    """
    n = len(k)
    own: dict[int, list[int]] = {v: [v] for v in range(n)}
    between: list[dict[int, float] | None] = [{} for _ in range(n)]
    links = 0
    for x, y, z in zip(a, b, w):
        if x != y:
            links += y not in between[x]
            between[x][y] = between[x].get(y, 0) + z
            between[y][x] = between[y].get(x, 0) + z

    def entry(x: int, y: int) -> tuple[float, int]:
        return (k[x] * k[y] / (2 * total * total) - between[x][y] / total, min(x, y) * n + max(x, y))

    def fresh() -> list[tuple[float, int]]:
        heap = [e for x in own for y in between[x] if x < y and (e := entry(x, y))[0] < -1e-12]
        heapq.heapify(heap)
        return heap

    heap = fresh()
    while heap:
        top = heapq.heappop(heap)
        x, y = divmod(top[1], n)
        if x not in own or y not in between[x] or entry(x, y) != top:
            continue
        own[x] += own.pop(y)
        k[x] += k[y]
        gone, between[y] = between[y], None
        links -= 1
        for c, z in gone.items():
            del between[c][y]
            if c != x:
                links -= c in between[x]
                between[x][c] = between[x].get(c, 0) + z
                between[c][x] = between[c].get(x, 0) + z
        for c in between[x]:
            if (e := entry(x, c))[0] < -1e-12:
                heapq.heappush(heap, e)
        if len(heap) > 2 * links + 10_000:
            heap = fresh()
    return own


class _Rows:
    """Communities with their links as rows of one pool, for ``_greedy_arrays``.

    A row's entries say to which community, with what weight, and where in the pool the
    other side of the link stands; an entry that a merge has taken away is to -1.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray, total: float):
        self.n, self.k, self.total, self.twice = len(k), np.array(k, dtype=np.float64), total, 2 * total * total
        apart = a != b
        key, at = np.unique(np.minimum(a, b)[apart].astype(np.int64) * self.n + np.maximum(a, b)[apart], return_inverse=True)
        z = np.bincount(at, w[apart], len(key))
        del at, apart
        m = len(key)
        one = np.empty(2 * m, dtype=np.int32)
        one[:m], one[m:] = np.divmod(key, self.n)
        order = np.argsort(one, kind="stable")
        place = np.empty(2 * m, dtype=np.int32)
        place[order] = np.arange(2 * m, dtype=np.int32)
        room = 2 * m + m // 2 + 1000
        self.to, self.w, self.mate = np.empty(room, dtype=np.int32), np.empty(room), np.empty(room, dtype=np.int32 if room < 1 << 30 else np.int64)
        self.to[: 2 * m] = np.roll(one, m)[order]
        self.w[: 2 * m] = np.concatenate([z, z])[order]
        self.mate[: 2 * m] = np.roll(place, m)[order]
        self.size = np.bincount(one, minlength=self.n)
        self.start, self.end = np.cumsum(self.size) - self.size, 2 * m
        self.slot = np.full(self.n, -1, dtype=np.int64)
        # A row's best gain, its pair, and what no other pair of the row is under; where ``lazy``, what no pair is under stands as the best until it is asked for.
        self.best, self.key, self.next, self.lazy = np.full(self.n, np.inf), np.zeros(self.n, dtype=np.int64), np.full(self.n, np.inf), np.zeros(self.n, dtype=bool)
        self._again(np.arange(self.n))

    def _gains(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gain in modularity, negative, and number of each pair; infinite where there is none to speak of."""
        y = self.to[at]
        gain = self.k[x] * self.k[y] / self.twice - self.w[at] / self.total
        return np.where((y >= 0) & (gain < -1e-12), gain, np.inf), np.minimum(x, y).astype(np.int64) * self.n + np.maximum(x, y)

    def _again(self, rows: np.ndarray, most: int = 2_000_000) -> None:
        """The best pair of each row, ties at the least pair, from all its entries."""
        self.best[rows], self.next[rows], self.lazy[rows] = np.inf, np.inf, False
        rows = rows[self.size[rows] > 0]
        for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(self.size[rows]) // most)) + 1):
            if len(part):
                n = self.size[part]
                at = np.repeat(self.start[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
                gain, key = self._gains(np.repeat(part, n), at)
                first = np.cumsum(n) - n
                self.best[part] = low = np.minimum.reduceat(gain, first)
                self.key[part] = own = np.minimum.reduceat(np.where(gain == np.repeat(low, n), key, np.iinfo(np.int64).max), first)
                self.next[part] = np.minimum.reduceat(np.where(key == np.repeat(own, n), np.inf, gain), first)

    def top(self) -> tuple[int, int] | None:
        while (low := self.best.min() if self.n else np.inf) < np.inf:
            rows = np.flatnonzero(self.best == low)
            if not self.lazy[rows].any():
                return divmod(int(self.key[rows].min()), self.n)
            self._again(rows[self.lazy[rows]])
        return None

    def _row(self, x: int, but: int) -> np.ndarray:
        at = np.arange(self.start[x], self.start[x] + self.size[x])
        return at[(self.to[at] >= 0) & (self.to[at] != but)]

    def _pack(self, room: int) -> None:
        """Leaves out entries that are gone, and makes room for more."""
        rows = np.flatnonzero(self.size)
        rows = rows[np.argsort(self.start[rows])]
        at = np.repeat(self.start[rows] - np.cumsum(self.size[rows]) + self.size[rows], self.size[rows]) + np.arange(self.size[rows].sum())
        of = np.repeat(rows, self.size[rows])[self.to[at] >= 0]
        at = at[self.to[at] >= 0]
        moved = np.empty(len(self.to), dtype=self.mate.dtype)
        moved[at] = np.arange(len(at))
        wide = max(len(self.to), len(at) + room)
        for name, values in (("to", self.to[at]), ("w", self.w[at]), ("mate", moved[self.mate[at]])):
            held = getattr(self, name) if wide == len(self.to) else np.empty(wide, dtype=values.dtype)
            held[: len(at)] = values
            setattr(self, name, held)
        self.size = np.bincount(of, minlength=self.n)
        self.start, self.end = np.zeros(self.n, dtype=np.int64), len(at)
        self.start[rows] = np.cumsum(self.size[rows]) - self.size[rows]

    def merge(self, x: int, y: int) -> None:
        """Takes y's links over to x."""
        if self.end + self.size[x] + self.size[y] > len(self.to):
            self._pack(int(self.size[x] + self.size[y]))
        own, other = self._row(x, y), self._row(y, x)
        self.slot[self.to[own]] = own
        hit = self.slot[self.to[other]]
        self.slot[self.to[own]] = -1
        both, gone = hit[hit >= 0], other[hit >= 0]
        self.w[both] += self.w[gone]
        self.w[self.mate[both]] = self.w[both]
        self.to[self.mate[gone]] = -1
        new = other[hit < 0]
        self.to[self.mate[new]] = x
        row = np.concatenate([own, new])
        to, w, mate = self.to[row], self.w[row], self.mate[row]
        if len(row) > self.size[x]:
            self.start[x] = self.end
            self.end += len(row)
        at = self.start[x] + np.arange(len(row))
        self.to[at], self.w[at], self.mate[at] = to, w, mate
        self.mate[mate] = at
        self.size[x], self.size[y] = len(row), 0
        self.best[[x, y]], self.lazy[[x, y]] = np.inf, False
        self.k[x] += self.k[y]
        if not len(row):
            return
        gain, key = self._gains(np.full(len(to), x), at)
        self.best[x] = low = gain.min()
        self.key[x] = key[gain == low].min()
        self.next[x] = np.where(key == self.key[x], np.inf, gain).min()
        was, pair, after, lazy = self.best[to], self.key[to], self.next[to], self.lazy[to]
        near = pair // self.n + pair % self.n - to
        held = ~lazy & (was < np.inf) & ((near == x) | (near == y))
        first = np.where(held, gain < after, ~lazy & ((gain < was) | ((gain == was) & (gain < np.inf) & (key < pair))))
        late = held & ~first
        self.key[to[first]] = key[first]
        self.best[to] = np.where(first, gain, np.where(late, after, np.where(lazy, np.minimum(was, gain), was)))
        self.next[to] = np.where(held, after, np.minimum(after, np.where(first, was, gain)))
        self.lazy[to] = lazy | (late & (after < np.inf))


def _greedy_arrays(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray, total: float) -> dict[int, list[int]]:
    """What ``_greedy_numbers`` finds, with sums and gains in the same order, by arrays: for components of many links."""
    rows, own = _Rows(a, b, w, k, total), {v: [v] for v in range(len(k))}
    while pair := rows.top():
        x, y = pair
        own[x] += own.pop(y)
        rows.merge(x, y)
    return own


def communities(edges: DataFrame, weight: str = "weight", most: int = MOST_GROUPED) -> DataFrame:
    """(node, cluster): greedy modularity, per connected component with the whole graph's weight; a cluster is its least node.

    Only adjacent communities merge and a gain depends on them and the total alone, so
    components can be worked on apart. A component is one task's work; one with over
    ``most`` edges is refused.
    """
    edges = stored(edges.select(F.col("from").cast("string").alias("from"), F.col("to").cast("string").alias("to"), F.col(weight).cast("double").alias("w")))
    parts = connected_components(edges)
    _within_bounds(edges.select(F.col("from").alias("a")), parts, most)
    total = edges.agg(F.sum("w")).first()[0] or 1.0
    e = edges.select(F.col("from").alias("a"), F.col("to").alias("b"), "w").join(parts.select(F.col("node").alias("a"), "component"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of components; nodes of a component stand as numbers in their order."""

        def told(number: dict[str, int], ends: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            w = np.concatenate([x[2] for x in ends])
            names, a, b = _in_order(number, ends)
            k = np.bincount(a, w, len(names))
            np.add.at(k, b, w)
            if len(w) > FEW_LINKS:
                found = _greedy_arrays(a, b, w, k, float(total))
            else:
                found = _greedy_numbers(a.tolist(), b.tolist(), w.tolist(), k.tolist(), float(total))
            nodes = [v for vs in found.values() for v in sorted(vs)]
            least = [min(vs) for vs in found.values() for _ in vs]
            return pa.RecordBatch.from_arrays([names.take(pa.array(nodes, pa.int64())), names.take(pa.array(least, pa.int64()))], names=["node", "cluster"])

        now, number, ends = None, {}, []
        for batch in batches:
            at = 0
            runs = pc.run_end_encode(batch.column("component")) if batch.num_rows else None
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()) if runs is not None else ():
                if ends and name != now:
                    yield told(number, ends)
                    number, ends = {}, []
                now = name
                part = batch.slice(at, end - at)
                ends.append((_numbered(part.column("a"), number), _numbered(part.column("b"), number), part.column("w").to_numpy().copy()))
                at = end
        if ends:
            yield told(number, ends)

    return e.repartition("component").sortWithinPartitions("component").mapInArrow(run, NODE)


def maximal_cliques(edges: DataFrame, least: int = 2, whole: int = WHOLE_EDGES) -> DataFrame:
    """(component, clique, node): the maximal cliques of ``least`` nodes or more; a clique is named by its nodes in order.

    A clique belongs to the first of its nodes by degree, whose later neighbours are few, as
    the order goes by degree; earlier neighbours tell which cliques are not maximal. Tasks
    share out a component's nodes, and each has the component's links, so links between
    neighbours are met there and never become rows. Nodes of a component of over ``whole``
    edges are worked on one by one. Cliques are given out as they are found.
    """
    pairs = stored(edges.select(F.least(F.col("from").cast("string"), F.col("to").cast("string")).alias("a"), F.greatest(F.col("from").cast("string"), F.col("to").cast("string")).alias("b")).where("a <> b").distinct())
    parts = stored(connected_components(pairs.select(F.col("a").alias("from"), F.col("b").alias("to"))))
    lists = pairs.groupBy("a").agg(F.collect_list("b").alias("x")).join(parts.withColumnRenamed("node", "a"), "a")
    degrees = pairs.select("a").unionAll(pairs.select("b")).groupBy(F.col("a").alias("node")).agg(F.count("*").cast("double").alias("n"))
    each = stored(degrees.join(parts, "node").groupBy("component").agg((F.sum("n") / 2).alias("links"), (F.sum(F.col("n") * F.col("n")) / 2).alias("met")))
    shares = F.least(F.ceil(F.col("met") / TASK_WEDGES), F.greatest(F.lit(4), F.ceil(TASK_EDGES / F.col("links")))).cast("int")
    dealt = lists.join(each.where(F.col("links") <= whole).select("component", shares.alias("shares")), "component").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    found = dealt.repartition("component", "share").sortWithinPartitions("component", "share").select("component", "share", "shares", "a", "x").mapInArrow(_cliques_by_share(least), "component string, clique string, node string")
    large = each.where(F.col("links") > whole).select("component")
    if not large.head(1):
        return found
    apart = parts.join(large, "component", "left_semi")
    single = _cliques_apart(pairs.join(apart.select(F.col("node").alias("a")), "a", "left_semi"), least)
    return found.unionAll(single.join(apart, "node").select("component", "clique", "node"))


def _cliques_apart(pairs: DataFrame, least: int) -> DataFrame:
    """(clique, node), each node a piece of work of its own: its later neighbours and the links among its neighbours, as rows."""
    both = pairs.unionAll(pairs.select("b", "a"))
    degree = both.groupBy("a").agg(F.count("*").alias("n"))
    placed = both.join(degree.toDF("a", "n_a"), "a").join(degree.toDF("b", "n_b"), "b").withColumn("later", F.struct("n_b", "b") > F.struct("n_a", "a"))
    placed = stored(placed.select("a", "b", "later"))
    ahead = placed.where("later").select(F.col("a").alias("v"), F.col("b").alias("p"))
    # Links between a later neighbour and any neighbour: what closes a triangle over v.
    near = placed.select(F.col("a").alias("v"), F.col("b").alias("y"), F.col("later").alias("y_later"))
    wedges = ahead.join(placed.select(F.col("a").alias("p"), F.col("b").alias("y")), "p")
    local = wedges.join(near, ["v", "y"]).select("v", "p", "y", "y_later")
    rows = ahead.select("v", "p", F.lit(None).cast("string").alias("y"), F.lit(None).cast("boolean").alias("y_later")).unionAll(local)
    return rows.repartition("v").sortWithinPartitions("v").mapInArrow(_cliques_by_node(least), "clique string, node string")


def _cliques_by_share(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (component, share, shares, a, x), ordered by component and share: a node and its neighbours of greater names."""

    def told(component: str, names: pa.Array, cliques: list[list[int]]) -> pa.RecordBatch:
        own = [[names[i].as_py() for i in c] for c in cliques]
        node = pa.array([u for c in own for u in c], pa.string())
        return pa.RecordBatch.from_arrays([pa.array([component] * len(node), pa.string()), pa.array([name for c in own for name in ["|".join(c)] * len(c)], pa.string()), node], names=["component", "clique", "node"])

    def of(component: str, share: int, shares: int, number: dict[str, int], ends: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        names, a, b = _in_order(number, ends)
        graph, out = _Links(a, b, len(names)), []
        for v in range(share, len(names), shares):
            for clique in graph.cliques(v, least):
                out.append(clique)
                if len(out) >= 10_000:
                    yield told(component, names, out)
                    out = []
        if out:
            yield told(component, names, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, ends = None, {}, []
        for batch in batches:
            component, share, shares = (batch.column(c).to_pylist() for c in ("component", "share", "shares"))
            keys = list(zip(component, share, shares))
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if keys[low] != now:
                    if ends:
                        yield from of(*now, number, ends)
                    now, number, ends = keys[low], {}, []
                part = batch.slice(low, high - low)
                x = part.column("x")
                ends.append((np.repeat(_numbered(part.column("a"), number), np.diff(x.offsets.to_numpy())), _numbered(x.flatten(), number)))
        if ends:
            yield from of(*now, number, ends)

    return run


def _numbered(names: pa.Array, number: dict[str, int]) -> np.ndarray:
    """Names by their numbers in ``number``, which takes in new ones."""
    c = names.dictionary_encode()
    return np.array([number.setdefault(u, len(number)) for u in c.dictionary.to_pylist()], dtype=np.int32)[c.indices.to_numpy()]


def _in_order(number: dict[str, int], ends: list[tuple[np.ndarray, ...]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Names in order, and both ends of links, which are taken out of ``ends``, by places in that order."""
    names = pa.array(number, pa.string())
    order = pc.sort_indices(names)
    place = np.empty(len(number), dtype=np.int32)
    place[order.to_numpy()] = np.arange(len(place), dtype=np.int32)
    a, b = (np.concatenate(x) for x in zip(*(e[:2] for e in ends)))
    ends.clear()
    return names.take(order), place[a], place[b]


class _Links:
    """A component's links between nodes 0 to n - 1: each node's neighbours in order."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: int):
        key = np.empty(2 * len(a), dtype=np.int64)
        for half, x, y in ((key[: len(a)], a, b), (key[len(a) :], b, a)):
            half[:] = x
            half *= n
            half += y
        key.sort()
        self.at = np.searchsorted(key, np.arange(n + 1) * n)
        key %= n
        self.near = key.astype(np.int32)
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[np.argsort(np.diff(self.at), kind="stable")] = np.arange(n)
        self.spot = np.full(n, -1, dtype=np.int64)

    def cliques(self, v: int, least: int) -> Iterator[list[int]]:
        """Maximal cliques of v and later nodes by degree. What is told apart within are v's later neighbours and the earlier ones that have a link to one of them."""
        near = self.near[self.at[v] : self.at[v + 1]]
        later = near[self.rank[near] > self.rank[v]]
        if not len(later):
            return
        self.spot[near] = 0
        n = self.at[later + 1] - self.at[later]
        y = self.near[np.repeat(self.at[later] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        inside = self.spot[y] == 0
        self.spot[near] = -1
        p, y = np.repeat(later, n)[inside], y[inside]
        nodes = np.union1d(later, y)
        if len(nodes) == len(later) == 1 and least > 2:
            return
        p, y = np.searchsorted(nodes, p), np.searchsorted(nodes, y)
        links = [0] * len(nodes)
        for i, j in zip(p.tolist(), y.tolist()):
            links[i] |= 1 << j
            links[j] |= 1 << i
        own = sum(1 << i for i in np.searchsorted(nodes, later).tolist())
        for found in _search(links, own, (1 << len(nodes)) - 1 & ~own, least):
            yield sorted([v, *nodes[list(_bits(found))].tolist()])


def _search(links: list[int], p: int, x: int, least: int) -> Iterator[int]:
    """Sets of nodes of ``p``, as bits, that with one node more are cliques of ``least`` which neither ``p`` nor ``x`` extends.

    The pivot may be of ``x``: one that is linked to all that is left ends a branch.
    """
    stack = [(0, p, x)]
    while stack:
        r, p, x = stack.pop()
        if not p:
            if not x and r.bit_count() + 1 >= least:
                yield r
            continue
        pivot = max(_bits(p | x), key=lambda i: (links[i] & p).bit_count())
        for i in _bits(p & ~links[pivot]):
            stack.append((r | 1 << i, p & links[i], x & links[i]))
            p &= ~(1 << i)
            x |= 1 << i


def _cliques_by_node(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (v, p, y, y_later), ordered by v: later neighbours p, and links between a p and a neighbour y."""

    def of(v: str, near: dict[str, set[str]], before: set[str]) -> Iterator[list[str]]:
        """Cliques of v and its later neighbours ``near`` (with their links to neighbours of v) that no earlier neighbour extends.

        Sets are bits of whole numbers, in the order of names.
        """
        names = sorted(near.keys() | before)
        bit = {u: 1 << i for i, u in enumerate(names)}
        links = [0] * len(names)
        for u, own in near.items():
            i = bit[u].bit_length() - 1
            for y in own:
                links[i] |= bit[y]
                links[bit[y].bit_length() - 1] |= bit[u]
        for found in _search(links, sum(bit[u] for u in near), sum(bit[u] for u in before), least):
            yield sorted([v, *(names[i] for i in _bits(found))])

    def told(cliques: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name for c in cliques for name in ["|".join(c)] * len(c)], pa.string()), pa.array([u for c in cliques for u in c], pa.string())], names=["clique", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, near, before = None, {}, set()
        out: list[list[str]] = []
        for batch in batches:
            for v, p, y, y_later in zip(*(batch.column(c).to_pylist() for c in ("v", "p", "y", "y_later"))):
                if v != now:
                    for clique in of(now, near, before) if near else ():
                        out.append(clique)
                        if len(out) >= 10_000:
                            yield told(out)
                            out = []
                    now, near, before = v, {}, set()
                own = near.setdefault(p, set())
                if y is not None:
                    own.add(y)
                    if not y_later:
                        before.add(y)
            if out:
                yield told(out)
                out = []
        for clique in of(now, near, before) if near else ():
            out.append(clique)
            if len(out) >= 10_000:
                yield told(out)
                out = []
        if out:
            yield told(out)

    return run


def _bits(x: int) -> Iterator[int]:
    """Places of the bits that are set, the least first."""
    while x:
        yield (x & -x).bit_length() - 1
        x &= x - 1


def connectivity(edges: DataFrame, pairs: DataFrame, most: int = MOST_EDGES, batch: int = 2000) -> DataFrame:
    """(a, b, paths): node-disjoint paths between two nodes, by repeated shortest paths without the nodes used.

    A lower bound of the exact number; nodes of different components have 0. A task holds
    one component's edges and ``batch`` pairs or so, more where there are many edges, so
    that a component's edges are dealt out ten times at most or so; a component with over
    ``most`` edges is refused.
    """
    edges = stored(edges.select("from", "to"))
    parts = stored(connected_components(edges).select(F.col("node").cast("string").alias("node"), F.col("component").cast("string").alias("component")))
    e = edges.select(F.col("from").cast("string").alias("a"), F.col("to").cast("string").alias("b")).where("a <> b")
    _within_bounds(e, parts, most)
    e = e.join(parts.toDF("a", "component"), "a")
    p = pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).join(parts.toDF("a", "component"), "a")
    held = e.groupBy("component").agg(F.count("*").alias("_e"))
    shares = p.groupBy("component").agg(F.count("*").alias("_p")).join(held, "component").select("component", F.ceil(F.col("_p") / F.greatest(F.lit(batch), F.col("_e") / 10)).cast("int").alias("shares"))
    p = p.join(shares, "component").withColumn("share", F.pmod(F.xxhash64("a", "b"), F.col("shares")).cast("int")).drop("shares")
    e = e.join(shares, "component").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")

    def run(key: tuple, links: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(pd.concat([links["a"], links["b"]], ignore_index=True), sort=True)
        place = {name: i for i, name in enumerate(names)}
        bits = len(names) ** 2 // 8 <= max(BITS_BYTES, 64 * len(codes))  # a set takes 64 bytes or so a neighbour
        near, found = (_bit_rows(codes, len(names)), _paths_on_bits) if bits else (_neighbours(codes, len(names)), disjoint_paths)
        rows = [(a, b, found(near, place[a], place[b]) if a in place and b in place else 0) for a, b in zip(asked["a"], asked["b"])]
        return pd.DataFrame(rows, columns=["a", "b", "paths"])

    return e.groupBy("component", "share").cogroup(p.groupBy("component", "share")).applyInPandas(run, "a string, b string, paths long")


def _neighbours(codes: np.ndarray, n: int) -> list[set[int]]:
    """Each node's neighbours; the first half of ``codes`` has one end of each link, the other half the other."""
    near: list[set[int]] = [set() for _ in range(n)]
    half = len(codes) // 2
    for x, y in zip(codes[:half].tolist(), codes[half:].tolist()):
        near[x].add(y)
        near[y].add(x)
    return near


def _bit_rows(codes: np.ndarray, n: int, step: int = 1024) -> list[int]:
    """As ``_neighbours``, but a node's neighbours are the bits of a whole number."""
    half = len(codes) // 2
    one, two = np.concatenate([codes[:half], codes[half:]]), np.concatenate([codes[half:], codes[:half]])
    one, two = np.divmod(np.unique(one.astype(np.int64) * n + two), n)
    near: list[int] = []
    for at in range(0, n, step):
        low, high = np.searchsorted(one, [at, at + step])
        rows = np.zeros((min(step, n - at), n), dtype=np.uint8)
        rows[one[low:high] - at, two[low:high]] = 1
        near += [int.from_bytes(row.tobytes(), "little") for row in np.packbits(rows, axis=1, bitorder="little")]
    return near


def _least(x: int) -> int:
    """The place of the first bit that is set."""
    return (x ^ (x - 1)).bit_length() - 1


def _places(x: int) -> list[int]:
    """Places of the bits of a long number that are set, the least first."""
    held = np.frombuffer(x.to_bytes(x.bit_length() // 8 + 1, "little"), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(held, bitorder="little")).tolist()


def _paths_on_bits(near: list[int], a: int, b: int) -> int:
    """The same paths as ``disjoint_paths`` finds, by neighbours as bits."""
    if a == b:
        return near[a].bit_count()
    shared = near[a] & near[b]
    paths, used = (near[a] >> b & 1) + shared.bit_count(), shared | 1 << a | 1 << b
    left, into = [], near[b] & ~(near[a] | 1 << a)
    for v in _places(near[a] & ~(near[b] | 1 << b)):
        if met := near[v] & into:
            low = 1 << _least(met)
            used |= low | 1 << v
            into ^= low
            paths += 1
        else:
            left.append(v)
    n = 1
    while left and (layers := _bit_layers(near, into, used, n))[-1]:
        apart, top = [], layers[-1]
        free = ~used & _joined(near, top) if top.bit_count() <= WIDE_LAYER else (1 << len(near)) - 1 & ~used  # a node outside has no link to the last layer, which only shrinks
        for v in left:
            ahead = near[v] & free
            while ahead and not near[_least(ahead)] & top:
                free ^= 1 << _least(ahead)
                ahead &= ahead - 1
            if not ahead:
                apart.append(v)
                continue
            w = _least(ahead)
            gone = 1 << v | 1 << w
            for layer in reversed(layers):
                w = _least(near[w] & layer)
                gone |= 1 << w
            used |= gone
            free &= ~gone
            into ^= 1 << w
            paths += 1
            layers = _bit_layers(near, into, used, n)
            top = layers[-1]
        left, n = apart, n + 1
    return paths


def _joined(near: list[int], nodes: int) -> int:
    """All neighbours of some nodes."""
    out = 0
    for v in _places(nodes):
        out |= near[v]
    return out


def _bit_layers(near: list[int], first: int, used: int, n: int) -> list[int]:
    """``_layers`` by bits."""
    layers, seen = [first], first
    while len(layers) < n:
        layers.append(_joined(near, layers[-1]) & ~used & ~seen)
        seen |= layers[-1]
    return layers


def disjoint_paths(near: list[set[int]], a: int, b: int) -> int:
    """Paths from a to b that share no node between, the shortest first and of those the least in the order of a search by breadth.

    Such searches find all paths of two links, then all of three, and so on, by one pass over
    a's neighbours for a length: a neighbour without a path of some length has none of it
    later, since nodes are only used up. The path of a search is the least by its nodes in
    order, so it is read from the layers of nodes around b.
    """
    if a == b:
        return len(near[a])
    shared = near[a] & near[b]
    paths, used = int(b in near[a]) + len(shared), shared | {a, b}
    left, into = [], near[b] - near[a] - {a}
    for v in sorted(near[a] - near[b] - {b}):
        if met := near[v] & into:
            used |= {v, w := min(met)}
            into = into - {w}
            paths += 1
        else:
            left.append(v)
    n = 1
    while left and (layers := _layers(near, into, used, n))[-1]:
        apart, off = [], set()
        for v in left:
            w = next((w for w in sorted(near[v] - used - off) if off.add(w) or not near[w].isdisjoint(layers[-1])), None)
            if w is None:
                apart.append(v)
                continue
            path = [v, w]
            for layer in reversed(layers):
                path.append(min(near[path[-1]] & layer))
            used.update(path)
            into = into - {path[-1]}
            paths += 1
            layers = _layers(near, into, used, n)
        left, n = apart, n + 1
    return paths


def _layers(near: list[set[int]], first: set[int], used: set[int], n: int) -> list[set[int]]:
    """The first nodes, and those at 1 to n - 1 links from them by nodes that are not used."""
    layers, seen = [first], set(first)
    while len(layers) < n:
        layers.append(set().union(*(near[v] for v in layers[-1])) - used - seen)
        seen |= layers[-1]
    return layers


def canonical_members(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, canonical) for clusters of two or more: the member with the most edges, ties to the lesser id."""
    ends = edges.select(F.col("from").alias("node")).unionAll(edges.select("to")).groupBy("node").agg(F.count("*").alias("n"))
    c = clusters.join(ends, "node", "left").fillna(0, ["n"])
    best = c.groupBy("cluster").agg(F.min_by("node", F.struct(-F.col("n"), F.col("node"))).alias("canonical"), F.count("*").alias("size")).where("size > 1")
    return c.join(best, "cluster").select("cluster", "node", "canonical")


def merge_clusters(nodes: DataFrame, edges: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes without merged ones, distinct rewritten edges, and a log (cluster, canonical, merged)."""
    from loomgraph.operators.dedup import merge_nodes, remap_edges

    c = canonical_members(clusters, edges)
    mapping = c.where("node <> canonical").select(F.col("node").alias("old"), F.col("canonical").alias("new"))
    log = c.where("node <> canonical").select("cluster", "canonical", F.col("node").alias("merged"))
    return merge_nodes(nodes, mapping), remap_edges(edges, mapping), log


def consolidate_clusters(nodes: DataFrame, clusters: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """Nodes under their canonical ids, each attribute as the distinct values of the members."""
    c = canonical_members(clusters, edges).select(F.col("node").alias("nodeID"), "canonical")
    return nodes.join(c, "nodeID", "left").groupBy(F.coalesce("canonical", "nodeID").alias("nodeID"), "nodeType").agg(*[F.array_sort(F.collect_set(x)).alias(x) for x in columns])


def within(edges: DataFrame, start: DataFrame, radius: int) -> DataFrame:
    """Nodes at most ``radius`` edges from ``start(node)``: one bounded join a step."""
    near = edges.select(F.col("from").alias("node"), F.col("to").alias("next")).unionAll(edges.select("to", "from")).distinct()
    seen = start.select("node").distinct()
    for _ in range(radius):
        seen = seen.union(near.join(seen, "node", "left_semi").select(F.col("next").alias("node"))).distinct()
    return seen


def combined(ner: DataFrame, srl: DataFrame) -> DataFrame:
    """Two graphs over the same keys (from, to, type, weight): where both have a pair, the first graph's type; weights added."""
    extra = srl.join(ner.select("from", "to").distinct(), ["from", "to"], "left_anti")
    shared = srl.join(ner.select("from", "to", F.col("type").alias("_t")).distinct(), ["from", "to"]).select("from", "to", F.col("_t").alias("type"), "weight")
    return ner.select("from", "to", "type", "weight").unionByName(extra.select("from", "to", "type", "weight")).unionByName(shared).groupBy("from", "to", "type").agg(F.sum("weight").alias("weight"))


def top_correlations(weights: DataFrame, row: str, column: str, value: str, above: float) -> DataFrame:
    """(a, b, weight): correlation of columns over rows given in long form with every cell, over a limit, rescaled to [1, 4]."""
    w = weights.select(F.col(row).alias("_r"), F.col(column).alias("c"), F.col(value).alias("x"))
    pairs = w.toDF("_r", "a", "x").join(w.toDF("_r", "b", "y"), "_r").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r")).where(F.col("r") > above)
    from loomgraph.operators.windows import rescaled

    return rescaled(pairs, "r", 1, 4).select("a", "b", F.col("r"), F.col("scaled").alias("weight"))
