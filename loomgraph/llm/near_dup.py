"""Near-duplicate documents by SetSketch registers, banding, likelihood and exact checks.

A document's shingle set is sketched into registers ``floor(1 - log_b(min))`` of
exponential variates: exponentially spaced, truncated minima, mergeable by maximum, equal
between two sets about as often as their Jaccard similarity. Bands of registers give
buckets. In a bucket every document meets one hub, not every other; hubs differ between
bands. A pair's registers give the likeliest similarity; pairs that may reach the
threshold are checked on their full sets. After that only buckets that still hold several
components need more: they are cut into blocks, and a block compares the registers of its
documents as matrices. Few candidates go on to the check as pairs; a block with many gives
out a forest that connects them instead. Trees of such forests are clusters, in which
documents of different components are compared by their full sets, block by block, and a
block reports only links that join components, never its pairs.

Exact copies are one node from the start, so a large group of them costs one sketch.

What may be missed: a linked pair that shares no band, or whose registers put it more than
six standard errors below its similarity (``Limits``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, begin, connected_components, mix64, partitions, row_function, slices

#: Registers of a sketch; their base, rate and largest value.
REGISTERS, BASE, RATE, TOP = 160, 1.001, 20.0, 65535
#: Chance that a pair at the threshold shares no band, at most.
MISS = 1e-5
#: Standard errors of the registers' estimate by which a candidate may fall short.
ERRORS = 6.3
#: Orders by which hubs are picked.
ORDERS = 4
#: Rows up to which a table of pairs may be broadcast (16 to 40 bytes each); beyond, texts are shuffled to it.
BROADCAST_ROWS = 500_000
#: Partners checked against one copy of a hub's set.
PER_HUB = 128
#: Documents of a block whose registers are compared (340 bytes each).
SKETCH_BLOCK = 512
#: Candidates a block, and further ones a document, beyond which it gives out a forest in place of pairs.
PER_BLOCK, PER_DOC = 8, 0.25
#: Documents, and shingles, of a block that is compared by full sets.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 2_000_000

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)


@dataclass(frozen=True)
class Limits:
    """What follows from a threshold in percent, 30 to 100.

    ``rows`` registers make one of ``bands`` bands, as many as still let a pair at the
    threshold s miss every band with chance (1 - s^rows)^bands <= MISS (3e-6 at 80 percent).
    ``least`` is the estimate from which a pair is checked: ERRORS standard errors,
    sqrt(s (1 - s) / REGISTERS) each, below s.
    """

    percent: int

    def __post_init__(self) -> None:
        if not 30 <= self.percent <= 100:
            raise ValueError(f"a threshold of {self.percent} percent; 30 to 100 can be found by bands of {REGISTERS} registers")

    @property
    def rows(self) -> int:
        s = self.percent / 100
        return max(r for r in range(1, 11) if (1 - s**r) ** (REGISTERS // r) <= MISS)

    @property
    def bands(self) -> int:
        return REGISTERS // self.rows

    @property
    def least(self) -> float:
        s = self.percent / 100
        return s - max(ERRORS * math.sqrt(s * (1 - s) / REGISTERS), 0.03)


class _Hashes(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) >= 300_000:
            self.clear()
        self[word] = h
        return h


def words_of(text: str) -> list[bytes]:
    """The words of a text with A-Z in lower case; separators are the six ASCII ones."""
    return text.encode("utf-8").lower().split()


def shingle_set(words: list[bytes], k: int, hashes: _Hashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; fewer words are one shingle, no words none."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(k, len(w))
    h = np.full(len(w) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - width + 1 + i])
    return np.unique(h)


def registers(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (sets x registers) of consecutive non-empty sets in ``flat``."""
    out = np.empty((len(starts) - 1, len(_FACTORS)), dtype=np.uint64)
    for j, (a, b) in enumerate(zip(_FACTORS, _OFFSETS)):
        out[:, j] = np.maximum.reduceat(flat * a + b, starts[:-1])
    # The largest of n uniform variates u is exp(-RATE x) for the least of n exponential variates x.
    x = -np.log1p(-((~out).astype(np.float64) + 1) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / math.log(BASE)) + 20000, 0, TOP).astype(np.uint16)


def band_hashes(regs: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of ``rows`` registers, the band's number mixed in."""
    bands = REGISTERS // rows
    parts = regs[:, : bands * rows].reshape(len(regs), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(rows):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i] + np.uint64(1))
    return h.view(np.int64)


def likeliest(more: np.ndarray, fewer: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity under which the registers' comparison is likeliest, given both set sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1.0) * (BASE - 1) / BASE) / math.log(BASE)
    for j in np.linspace(0.0, 1.0, 51):
        jj = np.minimum(j, np.minimum(u / v, v / u))
        a, b = p(u - v * jj), p(v - u * jj)
        got = more * np.log(a) + fewer * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12))
        better = got > best
        best, at = np.where(better, got, best), np.where(better, jj, at)
    return at


def sketch(df: DataFrame, k: int, rows: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, copy, regs, bands) of every document; the last three null where there is no word."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("copy", pa.binary()), ("regs", pa.binary()), ("bands", pa.list_(pa.int64()))])
    hashes = _Hashes()

    def made(batch: pa.RecordBatch) -> dict[str, object]:
        begin("near_dup", hashes.clear)
        words = [words_of(t or "") for t in batch.column("text").to_pylist()]
        sets = [shingle_set(w, k, hashes) for w in words]
        full = [i for i, s in enumerate(sets) if len(s)]
        copy: list[bytes | None] = [None] * len(sets)
        regs: list[bytes | None] = [None] * len(sets)
        bands: list[np.ndarray | None] = [None] * len(sets)
        if full:
            got = registers(np.concatenate([sets[i] for i in full]), np.cumsum([0, *(len(sets[i]) for i in full)]))
            for i, r, b in zip(full, got, band_hashes(got, rows)):
                regs[i], bands[i], copy[i] = r.tobytes(), b, hashlib.blake2b(b" ".join(words[i]), digest_size=16).digest()
        return {"doc_id": batch.column("key"), "n_shingles": list(map(len, sets)), "copy": copy, "regs": regs, "bands": bands}

    own = df.select(df[key].cast("long").alias("key"), df[text].alias("text"))
    return own.mapInArrow(row_function(made, schema, 256), "doc_id long, n_shingles long, copy binary, regs binary, bands array<long>")


def estimate(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of pairs whose likeliest similarity is ``least`` or more."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(n).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for n in ("regs_a", "regs_b"))
                n_a, n_b = (batch.column(n).to_numpy().astype(np.float64) for n in ("n_a", "n_b"))
                got = likeliest((x > y).sum(1), (x < y).sum(1), (x == y).sum(1), n_a, n_b)
                keep = np.flatnonzero(got >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(got[keep])], schema=schema)

    side = lambda s: nodes.select(F.col("node").alias(s), F.col("regs").alias(f"regs_{s}"), F.col("n_shingles").alias(f"n_{s}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long, similarity double")


def verify(pairs: DataFrame, df: DataFrame, k: int, percent: int, text: str, key: str, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    Pairs are grouped by ``b``; a task reads the hub's text, then its partners' one at a
    time. Hubs with many partners are split over tasks.
    """
    spark = df.sparkSession
    pairs = scratch.save(pairs.select("a", "b"), f"{name}-pairs")
    few = pairs.count() <= BROADCAST_ROWS
    hint = F.broadcast if few else (lambda x: x)
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PER_HUB).alias("parts"))
    spread = scratch.save(pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")), f"{name}-spread")
    texts = df.select(df[key].cast("long").alias("id"), df[text].alias("text"))
    partners = texts.join(hint(spread), texts["id"] == spread["a"]).select("b", "part", F.lit(1).alias("kind"), "id", "text")
    hubs = spread.select("b", "part").distinct()
    heads = texts.join(hint(hubs), texts["id"] == hubs["b"]).select("b", "part", F.lit(0).alias("kind"), "id", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        begin("near_dup", hashes.clear)
        group, sets = None, []
        for batch in slices(batches):
            found = []
            for b, part, kind, i, t in zip(*(batch.column(n).to_pylist() for n in ("b", "part", "kind", "id", "text"))):
                own = shingle_set(words_of(t or ""), k, hashes)
                if (b, part) != group:
                    group, sets = (b, part), []
                if kind == 0:
                    sets.append(own)
                    continue
                for hub in sets:
                    if 100 * min(len(hub), len(own)) < percent * max(len(hub), len(own)) or not len(own):
                        continue
                    at = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
                    both = int((hub[at] == own).sum())
                    if 100 * both >= percent * (len(hub) + len(own) - both):
                        found.append((i, b))
                        break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], schema=schema)

    rows = heads.unionByName(partners).repartition(partitions(spark), "b", "part").sortWithinPartitions("b", "part", "kind", "id")
    links = scratch.save(rows.mapInArrow(run, "a long, b long"), f"{name}-links")
    scratch.drop(f"{name}-pairs", f"{name}-spread")
    return links


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many registers each row of x and each of y have in common (matrix)."""
    if len(x) * len(y) <= 1024:
        return (x[:, None, :] == y[None, :, :]).sum(2)
    out = np.zeros((len(x), len(y)), dtype=np.uint8)  # REGISTERS < 256
    for p, q in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)):
        out += p[:, None] == q[None, :]
    return out


def block_candidates(members: DataFrame, limits: Limits) -> DataFrame:
    """(a, b, many) from ``members(bucket, parts, node, c, n_shingles, regs)``: pairs of different ``c`` that may reach the threshold.

    A bucket is cut into ``parts``, and each pair of parts is a block. Where ``many`` holds
    the pairs are not the candidates but stars that connect them. A block gives out at most
    a row a document, and PER_BLOCK.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("many", pa.bool_())])
    enough = math.ceil(REGISTERS * limits.least)

    def compared(left: np.ndarray, right: np.ndarray, node: np.ndarray, c: np.ndarray, n: np.ndarray, regs: np.ndarray) -> list[tuple]:
        i, j = np.flatnonzero(left), np.flatnonzero(right)
        if not len(i) or not len(j) or (c == c[0]).all():
            return []
        hit = agreement(regs[i], regs[j]) >= enough
        hit &= c[i][:, None] != c[j][None, :]
        hit &= 100 * np.minimum(n[i][:, None], n[j][None, :]) >= limits.percent * np.maximum(n[i][:, None], n[j][None, :])
        if (left & right).any():  # one part against itself
            hit = np.triu(hit, 1)
        found = int(np.count_nonzero(hit))
        if not found:
            return []
        if found <= PER_BLOCK + PER_DOC * len(node):
            x, y = np.nonzero(hit)
            x, y = i[x], j[y]
            p, q = regs[x], regs[y]
            keep = likeliest((p > q).sum(1), (p < q).sum(1), (p == q).sum(1), n[x].astype(float), n[y].astype(float)) >= limits.least
            return [(node[x[keep]], node[y[keep]], np.zeros(int(keep.sum()), dtype=bool))]
        root, big = np.arange(len(node)), len(node)
        while True:  # the least place reachable over candidates
            was = root.copy()
            np.minimum.at(root, i, np.where(hit, root[j][None, :], big).min(1))
            np.minimum.at(root, j, np.where(hit, root[i][:, None], big).min(0))
            if (was == root).all():
                break
        own = np.flatnonzero(root != np.arange(len(node)))
        return [(node[own], node[root[own]], np.ones(len(own), dtype=bool))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(x).to_numpy().astype(np.int64) for x in ("bucket", "i", "j")])
            cols = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("left", "right", "node", "c", "n_shingles")]
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1)
            edges = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])).tolist() if batch.num_rows else []
            out = []
            for s, e in zip(edges, [*edges[1:], batch.num_rows]):
                own = [x[s:e] for x in (*cols, regs)]
                if (at := tuple(keys[:, s].tolist())) != block:
                    if held:
                        out += compared(*(np.concatenate(x) for x in zip(*held)))
                    block, held = at, []
                held.append(own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=schema)
        if held and (out := compared(*(np.concatenate(x) for x in zip(*held)))):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=schema)

    blocks = in_blocks(members, "bucket").select("bucket", "i", "j", "left", "right", "node", "c", "n_shingles", "regs")
    ready = blocks.repartition(partitions(members.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return ready.mapInArrow(run, "a long, b long, many boolean")


def in_blocks(rows: DataFrame, by: str) -> DataFrame:
    """Rows with ``parts`` parts to a group, once for each block (i, j), i <= j, of two parts; ``left`` and ``right`` tell the side."""
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    spread = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spread.select(
        by, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") <= F.col("other")).alias("left"), (F.col("part") >= F.col("other")).alias("right"),
        *(x for x in rows.columns if x not in (by, "parts")),
    )


def links_across(placed: DataFrame, df: DataFrame, k: int, percent: int, text: str, key: str, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join components ``c`` within clusters of ``placed(cluster, node, c, n_shingles)``.

    A cluster is cut into parts; each pair of parts is a block, compared by one task on
    full sets. What a block reports is at most one link a document.
    """
    spark = df.sparkSession
    sums = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    parts = sums.select("cluster", F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    blocks = scratch.save(in_blocks(placed.join(parts, "cluster").select("cluster", "parts", "node", "c"), "cluster"), "blocks")
    few = blocks.count() <= BROADCAST_ROWS
    texts = df.select(df[key].cast("long").alias("id"), df[text].alias("text"))
    rows = texts.join(F.broadcast(blocks) if few else blocks, texts["id"] == blocks["node"]).drop("id")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compared(group: list[tuple]) -> list[tuple[int, int]]:
        """Links of a block: (left, right, node, class, set) each."""
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        left, right = [g for g in group if g[0] and len(g[4])], [g for g in group if g[1] and len(g[4])]
        if not left or not right or len({g[3] for g in left + right}) < 2:
            return []
        sizes = np.array([len(g[4]) for g in right])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        words, flat = np.unique(np.concatenate([g[4] for g in right]), return_inverse=True)
        mark = np.zeros(len(words), dtype=np.int32)
        classes_ = np.array([g[3] for g in right])
        found = []
        for _, _, node, c, own in left:
            at = np.searchsorted(words, own)
            at = at[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == own)]
            mark[at] = 1
            both = np.add.reduceat(mark[flat], starts)
            mark[at] = 0
            for i in np.flatnonzero((classes_ != c) & (100 * both >= percent * (len(own) + sizes - both))):
                x, y = find(c), find(int(classes_[i]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    found.append((node, right[i][2]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        begin("near_dup", hashes.clear)
        block, group = None, []
        for batch in slices(batches):
            out = []
            for cluster, i, j, left, right, node, c, t in zip(*(batch.column(n).to_pylist() for n in ("cluster", "i", "j", "left", "right", "node", "c", "text"))):
                if (cluster, i, j) != block:
                    out += compared(group)
                    block, group = (cluster, i, j), []
                group.append((left, right, node, c, shingle_set(words_of(t or ""), k, hashes)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=schema)
        if out := compared(group):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=schema)

    ready = rows.repartition(partitions(spark), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")
    return scratch.save(ready.select("cluster", "i", "j", "left", "right", "node", "c", "text").mapInArrow(run, "a long, b long"), "across")


def classes(df: DataFrame, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Two documents are linked when 100 x shared shingles >= ``percent`` (30 to 100) x all
    shingles of both; ``component_id`` is the least id reachable over links. Documents without words
    (null texts too) have no shingles and stand alone. A repeated row gets the class of
    its text; a row without id gets a null class and is kept. Empty tables give no rows.
    """
    limits = Limits(percent)
    scratch = Scratch(df.sparkSession, "near-dup")
    sketches = scratch.save(sketch(df, k, limits.rows, text, key), "sketches")
    full = sketches.where("copy is not null and doc_id is not null")
    copies = scratch.save(full.groupBy("copy").agg(F.min("doc_id").alias("node")), "copies")
    # One node for each distinct text: its least id.
    nodes = scratch.save(
        full.join(copies, "copy").where("doc_id = node").groupBy("copy", "node", "n_shingles").agg(F.first("regs").alias("regs"), F.first("bands").alias("bands")).drop("copy"), "nodes"
    )
    members = nodes.select(F.explode("bands").alias("bucket"), "node")
    order = F.xxhash64("node", F.pmod("bucket", F.lit(ORDERS)))
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("node", F.struct(order, "node")).alias("hub")).where("n > 1").select("bucket", "hub")
    shared = scratch.save(members.join(buckets, "bucket"), "buckets")
    met = scratch.save(shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "met")
    near = scratch.save(estimate(met, nodes, limits.least), "near")

    # First each node against its likeliest hub, then what could still join two components.
    best = near.groupBy("a").agg(F.max_by("b", F.struct("similarity", "b")).alias("b"))
    first = verify(best, df, k, percent, text, key, scratch, "first")
    labels = connected_components(first)

    def component(pairs: DataFrame, by: DataFrame) -> DataFrame:
        """Pairs with the component of each end."""
        for s in ("a", "b"):
            pairs = pairs.join(by.select(F.col("node").alias(s), F.col("component").alias(f"c_{s}")), s, "left").withColumn(f"c_{s}", F.coalesce(f"c_{s}", s))
        return pairs

    def joined(by: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Labels after further links: components of the graph whose nodes are the components so far."""
        ends = component(links.select("a", "b"), by).select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).where("a <> b")
        over = connected_components(ends).select(F.col("node").alias("was"), F.col("component").alias("now"))
        kept = by.join(over, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))
        fresh = over.join(by.select(F.col("node").alias("was")), "was", "left_anti").select(F.col("was").alias("node"), F.col("now").alias("component"))
        return scratch.save(kept.unionByName(fresh), f"{name}-labels")

    rest = component(near.join(best, ["a", "b"], "left_anti"), labels).where("c_a <> c_b")
    labels = joined(labels, verify(rest, df, k, percent, text, key, scratch, "rest"), "two")

    # Buckets that still hold several components are compared in blocks, equal buckets once.
    own = scratch.save(shared.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c")), "open")
    sizes = own.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("mark")).where("low <> high and n > 2")
    mixed = sizes.groupBy("n", "mark", "low", "high").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / SKETCH_BLOCK).cast("int").alias("parts"))
    members = own.join(mixed, "bucket").join(nodes.select("node", "n_shingles", "regs"), "node")
    found = scratch.save(block_candidates(members, limits), "found")
    tried = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    few = found.where("not many").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    labels = joined(labels, verify(few, df, k, percent, text, key, scratch, "few"), "three")
    clusters = connected_components(found.where("many").select("a", "b").distinct()).withColumnRenamed("component", "cluster")
    placed = clusters.join(labels, "node", "left").join(nodes.select("node", "n_shingles"), "node").select("cluster", "node", F.coalesce("component", "node").alias("c"), "n_shingles")
    labels = joined(labels, links_across(scratch.save(placed, "placed"), df, k, percent, text, key, scratch), "four")
    scratch.drop("nodes", "buckets", "met", "near", "open", "found", "placed")

    out = sketches.select("doc_id", "n_shingles", "copy").join(copies, "copy", "left").join(labels, "node", "left")
    cid = F.coalesce("component", "node", "doc_id")
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), F.coalesce(F.col("doc_id") == cid, F.lit(True)).alias("kept"))
