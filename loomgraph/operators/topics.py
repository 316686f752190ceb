"""N-gram vocabularies, document-term counts, and topic models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.runs import byte_slices, flat, hashes, runs, vocabulary as words_of_runs
from loomgraph.functions.scratch import release, stored
from loomgraph.functions.text import clean_topic


def ngrams(df: DataFrame, key: str, text: str, stop_words: tuple[str, ...] = (), longest: int = 3) -> DataFrame:
    """(key, term): 1- to ``longest``-grams of words ``[a-zA-Z0-9]+`` without stop words.

    Words are joined with the same words one place on, once a length; no slices are cut.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    w = df.select(F.col(key).alias("key"), words.alias("w"))
    made, grams = ["w"], F.col("w")
    for n in range(2, longest + 1):
        # zip_with pads the shorter side with nulls; a null makes the gram null.
        grams = F.filter(F.zip_with(grams, F.slice("w", n, F.greatest(F.size("w") - n + 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
        w = w.withColumn(f"w{n}", grams)
        made.append(f"w{n}")
        grams = F.col(f"w{n}")
    return w.select("key", F.explode(F.concat(*made)).alias("term")).where("term <> ''")


def vocabulary(terms: DataFrame, size: int = 10_000) -> DataFrame:
    """The most frequent terms of any table of terms with their counts; ties by term."""
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(size)


def doc_terms(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(key, term, tf) over a vocabulary, a table bounded by its size."""
    return terms.join(F.broadcast(vocab.select("term")), "term").groupBy("key", "term").agg(F.count("*").alias("tf"))


class Grams:
    """1- to ``longest``-grams of words ``[a-zA-Z0-9]+`` in lower case, without stop words, of all texts of a table.

    The same terms as ``ngrams`` gives, counted without a row for each: tasks find the words of a
    slice of texts on its bytes and hash runs of them.
    """

    def __init__(self, df: DataFrame, key: str, text: str, stop_words: tuple[str, ...] = (), longest: int = 3):
        self.rows = df.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text"))
        self.stop, self.longest = frozenset(w.encode() for w in stop_words), longest

    def vocabulary(self, size: int = 10_000, kept: int = 1 << 18) -> DataFrame:
        """(term, n): the ``size`` most frequent terms, exactly; ties by term.

        Two passes. First each task keeps the ``kept`` most frequent hashes of its own terms and
        what the others have at most; added up, these bound every term's count from both
        sides. Terms whose upper bound reaches the lower bound of the ``size``-th are counted exactly in
        the second pass. Should the last one then fall below that bound, or too little
        have been kept to tell, the passes are run again with more.
        """
        while True:
            sums, lost = self._summaries(kept)
            least = sums.orderBy(F.desc("n")).limit(size).agg(F.count("*"), F.min("n")).first()
            bound = least[1] if least[0] == size else 0
            if bound > lost or not lost:
                while True:
                    counted = stored(self.counts(sums.where(F.col("n") + lost >= bound).select("h")))
                    best = counted.orderBy(F.desc("n"), "term").limit(size)
                    last = best.agg(F.count("*"), F.min("n")).first()
                    if not bound or (last[0] == size and last[1] >= bound):
                        return best
                    bound = last[1] if last[0] == size and last[1] > lost else 0
                    if not bound and lost:
                        break
            kept *= 8

    def _summaries(self, kept: int) -> tuple[DataFrame, int]:
        """((h, n), most that any term has beside its n): added up over tasks."""
        step, longest, stop = _Slice, self.longest, self.stop

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, lost = [], 0
            for batch in byte_slices(batches):
                held.append(np.unique(step(batch, longest, stop).hashes(), return_counts=True))
                if sum(len(h) for h, _ in held) > 4 * kept:
                    held, more = _shortened(held, kept)
                    lost += more
            if held:
                held, more = _shortened(held, kept)
                h, n = held[0]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([lost + more])], names=["h", "n"])

        sums = stored(self.rows.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
        lost = sums.where("h IS NULL").first()
        return sums.where("h IS NOT NULL"), lost["n"] if lost else 0

    def counts(self, wanted: DataFrame) -> DataFrame:
        """(term, n) of all terms whose hash stands in ``wanted(h)``, and of what shares a hash with them."""
        return self._found(wanted, False).groupBy("term").agg(F.sum("n").alias("n"))

    def doc_terms(self, vocab: DataFrame) -> DataFrame:
        """(key, term, tf) over a vocabulary, a table bounded by its size."""
        hashed = vocab.select("term").mapInArrow(_hash_terms, "h long")
        found = self._found(hashed, True).join(F.broadcast(vocab.select("term")), "term", "left_semi")
        return found.groupBy("key", "term").agg(F.sum("n").alias("tf"))

    def doc_sets(self, vocab: DataFrame) -> DataFrame:
        """(key, terms): the terms of a vocabulary, a table bounded by its size, that stand in each document with one of them.

        A list is made by the task that reads the document, so what is shuffled is a row a document, not one a term of it.
        """
        told = vocab.select("term").toArrow()
        near = [b.column("h").to_numpy() for b in _hash_terms(told.to_batches())]
        shared = vocab.sparkSession.sparkContext.broadcast((np.sort(np.concatenate([np.zeros(0, np.int64), *near])), told.column("term").combine_chunks()))
        step, longest, stop = _Slice, self.longest, self.stop
        kind = self.rows.schema["key"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in byte_slices(batches):
                yield from step(batch, longest, stop).sets(*shared.value)

        return self.rows.mapInArrow(run, f"key {kind}, terms array<string>").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))

    def _found(self, wanted: DataFrame, by_key: bool) -> DataFrame:
        """(key, term, n) or (term, n) a slice; the hashes wanted are a sorted array in every task while they are few, else joined."""
        few = wanted.count() <= MOST_WANTED
        near = wanted.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow().column("h").to_numpy()) if few else None)
        step, longest, stop = _Slice, self.longest, self.stop
        kind = self.rows.schema["key"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in byte_slices(batches):
                yield from step(batch, longest, stop).terms(near.value, by_key)

        made = self.rows.mapInArrow(run, f"h long, key {kind}, term string, n long" if by_key else "h long, term string, n long")
        return made if few else made.join(wanted.distinct(), "h", "left_semi")


#: Hashes that may be sent to every task (8 bytes each).
MOST_WANTED = 4_000_000
#: Which bytes stand in words.
IN_WORDS = np.zeros(256, dtype=bool)
IN_WORDS[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True
NEXT = np.uint64(0x9E3779B97F4A7C15)


class _Slice:
    """Words of a slice of texts and the runs of them."""

    def __init__(self, batch: pa.RecordBatch, longest: int, stop: frozenset[bytes]):
        data, at = flat(batch.column("text"))
        inside = IN_WORDS[data]
        starts, ends = runs(inside, at)
        self.keys, self.longest = batch.column("key"), longest
        self.code, self.words = words_of_runs(data, inside, starts, ends)
        told = self.words.to_pylist()
        self.row = np.searchsorted(at, starts, side="right") - 1
        if stop:
            keep = ~np.array([w in stop for w in told], dtype=bool)[self.code] if len(told) else np.zeros(0, bool)
            self.code, self.row = self.code[keep], self.row[keep]
        self.hash = hashes(told)[self.code] if len(told) else np.zeros(0, np.uint64)

    def _levels(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first words, hash) of the runs of each length."""
        h = mixed(self.hash)
        for k in range(1, self.longest + 1):
            if k > 1:
                h = mixed(h[:-1] * NEXT + self.hash[k - 1 :])
            first = np.flatnonzero(self.row[: len(h)] == self.row[k - 1 :]) if len(h) else np.zeros(0, np.int64)
            yield first, h[first]
            if not len(h):
                return

    def hashes(self) -> np.ndarray:
        return np.concatenate([h for _, h in self._levels()])

    def terms(self, wanted: np.ndarray | None, by_key: bool) -> Iterator[pa.RecordBatch]:
        """(h, key, term, n) or (h, term, n) of the runs wanted, added up."""
        for k, (first, h) in enumerate(self._levels(), 1):
            if wanted is not None:
                signed = h.view(np.int64)
                place = np.minimum(np.searchsorted(wanted, signed), len(wanted) - 1) if len(wanted) else np.zeros(0, np.int64)
                hit = wanted[place] == signed if len(wanted) else np.zeros(len(h), bool)
                first, h = first[hit], h[hit]
            if not len(first):
                continue
            by = np.lexsort((h, self.row[first])) if by_key else np.argsort(h, kind="stable")
            first, h = first[by], h[by]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            if by_key:
                new[1:] |= self.row[first[1:]] != self.row[first[:-1]]
            # Within a slice equal hashes are taken for equal terms only where their words are.
            for i in range(k):
                new[1:] |= self.code[first[1:] + i] != self.code[first[:-1] + i]
            heads = np.flatnonzero(new)
            n, own = np.diff(heads, append=len(first)), first[heads]
            parts = [self.words.take(pa.array(self.code[own + i])) for i in range(k)]
            term = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
            columns = [pa.array(h[heads].view(np.int64)), *([self.keys.take(pa.array(self.row[own]))] if by_key else []), term.cast(pa.large_string()).cast(pa.string()), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["h", *(["key"] if by_key else []), "term", "n"])

    def sets(self, wanted: np.ndarray, terms: pa.Array) -> Iterator[pa.RecordBatch]:
        """(key, terms) of the slice's texts with a run wanted; ``terms`` tells runs from others of the same hash."""
        keys, self.keys = self.keys, pa.array(np.arange(len(self.keys)))
        found = pa.Table.from_batches([*self.terms(wanted, True)], pa.schema([("h", pa.int64()), ("key", pa.int64()), ("term", pa.string()), ("n", pa.int64())]))
        found = found.filter(pc.is_in(found.column("term"), value_set=terms))
        row = found.column("key").to_numpy()
        order = np.argsort(row, kind="stable")
        own, at = np.unique(row[order], return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)).astype(np.int32)), found.column("term").combine_chunks().take(pa.array(order)))
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(own)), lists], names=["key", "terms"])


def _hash_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h) of terms, as slices hash their runs."""
    for batch in batches:
        out = []
        for term in batch.column("term").to_pylist():
            words = hashes([w.encode() for w in term.split(" ")])
            h = mixed(words[:1])
            for w in words[1:]:
                h = mixed(h * NEXT + w)
            out.append(h)
        yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(out) if out else np.zeros(0, np.uint64)).view(np.int64))], names=["h"])


def _shortened(held: list[tuple[np.ndarray, np.ndarray]], kept: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """The sums of equal hashes, the ``kept`` largest of them, and the largest of the rest."""
    h, n = (np.concatenate(x) for x in zip(*held))
    h, own = np.unique(h, return_inverse=True)
    n = np.bincount(own, n, len(h)).astype(np.int64)
    if len(h) <= kept:
        return [(h, n)], 0
    order = np.argsort(-n, kind="stable")
    return [(h[order[:kept]], n[order[:kept]])], int(n[order[kept]])


@dataclass
class TopicModel:
    """Topics that explain how terms occur together: binary hidden factors with the greatest total correlation.

    ``alpha[j, i]`` says how far term i belongs to topic j; ``given`` has log p(x_i = 1 | y_j)
    and log p(x_i = 0 | y_j) for y_j = 0, 1. ``explained`` is the total correlation that each topic explains.
    """

    terms: list[str]
    alpha: np.ndarray
    given: np.ndarray  # (y, x, topic, term) log probabilities
    marginal: np.ndarray  # (x, term) log probabilities
    prior: np.ndarray  # (y, topic) log probabilities
    information: np.ndarray
    explained: np.ndarray

    @property
    def score(self) -> float:
        return float(self.explained.sum())

    def factors(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(p(y_j = 1 | x), log z), documents x topics, of documents given by the places of their terms, ``flat[starts[k]:starts[k + 1]]`` each."""
        ratio = self.alpha[None, None] * (self.given - self.marginal[None, :, None, :])
        absent, turn = ratio[:, 0].sum(-1), ratio[:, 1] - ratio[:, 0]  # (y, topic), (y, topic, term)
        by_term = np.ascontiguousarray(turn.reshape(-1, turn.shape[-1]).T)
        sums = np.zeros((len(starts) - 1, by_term.shape[1]))
        full = np.flatnonzero(np.diff(starts))
        if len(full):
            sums[full] = np.add.reduceat(by_term[flat], starts[full])
        logs = self.prior[:, None] + absent[:, None] + sums.reshape(len(sums), 2, -1).transpose(1, 0, 2)
        z = np.logaddexp(logs[0], logs[1])
        return np.exp(logs[1] - z), z


def _model(terms: list[str], n: int, present: np.ndarray, weight: np.ndarray, joint: np.ndarray, alpha: np.ndarray, explained: np.ndarray, held: bool) -> TopicModel:
    """A model from counts, its ``alpha`` moved towards where the information is unless it is ``held``: documents, those with each term, sums of p(y|x), and of p(y|x) over documents with each term."""
    ones = np.clip(np.stack([present[None] - joint, joint]), 0, None) + 0.01
    share = np.clip(np.stack([n - weight, weight]), 0, None) + 0.02
    p1 = ones / share[:, :, None]
    p1 = np.clip(p1, 1e-9, 1 - 1e-9)
    m1 = np.clip((present + 0.01) / (n + 0.02), 1e-9, 1 - 1e-9)
    given, marginal, prior = np.log(np.stack([1 - p1, p1], axis=1)), np.log(np.stack([1 - m1, m1])), np.log(share / share.sum(0))
    information = np.clip((np.exp(prior)[:, None, :, None] * np.exp(given) * (given - marginal[None, :, None, :])).sum((0, 1)), 0, None)
    # A term goes with the topic that tells most of it, and with others as near as they come; a
    # term's shares add up to 1, so that what the topics explain adds up to a bound of the whole.
    sharp = np.exp(np.clip((information - information.max(0)) / np.maximum(information.max(0), 1e-12) * 10, -50, 0))
    sharp /= sharp.sum(0)
    return TopicModel(terms, alpha if held else 0.7 * alpha + 0.3 * sharp, given, marginal, prior, information, explained)


#: Numbers of a piece of a topic's sums; tasks from which pieces are added up in two levels.
PIECE, MANY_TASKS = 2048, 64


@dataclass
class _Fit:
    """One fit under way."""

    n_topics: int
    seed: int
    alpha: np.ndarray
    model: TopicModel | None = None
    last: float = -1.0
    done: bool = False


def fit_topics(counts: DataFrame, n_topics: int, seed: int = 0, rounds: int = 30, tolerance: float = 1e-4) -> tuple[TopicModel, DataFrame, DataFrame]:
    """(model, (key, topic, p), (topic, term, weight)) of total-correlation topics over (key, term, tf), counts taken as 0 or 1, or over (key, terms) as ``Grams.doc_sets`` gives them.

    Terms are a vocabulary of bounded size; documents are never gathered. Rounds end when the
    correlation explained stays the same.
    """
    docs, terms = _incidence(counts)
    model = _fit_all(docs, terms, [(n_topics, seed)], rounds, tolerance)[0]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                p = shared.value.factors(*_places(batch.column("x")))[0]
                ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], names=["key", "p"])

    kind = docs.schema["key"].dataType.simpleString()
    shares = docs.select("key", "x").mapInArrow(placed, f"key {kind}, p array<double>").select("key", F.posexplode("p").alias("topic", "p"))
    own = [(j, terms[i], float(model.information[j, i])) for i in range(len(terms)) for j in [int(model.alpha[:, i].argmax())] if model.information[j, i] > 0]
    return model, shares, docs.sparkSession.createDataFrame(own, "topic int, term string, weight double")


def _incidence(counts: DataFrame) -> tuple[DataFrame, list[str]]:
    """((key, x, h): each document's terms by place, and a hash of them; the terms in order)."""
    sets = counts if "terms" in counts.columns else counts.groupBy("key").agg(F.collect_set("term").alias("terms"))
    sets = stored(sets.select("key", F.array_sort("terms").alias("terms")).where(F.size("terms") > 0))  # made once, read twice
    terms = sorted(r.term for r in sets.select(F.explode("terms").alias("term")).distinct().collect())  # a vocabulary, bounded by its size
    if not terms:
        raise ValueError("no documents with terms of the vocabulary")
    shared = counts.sparkSession.sparkContext.broadcast(pa.array(terms, pa.string()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("terms")
            x = pc.index_in(own.flatten().cast(pa.string()), value_set=shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pc.subtract(own.offsets, own.offsets[0]), x)], names=["key", "x"])

    docs = stored(sets.mapInArrow(placed, f"key {sets.schema['key'].dataType.simpleString()}, x array<int>").withColumn("h", F.xxhash64("x")))
    release(sets)
    return docs, terms


def _places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of all documents' terms, start of each and the end)."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy().astype(np.int64), ends - ends[0]


def _fit_all(docs: DataFrame, terms: list[str], fits: list[tuple[int, int]], rounds: int, tolerance: float) -> list[TopicModel]:
    """A model for each (topics, seed), all in the same rounds.

    A round is one job over the documents: a task holds the models and gives out sums, cut into
    pieces of a topic's terms. Pieces are added up by lots of tasks first where tasks
    are many, so no group holds a row of every task. The driver gets the sums of the models.
    """
    width, n = len(terms), docs.count()
    counted = docs.select(F.explode("x").alias("i")).groupBy("i").agg(F.count("*").alias("n")).toArrow()
    present = np.zeros(width)
    present[counted.column("i").to_numpy()] = counted.column("n").to_numpy()
    state = []
    for topics, seed in fits:
        # At first each term belongs to one topic by lot, so that topics start apart.
        alpha = np.where(np.arange(topics)[:, None] == np.random.default_rng(seed).permutation(width)[None, :] % topics, 1.0, 0.05)
        state.append(_Fit(topics, seed, alpha / alpha.sum(0)))
    for turn in range(rounds):
        going = [i for i, f in enumerate(state) if not f.done]
        if not going:
            break
        sums = _round(docs, width, {i: state[i] for i in going})
        for i in going:
            f, got = state[i], sums[i]
            explained = got[:, 1] / n
            f.model = _model(terms, n, present, got[:, 0], got[:, 2:], f.alpha, explained, held=turn < rounds // 3)
            f.alpha = f.model.alpha
            f.done = turn > rounds // 2 and abs(explained.sum() - f.last) < tolerance
            f.last = explained.sum()
    return [f.model for f in state]


def _round(docs: DataFrame, width: int, fits: dict[int, _Fit]) -> dict[int, np.ndarray]:
    """For each fit (topic: sum of p, sum of log z, sums of p by term) over all documents."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fits)
    size = 2 + width
    kind = "fit int, topic int, piece int, lot int, sums array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {i: np.zeros((f.n_topics, size)) for i, f in shared.value.items()}
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                flat_, starts = _places(batch.column("x"))
                row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                for i, f in shared.value.items():
                    if f.model is None:  # a first guess, by hashes of the documents' terms
                        h = batch.column("h").to_numpy().view(np.uint64) + np.uint64(f.seed * 1_000_003)
                        p = np.stack([(mixed(mixed(h) + np.uint64(j * 7919 + 1)) >> np.uint64(11)) / 2.0**53 for j in range(f.n_topics)], axis=1)
                        z = np.zeros_like(p)
                    else:
                        p, z = f.model.factors(flat_, starts)
                    out[i][:, 0] += p.sum(0)
                    out[i][:, 1] += z.sum(0)
                    for j in range(f.n_topics):
                        out[i][j, 2:] += np.bincount(flat_, p[row, j], width)
        lot = TaskContext.get().partitionId()
        for i, total in out.items():
            for j in range(len(total)):
                pieces = [total[j, a : a + PIECE] for a in range(0, size, PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pieces), v, dtype=np.int32)) if v is not None else pa.array(np.arange(len(pieces), dtype=np.int32)) for v in (i, j, None, lot)] + [pa.array(pieces, pa.list_(pa.float64()))], names=["fit", "topic", "piece", "lot", "sums"])

    def added(group: pa.Table) -> pa.Table:
        total = group.column("sums").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1).sum(0)
        return pa.table([*(group.column(c)[:1] for c in ("fit", "topic", "piece", "lot")), pa.array([total], pa.list_(pa.float64()))], names=["fit", "topic", "piece", "lot", "sums"])

    rows = docs.select("x", "h").mapInArrow(run, kind)
    tasks = docs.rdd.getNumPartitions()
    if tasks > MANY_TASKS:
        lots = int(tasks**0.5) + 1
        rows = rows.withColumn("lot", (F.col("lot") % lots).cast("int")).groupBy("fit", "topic", "piece", "lot").applyInArrow(added, kind)
    parts = rows.groupBy("fit", "topic", "piece").applyInArrow(added, kind).collect()
    out: dict[int, np.ndarray] = {i: np.zeros((f.n_topics, size)) for i, f in fits.items()}
    for r in parts:
        out[r.fit][r.topic, r.piece * PIECE : r.piece * PIECE + len(r.sums)] = r.sums
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Hash values spread over all 64 bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def top_terms(terms: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` terms of each topic that tell most of it; ties by term."""
    return terms.withColumn("_k", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term"))).where(F.col("_k") <= n).drop("_k")


def best_n_topics(counts: DataFrame, grid: list[int], seeds: tuple[int, ...] = (0,), rounds: int = 30, tolerance: float = 1e-4) -> tuple[TopicModel, DataFrame]:
    """(best model, (n_topics, score) best first): the grid's fits that explain most total correlation, each from its best start, all fitted in the same rounds."""
    docs, terms = _incidence(counts)
    asked = [(n, seed) for n in grid for seed in seeds]
    models = _fit_all(docs, terms, asked, rounds, tolerance)
    best = {n: max((m for (k, _), m in zip(asked, models) if k == n), key=lambda m: m.score) for n in grid}
    table = counts.sparkSession.createDataFrame([(n, m.score) for n, m in best.items()], "n_topics int, score double").orderBy(F.desc("score"), "n_topics")
    return max(best.items(), key=lambda f: (f[1].score, -f[0]))[1], table


def cleaned(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(text, clean_topic(F.col(text)))
