"""Entity resolution: candidates, text and graph scores, constraints, communities, merging.

``Resolver`` holds the tables and settings of one node type; every step returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import clean_entity, edit_ratio, initials, initials_similarity, parts_similarity
from loomgraph.functions.scratch import stored
from loomgraph.operators import graphs, similarity
from loomgraph.operators.windows import percentile_ranks
from loomgraph.sources.readers import symmetric

#: Metrics by node type; other types take the default (fixed values).
METRICS = {"Scientist": ("tfidf", "lev", "parts", "initials", "likelihood")}
DEFAULT_METRICS = ("tfidf", "lev")
#: Strict lower limits by node type and metric (fixed values).
CONSTRAINTS = {"Scientist": {"text": 2.0, "graph": 0.0}}
DEFAULT_CONSTRAINTS = {"text": 1.0, "graph": 0.0}
#: Graphs whose projection relates nodes of a type: name, types of both ends of an edge, steps (fixed values).
_VENUE = (("colocation", "Source", "Journal", 1),)
NEIGHBOURS = {
    "Institution": (("colocation", "Institution", "Location", 1), ("shared_staff", "Scientist", "Institution", 1)),
    "Location": (("shared_institutions", "Institution", "Location", 1),),
    "Scientist": (("coauthor", "Scientist", "Paper", 2), ("colleague", "Scientist", "Institution", 1)),
    "Source": _VENUE, "Journal": _VENUE, "Book": _VENUE, "Conference": _VENUE,
}


@dataclass
class Resolver:
    """Scores, constraints, communities and merges for the nodes of one type.

    ``blacklist(from, to)`` flags pairs after scoring; ``merged_before(match1, match2,
    canonical)`` is a log of earlier merges that ``log`` adds to; ``predict`` gives a
    model's match probability for two columns of names (a score of its own, in no sum).
    ``neighbours`` None means the graphs of the node type (NEIGHBOURS); types without an
    entry have none, and graph 0.
    """

    nodes: DataFrame
    edges: DataFrame
    node_type: str
    threshold: float = 0.8
    blacklist: DataFrame | None = None
    name: str = "displayName"
    metrics: tuple[str, ...] = ()
    constraints: dict[str, float] | None = None
    neighbours: tuple[tuple[str, str, str, int], ...] | None = None
    predict: Callable[[Column, Column], Column] | None = None
    merged_before: DataFrame | None = None

    def __post_init__(self) -> None:
        self.metrics = self.metrics or METRICS.get(self.node_type, DEFAULT_METRICS)
        if self.constraints is None:
            self.constraints = CONSTRAINTS.get(self.node_type, DEFAULT_CONSTRAINTS)
        if self.neighbours is None:
            self.neighbours = NEIGHBOURS.get(self.node_type, ())
        cleaned = clean_entity(F.coalesce(F.col(self.name), F.lit("")))
        self.own = self.nodes.where(F.col("nodeType") == self.node_type).select(F.col("nodeID").alias("id"), cleaned.alias("name"))

    def candidates(self) -> DataFrame:
        """(from, to) that may be the same: characters alike."""
        return similarity.candidate_pairs(self.own, "id", "name", self.threshold).select(F.col("a").alias("from"), F.col("b").alias("to"))

    def text_scores(self, pairs: DataFrame | None = None) -> DataFrame:
        """(from, to, one column a metric, text, blacklist).

        ``text`` is the sum of word cosine, edit ratio and part ratio, times the percentile
        of the initials' score, times the rarity of both names. Names of one part have no
        likelihood, and no text score. The blacklist comes last: it changes no score, but
        with one missing scores become 0.
        """
        pairs = stored(self.candidates() if pairs is None else pairs)
        p = pairs.join(self.own.toDF("from", "from_name"), "from").join(self.own.toDF("to", "to_name"), "to")
        total = F.lit(0.0)  # an expression over columns added below
        if "tfidf" in self.metrics:
            w = similarity.word_similarity(pairs.select(F.col("from").alias("a"), F.col("to").alias("b")), self.own, "id", "name")
            p = p.join(w.toDF("from", "to", "tfidf"), ["from", "to"])
            total += F.col("tfidf")
        if "lev" in self.metrics:
            p = p.withColumn("lev", edit_ratio("from_name", "to_name"))
            total += F.col("lev")
        if "parts" in self.metrics:
            p = p.withColumn("parts", parts_similarity("from_name", "to_name"))
            total += F.col("parts")
        if self.predict is not None:
            p = p.withColumn("predict", self.predict(F.col("from_name"), F.col("to_name")))
        if "initials" in self.metrics:
            p = stored(p.withColumn("_i", initials_similarity(initials(F.col("from_name")), initials(F.col("to_name")))))
            p = percentile_ranks(p, "_i", "initials").drop("_i")
            total *= F.col("initials")
        if "likelihood" in self.metrics:
            k = stored(similarity.part_likelihood(self.own, "id", "name"))
            p = p.join(k.toDF("from", "_a"), "from", "left").join(k.toDF("to", "_b"), "to", "left")
            mean = (F.col("_a") + F.col("_b")) / 2
            p = p.join(F.broadcast(p.agg(F.max(mean).alias("_top")))).withColumn("likelihood", F.pow(1 - mean / F.col("_top"), F.lit(4))).drop("_a", "_b", "_top")
            total *= F.col("likelihood")
        p = p.withColumn("text", total).drop("from_name", "to_name")
        if self.blacklist is None:
            return p.withColumn("blacklist", F.lit(False))
        listed = symmetric(self.blacklist).withColumn("blacklist", F.lit(True))
        return p.join(listed, ["from", "to"], "left").fillna(False, ["blacklist"]).fillna(0.0)

    def graph_scores(self, pairs: DataFrame) -> DataFrame:
        """``pairs(from, to)`` with ``graph``: per neighbour graph the percentile of the pair's weight among positive ones, added up.

        At one step the weight is the number of shared nodes, at two steps that of
        ``graphs.two_steps``. Where all pairs have one weight, that graph counts 0.
        """
        p = stored(pairs.select(F.col("from").alias("u"), F.col("to").alias("v")))
        out = p.withColumn("graph", F.lit(0.0))
        for _, source, target, steps in self.neighbours:
            e = self.edges.where((F.col("fromNodeType") == source) & (F.col("toNodeType") == target))
            e = e.select(F.col("from").alias("own"), F.col("to").alias("other")) if source == self.node_type else e.select(F.col("to").alias("own"), F.col("from").alias("other"))
            weigh = graphs.shared_neighbours if steps == 1 else graphs.two_steps
            scored = stored(weigh(p, e, "own", "other").withColumn("weight", F.col("weight").cast("double")))
            ranked = percentile_ranks(scored, "weight", "_p", positive_only=True)
            spread = scored.agg((F.max("weight") > F.min("weight")).alias("_any"))
            out = out.join(ranked.select("u", "v", "_p"), ["u", "v"]).join(F.broadcast(spread)).withColumn("graph", F.col("graph") + F.when(F.col("_any"), F.col("_p")).otherwise(0.0)).drop("_p", "_any")
        return out.select(F.col("u").alias("from"), F.col("v").alias("to"), "graph")

    def scores(self) -> DataFrame:
        """Text and graph scores and their sum."""
        t = stored(self.text_scores())
        return t.join(self.graph_scores(t), ["from", "to"]).withColumn("total", F.col("text") + F.col("graph"))

    def resolved(self, scores: DataFrame | None = None) -> DataFrame:
        """Pairs strictly above every constraint, without self-pairs and blacklisted ones."""
        from loomgraph.operators.etl import constrained

        return constrained(_allowed(scores if scores is not None else self.scores()), self.constraints).where("`from` <> `to`")

    def communities(self, scores: DataFrame, metric: str = "total", above: float = 0.0) -> DataFrame:
        """(node, cluster) over pairs whose metric is over a limit."""
        return graphs.communities(_allowed(scores).where(F.col(metric) > above).select("from", "to", F.col(metric).alias("weight")))

    def impact(self, clusters: DataFrame) -> DataFrame:
        """(cluster, nodes, edges, names) by falling size: what merging would touch."""
        ends = self.edges.select(F.col("from").alias("node")).unionAll(self.edges.select("to")).groupBy("node").agg(F.count("*").alias("n"))
        c = clusters.join(ends, "node", "left").join(self.own.toDF("node", "name"), "node")
        return c.groupBy("cluster").agg(F.count("*").alias("nodes"), F.sum(F.coalesce("n", F.lit(0))).alias("edges"), F.array_sort(F.collect_set("name")).alias("names")).where("nodes > 1").orderBy(F.desc("nodes"), "cluster")

    def merged(self, clusters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes, edges and the log (cluster, canonical, merged) after merging clusters."""
        return graphs.merge_clusters(self.nodes, self.edges, clusters)

    def log(self, made: DataFrame) -> DataFrame:
        """(match1, match2, canonical): earlier merges and those of a ``merged`` log, each once."""
        new = made.select(F.col("canonical").alias("match1"), F.col("merged").alias("match2"), "canonical")
        return new.distinct() if self.merged_before is None else self.merged_before.select("match1", "match2", "canonical").unionByName(new).distinct()


def filtered(scores: DataFrame, metric: str, above: float) -> DataFrame:
    """Pairs whose metric is strictly over a limit."""
    return scores.where(F.col(metric) > above)


def _allowed(scores: DataFrame) -> DataFrame:
    return scores.where(~F.col("blacklist")) if "blacklist" in scores.columns else scores


def add_to_blacklist(blacklist: DataFrame, pairs: DataFrame) -> DataFrame:
    """The blacklist with further pairs, symmetric, each once."""
    return symmetric(blacklist.select("from", "to").unionAll(pairs.select("from", "to")))


def cluster_to_blacklist(blacklist: DataFrame, clusters: DataFrame, rejected: DataFrame) -> DataFrame:
    """Adds all pairs within rejected clusters (decided one by one by people, so small)."""
    own = clusters.join(rejected.select("cluster"), "cluster", "left_semi")
    pairs = own.toDF("cluster", "from").join(own.toDF("cluster", "to"), "cluster") if own.columns == ["cluster", "node"] else own.select("cluster", F.col("node").alias("from")).join(own.select("cluster", F.col("node").alias("to")), "cluster")
    return add_to_blacklist(blacklist, pairs.where("`from` <> `to`"))


def accepted_clusters(decisions: DataFrame) -> DataFrame:
    """(node, cluster) from decisions (from, to, accepted): components of what was accepted."""
    return graphs.connected_components(decisions.where("accepted").select("from", "to")).withColumnRenamed("component", "cluster")


def iterate(nodes: DataFrame, size: int, iteration: int) -> DataFrame:
    """Nodes with the chunk they are in for one iteration; each iteration shuffles anew."""
    from loomgraph.operators.windows import chunks

    return chunks(nodes, "nodeID", size, seed=iteration).withColumn("iteration", F.lit(iteration))


def history_row(nodes: DataFrame, edges: DataFrame, iteration: int, chunk: int, metric: str, constraints: dict[str, float], merged: bool) -> DataFrame:
    """An audit row for a chunk: metric, constraints, its nodes, all edges, and whether its merges were made."""
    one = nodes.agg(F.count_distinct("nodeID").alias("n_nodes")).join(F.broadcast(edges.agg(F.count("*").alias("n_edges"))))
    made = F.to_json(F.map_from_arrays(F.array(*map(F.lit, constraints)), F.array(*map(F.lit, constraints.values())))) if constraints else F.lit("{}")
    return one.select(F.lit(iteration).alias("iteration"), F.lit(chunk).alias("chunk"), F.lit(metric).alias("metric"), made.alias("constraints"), "n_nodes", "n_edges", F.lit(merged).alias("merged"))


@dataclass
class Merging:
    """Resolution in chunks over iterations, one node type at a time, with a history to resume from.

    ``chunked`` holds the iteration's nodes with their chunk; ``history`` a row a chunk.
    A run goes: ``scores()``, ``candidates_for_review()``, ``decide(decisions)``, and then
    ``next_chunk()``, or ``next_iteration()`` after the last one. All tables are written to
    the shared folder, those given too, so a step can be run again and none makes them anew.
    """

    nodes: DataFrame
    edges: DataFrame
    node_type: str
    size: int = 10_000
    threshold: float = 0.9
    blacklist: DataFrame | None = None
    metric: str = "text"
    constraints: dict[str, float] | None = None
    history: DataFrame | None = None
    chunked: DataFrame | None = None
    iteration: int = 0
    chunk: int = 0

    def __post_init__(self) -> None:
        self._scores: DataFrame | None = None
        self.nodes, self.edges = stored(self.nodes), stored(self.edges)
        last = self.history.orderBy(F.desc("iteration"), F.desc("chunk")).first() if self.history is not None else None
        if last is not None:
            # The last chunk again if it wasn't merged, else the one after it, else a new iteration.
            self.iteration, self.chunk = last.iteration, last.chunk + bool(last.merged)
            if self.chunked is None or self.chunked.where(F.col("chunk") == self.chunk).isEmpty():
                self.iteration, self.chunk, self.chunked = last.iteration + 1, 0, None
        if self.chunked is None:
            self.chunked = stored(iterate(self.nodes.where(F.col("nodeType") == self.node_type).select("nodeID").distinct(), self.size, self.iteration))

    def active(self) -> DataFrame:
        """Nodes of the active chunk; names in lists stand one a row, missing ones are ''."""
        ids = self.chunked.where(F.col("chunk") == self.chunk).select("nodeID")
        own = self.nodes.join(ids, "nodeID", "left_semi")
        if own.schema["displayName"].dataType.typeName() == "array":
            own = own.withColumn("displayName", F.explode_outer("displayName"))
        return own.fillna("", ["displayName"])

    def resolver(self) -> Resolver:
        return Resolver(self.active(), self.edges, self.node_type, self.threshold, self.blacklist, constraints=self.constraints)

    def scores(self) -> DataFrame:
        """Scores within the active chunk, made once."""
        if self._scores is None:
            self._scores = stored(self.resolver().scores())
        return self._scores

    def candidates_for_review(self) -> DataFrame:
        """(from, to, score) that meet every constraint."""
        return self.resolver().resolved(self.scores()).select("from", "to", F.col(self.metric).alias("score"))

    def decide(self, decisions: DataFrame) -> DataFrame:
        """Merges what ``decisions(from, to, accepted)`` accept; rejected pairs go on the blacklist. Gives the merge log.

        Nodes that were merged leave the graph; edges are rewritten; the history gets a row.
        """
        resolver = self.resolver()
        rejected = decisions.where("not accepted").select("from", "to")
        none = rejected.where("false")
        self.blacklist = stored(add_to_blacklist(self.blacklist if self.blacklist is not None else none, rejected))
        before = (self.active().select("nodeID"), self.edges)
        nodes, edges, log = graphs.merge_clusters(self.nodes, self.edges, accepted_clusters(decisions))
        log = stored(log)
        row = history_row(*before, self.iteration, self.chunk, self.metric, resolver.constraints, True)
        self.history = stored(row if self.history is None else self.history.unionByName(row))
        self.nodes, self.edges, self._scores = stored(nodes), stored(edges), None
        return log

    def next_chunk(self) -> bool:
        """Goes on to the next chunk; False, and no move, after the last one."""
        if self.chunked.where(F.col("chunk") == self.chunk + 1).isEmpty():
            return False
        self.chunk, self._scores = self.chunk + 1, None
        return True

    def next_iteration(self, size: int | None = None) -> None:
        """Deals what is left of the nodes to new chunks."""
        self.size = size or self.size
        self.iteration, self.chunk, self._scores = self.iteration + 1, 0, None
        self.chunked = stored(iterate(self.nodes.where(F.col("nodeType") == self.node_type).select("nodeID").distinct(), self.size, self.iteration))

    def for_type(self, node_type: str) -> Merging:
        """The same graph for another node type; a history belongs to one type and begins anew."""
        return Merging(self.nodes, self.edges, node_type, self.size, self.threshold, self.blacklist, self.metric)

    def run(self, accept: Callable[[DataFrame], DataFrame], iterations: int) -> DataFrame:
        """All chunks of so many iterations one after the other: (node, canonical) of all that was merged.

        ``accept`` turns ``candidates_for_review`` into decisions (from, to, accepted). A node that was merged
        again later is followed to the node that is left in the graph.
        """
        last: DataFrame | None = None
        for turn in range(iterations):
            if turn:
                self.next_iteration()
            while True:
                log = self.decide(accept(self.candidates_for_review())).select(F.col("merged").alias("node"), "canonical")
                if last is None:
                    last = log
                else:  # what was merged into a node that is merged now goes on with it
                    on = log.select(F.col("node").alias("canonical"), F.col("canonical").alias("next"))
                    moved = last.join(on, "canonical", "left").select("node", F.coalesce("next", "canonical").alias("canonical"))
                    last = stored(moved.unionByName(log))
                if not self.next_chunk():
                    break
        return last
