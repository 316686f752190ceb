"""Sentence and token tables, span algebra, role assembly and sequence alignment.

Models (tagging, parsing, coreference) plug in as providers; what is here is what comes
before and after them.
"""

from __future__ import annotations

import json
import math
import re
import subprocess
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from loomgraph.functions import arrays
from loomgraph.operators.windows import offsets

#: Words of a sentence that is kept: more than the first, fewer than the second.
SENTENCE_WORDS = (2, 350)


def sentences(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row a sentence: ends of sentences are . ! ? before white space."""
    parts = F.filter(F.split(F.regexp_replace(F.col(text), r"([.!?])[ \t\r\n]+", "$1\u0001"), "\u0001"), lambda x: F.length(F.trim(x)) > 0)
    return df.select(*keep, F.posexplode(parts).alias("position", "sentence"))


def word_count(sentence: Column) -> Column:
    """Space-separated parts with a letter."""
    return F.size(F.filter(F.split(sentence, " "), lambda x: x.rlike("[a-zA-Z]")))


def sentence_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, sentence_id, sentence): sentences of useful length, numbered per document from 0."""
    s = sentences(df, text, F.col(key).alias("doc_id"))
    n = word_count(F.col("sentence"))
    s = s.where((n > SENTENCE_WORDS[0]) & (n < SENTENCE_WORDS[1]))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("position")) - 1
    return s.select("doc_id", F.concat_ws("_", F.col("doc_id").cast("string"), k.cast("string")).alias("sentence_id"), "sentence", k.alias("k"))


def documents_of(sentences_: DataFrame) -> DataFrame:
    """Documents put together again from their sentences in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "sentence"))), lambda x: x["sentence"])
    return sentences_.groupBy("doc_id").agg(F.array_join(ordered, " ").alias("document"))


def describe(df: DataFrame) -> DataFrame:
    """Per ``doc`` of (doc, n): mean, greatest and least n, and how many rows."""
    return df.groupBy("doc").agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("longest"), F.min("n").alias("shortest"), F.count("*").alias("n"))


def provider(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A model behind batches of rows: built once a task, called per Arrow batch."""
    return df.mapInPandas(f, schema)


def batched(df: DataFrame, make: Callable[[], Callable[[list[str]], list[dict]]], schema: str, text: str = "sentence", keys: tuple[str, ...] = ("sentence_id",), size: int = 128) -> DataFrame:
    """Predictions of a model for ``size`` texts at a time, with the rows' keys.

    ``make`` builds the model in the task (so weights load once a task, on its device);
    the model takes texts and gives one record each with the fields of ``schema``. A null
    text goes in as ''.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                made = pd.DataFrame(model(part[text].fillna("").tolist()))
                yield pd.concat([part[list(keys)].reset_index(drop=True), made], axis=1)

    kept = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, text).mapInPandas(run, f"{kept}, {schema}")


#: Steps of a discovery run, in the order in which they run if none is given (fixed values).
STEPS = ("ner", "pos", "svo", "srl", "coref", "sentiment", "np")


def discover(sentences_: DataFrame, documents: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]], order: tuple[str, ...] = STEPS) -> tuple[dict[str, DataFrame], list[str]]:
    """(result of each step, steps that failed): ordered runs of model steps over sentences, coreference over documents.

    A step without a function, or whose plan can't be made, is skipped and named; the rest
    go on. Results are lazy. Without sentences nothing runs.
    """
    done: dict[str, DataFrame] = {}
    failed: list[str] = []
    if sentences_.isEmpty():
        return done, list(order)
    for name in order:
        try:
            done[name] = steps[name](documents if name == "coref" else sentences_)
        except Exception as e:  # a model that fails must not stop the others
            failed.append(f"{name}: {e!r}")
    return done, failed


def external_spans(documents: DataFrame, command: list[str], schema: str, key: str = "doc_id") -> DataFrame:
    """Entities and relations from a span model that runs as a program of its own, once a batch of documents.

    The program reads a JSON record a line (key, tokens) and writes one a line in the same
    order, with the fields of ``schema``; its settings file is part of ``command``. A null
    token list is empty.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lines = [json.dumps({"key": str(k), "tokens": [] if t is None else list(t)}) for k, t in zip(frame[key], frame["tokens"])]
            out = subprocess.run(command, input="\n".join(lines), capture_output=True, text=True, check=True).stdout.splitlines()
            yield pd.concat([frame[[key]].reset_index(drop=True), pd.DataFrame([json.loads(x) for x in out])], axis=1)

    return documents.select(key, "tokens").mapInPandas(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, {schema}")


def subword_embeddings(documents: DataFrame, make: Callable[[], Callable[[list[str]], list[list[tuple[str, list[float]]]]]], seconds: str, key: str = "doc_id", text: str = "text", size: int = 16) -> DataFrame:
    """(key, month, position, token, vector): a model's vectors of word pieces, ``size`` documents at a time, by month of an epoch column.

    Write it with ``writers.save_months``'s layout (``partitionBy("month")``); months are
    partitions of one job, not jobs in a loop. Pieces in brackets ([CLS], [SEP]) are left out.
    """
    rows = documents.select(F.col(key).alias("key"), F.month(F.timestamp_seconds(seconds)).alias("month"), F.col(text).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                made = model(part["text"].fillna("").tolist())
                flat = [(k, m, i, t, v) for k, m, pieces in zip(part["key"], part["month"], made) for i, (t, v) in enumerate(pieces) if not (t.startswith("[") and t.endswith("]"))]
                yield pd.DataFrame(flat, columns=["key", "month", "position", "token", "vector"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, month int, position int, token string, vector array<double>").withColumnRenamed("key", key)


def hashed_pieces(size: int = 32, piece: int = 4) -> Callable[[], Callable[[list[str]], list[list[tuple[str, list[float]]]]]]:
    """A model for ``subword_embeddings`` without weights: words in pieces of ``piece`` letters, each a unit vector of its letters' pairs by signed hashing."""

    def make() -> Callable[[list[str]], list[list[tuple[str, list[float]]]]]:
        known: dict[str, list[float]] = {}

        def vector(token: str) -> list[float]:
            if token not in known:
                if len(known) >= 100_000:
                    known.clear()
                x = np.zeros(size)
                padded = f"<{token}>"
                for i in range(len(padded) - 1):
                    h = zlib.crc32(padded[i : i + 2].encode())
                    x[h % size] += 1.0 if h >> 16 & 1 else -1.0
                length = float(np.sqrt((x * x).sum()))
                known[token] = (x / length if length else np.eye(size)[0]).tolist()
            return known[token]

        def model(texts: list[str]) -> list[list[tuple[str, list[float]]]]:
            out = []
            for text in texts:
                pieces = []
                for word in text.lower().split():
                    pieces += [("##" if at else "") + word[at : at + piece] for at in range(0, len(word), piece)]
                out.append([(t, vector(t)) for t in pieces])
            return out

        return model

    return make


_TEXTS = ArrayType(StringType())
_SPAN = pa.struct([("text", pa.string()), ("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())])
_SPANS = ArrayType(StructType([*(StructField(x, StringType()) for x in ("text", "type")), *(StructField(x, IntegerType()) for x in ("start", "end")), StructField("confidence", DoubleType())]))
_TRIPLE = ArrayType(StructType([StructField(x, StringType()) for x in "svo"]))


def tag_runs(tags: list[str]) -> list[list[int]]:
    """Places of the words of each entity in BILOU tags, in the order in which entities are given out.

    A run opens at B and takes I and L of its type; L closes it. An open run is also given
    out at the next B, O or U, and a foreign L gives out a run of two words or more. O, U
    and an L that closes nothing are words of their own. An I that fits no run is lost, and
    so is a run that the sentence leaves open.
    """
    out: list[list[int]] = []
    run: list[int] = []
    for i, tag in enumerate(tags):
        mark, kind = tag[:2], tag.rsplit("-", 1)[-1]
        fits = bool(run) and tags[run[0]].rsplit("-", 1)[-1] == kind
        if mark == "I-":
            run += [i] * fits
        elif mark == "L-" and fits:
            out.append([*run, i])
            run = []
        elif mark == "B-":
            if run:
                out.append(run)
            run = [i]
        else:
            if run and (mark != "L-" or len(run) > 1):
                out.append(run)
                run = []
            out.append([i])
    return out


#: Sentences that stand as Python objects at once.
SLICE_ROWS = 64


def _by_slices(make: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``make`` of every row, a slice of rows at a time: a batch of whole sentences as objects takes many times its bytes."""
    parts = [pa.array([make(*row) for row in zip(*(c.slice(at, SLICE_ROWS).to_pylist() for c in columns))], kind) for at in range(0, len(columns[0]), SLICE_ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(_SPANS)
def _merged(words: pa.Array, tags: pa.Array, logits: pa.Array) -> pa.Array:
    def of(w: list[str] | None, t: list[str] | None, x: list[list[float]] | None) -> list[dict]:
        c = [1 / sum(math.exp(v - max(row)) for v in row) for row in x or []]
        at, spans = 0, []
        for run in tag_runs(t or []):
            text = " ".join(w[i] for i in run)
            spans.append({"text": text, "type": t[run[-1]].rsplit("-", 1)[-1], "start": at, "end": at + len(text) - 1, "confidence": sum(c[i] for i in run) / len(run) if c else None})
            at += len(text) + 1
        return spans

    return _by_slices(of, pa.list_(_SPAN), words, tags, logits)


def merge_tags(words: Column, tags: Column, logits: Column | None = None) -> Column:
    """Entities of BILOU tags as (text, type, start, end, confidence), by ``tag_runs``.

    Offsets count what is given out, one space between, ends included. A word's confidence
    is the largest softmax of its ``logits``, an entity's the mean of its words'.
    """
    return _merged(words, tags, F.lit(None).cast("array<array<double>>") if logits is None else logits)


def tag_rows(df: DataFrame, by: list[str], words: str, tags: str, logits: str, mask: str) -> DataFrame:
    """Without merging: (by, position, token, predicted_role, confidence, start_idx, end_idx), one row a word.

    Confidences are those of the word pieces that ``mask`` keeps, in order.
    """
    sure = F.transform(arrays.compress(F.col(logits), F.col(mask)), lambda x: F.array_max(arrays.softmax(x)))
    one = F.posexplode(F.arrays_zip(F.col(words).alias("token"), F.col(tags).alias("predicted_role"), sure.alias("confidence"))).alias("position", "x")
    rows = df.select(*by, one).select(*by, "position", "x.*").where("token IS NOT NULL")
    at = offsets(rows, by, ["position"], F.length("token"), gap=1)
    return at.select(*by, "position", "token", "predicted_role", "confidence", F.col("start").alias("start_idx"), (F.col("start") + F.length("token") - 1).alias("end_idx"))


@F.arrow_udf(_TRIPLE)
def triples(words: pa.Array, roles: pa.Array, pos: pa.Array) -> pa.Array:
    """(subject, verb, object) triples of a sentence, in any order of the three; what was found is forgotten after each.

    The verb is a VERB that is the root; any other word is the subject if its role is
    nsubj, and the object if its role holds 'obj' (dobj, pobj, iobj). Later words replace
    earlier ones.
    """

    def of(w: list[str] | None, r: list[str] | None, p: list[str] | None) -> list[dict]:
        found, held = [], {}
        for word, role, kind in zip(w or [], r or [], p or []):
            part = "v" if role == "root" and kind == "VERB" else "s" if role == "nsubj" else "o" if "obj" in (role or "") else None
            if part:
                held[part] = word
            if len(held) == 3:
                found.append(held)
                held = {}
        return found

    return _by_slices(of, pa.list_(pa.struct([("s", pa.string()), ("v", pa.string()), ("o", pa.string())])), words, roles, pos)


def morphology(features: Column) -> tuple[Column, Column]:
    """(tense, verb form) from a map of morphological features; 'None' where there is neither."""
    named = lambda key, names: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.try_element_at(features, F.lit(key))), F.lit("None"))
    return named("Tense", {"Pres": "present", "Past": "past"}), named("VerbForm", {"Inf": "infinitive", "Part": "participle", "Fin": "finite", "Mod": "modifier"})


@F.arrow_udf(_TEXTS)
def future_tense(tenses: pa.Array, forms: pa.Array, tags: pa.Array) -> pa.Array:
    """Tense per word, with 'future' for tenseless infinitives that a modifier ('will rise') or a 'to' ('is expected to rise') announces.

    The two announcements are apart: each holds until an infinitive uses it up, the
    modifier's first, whatever verbs stand between.
    """

    def of(*row: list[str] | None) -> list[str]:
        out, modifier, to = [], False, False
        for tense, form, tag in zip(*(x or [] for x in row)):
            bare = tense == "None" and form == "infinitive"
            if bare and (modifier or to):
                tense = "future"
                modifier, to = False, to and modifier
            modifier |= form == "modifier"
            to |= form == "infinitive" and tag == "TO"
            out.append(tense)
        return out

    return _by_slices(of, pa.list_(pa.string()), tenses, forms, tags)


def role_map(df: DataFrame) -> DataFrame:
    """(sentence_id, tok_idx, token, srl_args): per token a map from verb number to tag, from ``words`` and ``verbs`` (arrays of tags)."""
    tokens = df.select("sentence_id", F.posexplode("words").alias("tok_idx", "token"), "verbs")
    pairs = F.transform(F.col("verbs"), lambda v, i: F.struct(i.alias("k"), F.try_element_at(v, F.col("tok_idx") + 1).alias("v")))
    return tokens.select("sentence_id", "tok_idx", "token", F.map_from_entries(pairs).alias("srl_args"))


def cluster_tokens(tokens: DataFrame, clusters: DataFrame) -> DataFrame:
    """Tokens with the mentions of each cluster they are in: ``clusters(sentence_id, cluster, start, end)``, ends included."""
    spans = clusters.select("sentence_id", "cluster", "start", "end", F.explode(F.sequence("start", "end")).alias("tok_idx"))
    named = spans.join(tokens.select("sentence_id", "tok_idx", "token"), ["sentence_id", "tok_idx"])
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "token"))), lambda x: x["token"]), "-")
    mentions = named.groupBy("sentence_id", "cluster", "start", "end").agg(ordered.alias("mention"))
    sets = mentions.groupBy("sentence_id", "cluster").agg(F.array_sort(F.collect_set("mention")).alias("mentions"))
    per_token = spans.select("sentence_id", "cluster", "tok_idx").distinct().join(sets, ["sentence_id", "cluster"])
    lists = per_token.groupBy("sentence_id", "tok_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "mentions"))), lambda x: x["mentions"]).alias("clusters"))
    return tokens.join(lists, ["sentence_id", "tok_idx"], "left")


def assemble_roles(tokens: DataFrame, phrase: str | None = None) -> DataFrame:
    """(sentence_id, verb, role, text, ids, phrases): tokens of one role of one verb in order, from ``srl_args`` maps; role O is left out.

    ``phrase`` names a column of noun-phrase labels a token; ``phrases`` lists those of a
    role in order, each once.
    """
    label = F.col(phrase) if phrase else F.lit("")
    long = tokens.select("sentence_id", "tok_idx", "token", label.alias("phrase"), F.explode("srl_args").alias("verb", "tag")).where("tag <> 'O'").withColumn("role", F.regexp_replace("tag", "^[BI]-", ""))
    own = F.array_sort(F.collect_list(F.struct("tok_idx", "token", "phrase")))
    g = long.groupBy("sentence_id", "verb", "role").agg(own.alias("x"))
    phrases = F.filter(F.array_distinct(F.transform("x", lambda t: t["phrase"])), lambda p: p != "")
    return g.select("sentence_id", "verb", "role", F.array_join(F.transform("x", lambda t: t["token"]), " ").alias("text"), F.array_join(F.transform("x", lambda t: t["tok_idx"].cast("string")), "-").alias("ids"), phrases.alias("phrases"))


def role_triples(assembled: DataFrame) -> DataFrame:
    """One row a verb that has ARG0, V and ARG1."""
    wide = assembled.groupBy("sentence_id", "verb").pivot("role", ["ARG0", "V", "ARG1"]).agg(F.first("text"))
    return wide.na.drop(subset=["ARG0", "V", "ARG1"])


def relations(df: DataFrame) -> DataFrame:
    """(from, to, type, weight) from ``tokens, entities, relations``; conjunctions and blanks are left out."""
    r = df.select("tokens", "entities", F.explode("relations").alias("r")).where("r.type <> 'Conjunction'")
    name = lambda i: (lambda e: F.array_join(F.slice(F.col("tokens"), e["start"] + 1, e["end"] - e["start"]), " "))(F.try_element_at(F.col("entities"), i + 1))
    named = r.select(name(F.col("r.head")).alias("from"), name(F.col("r.tail")).alias("to"), F.col("r.type").alias("type")).where("`from` <> '' AND `to` <> ''")
    return named.groupBy("from", "to", "type").agg(F.count("*").alias("weight"))


#: Tags of nouns (fixed values).
NOUNS = ("NN", "NNP", "NNS", "NNPS")
#: A noun phrase over one letter a word: an optional determiner, adjectives, conjunctions, adjectives, nouns, and hyphenated further nouns.
PHRASE = re.compile("D?J*C*J*N+(?:HN+)*")


def coded_tags(tags: Column) -> Column:
    """One letter a word: D, J, C, N, H for determiners, adjectives, conjunctions, nouns and hyphens, x for the rest."""
    letter = lambda t: F.when(t.isin(*NOUNS), "N").when(t == "DT", "D").when(t == "JJ", "J").when(t == "CC", "C").when(t == "HYPH", "H").otherwise("x")
    return F.array_join(F.transform(tags, letter), "")


@F.arrow_udf(_TEXTS)
def _phrases(words: pa.Array, coded: pa.Array) -> pa.Array:
    of = lambda w, c: [" ".join(w[m.start() : m.end()]) for m in PHRASE.finditer(c or "")]
    return _by_slices(of, pa.list_(pa.string()), words, coded)


def noun_phrases(words: Column, tags: Column) -> Column:
    """The noun phrases of a sentence from left to right, each joined with spaces."""
    return _phrases(words, coded_tags(tags))


def marked_places(words: list[str], phrase: list[str]) -> list[range]:
    """Where a phrase is found by one scan that starts anew behind a mismatch and notes a find at the word after it.

    So a phrase that ends the sentence is not noted, nor one that begins at a word that broke another.
    """
    found, k = [], 0
    for i, word in enumerate(words):
        if k == len(phrase):
            found.append(range(i - k, i))
            if i == len(words) - 1:
                break
            k = 0
        k = k + 1 if word == phrase[k] else 0
    return found


@F.arrow_udf(_TEXTS)
def _labels(words: pa.Array, phrases: pa.Array) -> pa.Array:
    def of(w: list[str] | None, named: list[str] | None) -> list[str]:
        out = [""] * len(w or [])
        for phrase in named or []:
            for places in marked_places(w, phrase.split(" ")):
                out[places.start : places.stop] = [phrase] * len(places)
        return out

    return _by_slices(of, pa.list_(pa.string()), words, phrases)


def noun_phrase_labels(words: Column, tags: Column) -> Column:
    """Per word the noun phrase that it is part of, '' outside; later phrases go over earlier ones (see ``marked_places``)."""
    return _labels(words, noun_phrases(words, tags))


def align(a: list[str], b: list[str], gap: str = "[-]") -> tuple[list[str], list[str], list[int], list[int]]:
    """Global alignment at +1 for a match, -1 for a mismatch or gap; ties prefer the diagonal, then a gap in ``b``, then in ``a``.

    Gives both padded sequences and the places in a and b (-1 at gaps). A row of scores is a
    few operations on arrays. Of n rows one in sqrt(n) is kept; the way back makes the rows
    between two of them again, so memory grows with the length of b times sqrt(n).
    """
    n, m = len(a), len(b)
    codes: dict[str, int] = {}
    x, y = (np.fromiter((codes.setdefault(t, len(codes)) for t in s), dtype=np.int64, count=len(s)) for s in (a, b))
    step, at = math.isqrt(n) + 1, np.arange(m + 1)

    def after(row: np.ndarray, i: int) -> np.ndarray:
        """The scores of one token more of a: what comes from the left is a running maximum."""
        best = np.empty(m + 1, dtype=np.int64)
        best[0] = -i - 1
        np.maximum(row[:-1] + np.where(y == x[i], 1, -1), row[1:] - 1, out=best[1:])
        return np.maximum.accumulate(best + at) - at

    kept, row = [-at], -at
    for i in range(n):
        row = after(row, i)
        if (i + 1) % step == 0:
            kept.append(row)
    out: list[tuple[str, str, int, int]] = []
    i, j = n, m
    while i or j:
        first = max(i - 1, 0) // step * step
        rows = [kept[first // step]]
        while len(rows) <= i - first:
            rows.append(after(rows[-1], first + len(rows) - 1))
        while (i > first) or (first == 0 and j):
            here = rows[i - first][j]
            if i and j and here == rows[i - first - 1][j - 1] + (1 if x[i - 1] == y[j - 1] else -1):
                i, j = i - 1, j - 1
                out.append((a[i], b[j], i, j))
            elif i and here == rows[i - first - 1][j] - 1:
                i -= 1
                out.append((a[i], gap, i, -1))
            else:
                j -= 1
                out.append((gap, b[j], -1, j))
    p, q, r, s = zip(*out[::-1]) if out else ((), (), (), ())
    return list(p), list(q), list(r), list(s)


_ALIGNED = StructType([StructField("a", ArrayType(StringType())), StructField("b", ArrayType(StringType()))])


@F.pandas_udf(_ALIGNED)
def aligned(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Padded sequences of two token arrays."""
    made = [align(list(x), list(y))[:2] for x, y in zip(a, b)]
    return pd.DataFrame({"a": [m[0] for m in made], "b": [m[1] for m in made]})


def minimal_spans(df: DataFrame, words: str, mentions: str) -> DataFrame:
    """For each row the least span that holds one occurrence of every mention word, in any order; null without one."""
    schema = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, w, need in zip(*(batch.column(c).to_pylist() for c in ("row", "words", "need"))):
                places = sorted((i, x) for i, x in enumerate(w or []) if x in set(need or []))
                want, have, low, best = len(set(need or [])), {}, 0, None
                for i, x in places:  # a sliding window over occurrences, not their product
                    have[x] = have.get(x, 0) + 1
                    while len(have) == want and want:
                        start = places[low][0]
                        if best is None or i - start < best[1] - best[0]:
                            best = (start, i)
                        first = places[low][1]
                        have[first] -= 1
                        if not have[first]:
                            del have[first]
                        low += 1
                out.append((row, *(best or (None, None))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3, schema=schema)

    return df.select(F.col("row").cast("long"), F.col(words).alias("words"), F.col(mentions).alias("need")).mapInArrow(run, "row long, start long, end long")


def word_pieces(df: DataFrame, by: list[str], order: str, token: str, vector: str) -> DataFrame:
    """Pieces that continue a word ('##') joined to it: text in order, vectors averaged per element.

    The word's number is a running count of pieces that begin one.
    """
    w = Window.partitionBy(*by).orderBy(order)
    numbered = df.withColumn("_w", F.sum(F.when(F.startswith(token, F.lit("##")), 0).otherwise(1)).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, token))), lambda x: F.regexp_replace(x[token], "^##", "")), "")
    words = numbered.groupBy(*by, "_w").agg(text.alias("word"), F.collect_list(vector).alias("_v"))
    size = F.size(F.element_at("_v", 1))
    total = F.aggregate("_v", F.array_repeat(F.lit(0.0), size), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return words.select(*by, F.col("_w").alias("word_idx"), "word", F.transform(total, lambda x: x / F.size("_v")).alias("vector"))
