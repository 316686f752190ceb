"""Queries without SQL against plain versions over whole small tables, beyond ids and lengths where a cut would show."""

import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from loomgraph.operators import nlp
from loomgraph.plans import QUERIES

MARKS = {"view": "O", "click": "B", "purchase": "I", "signup": "L", "error": "U"}


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A folder with events on both sides of id 5000, a user with late ones only, and each user's words in order."""
    rnd = random.Random(4)
    rows = [(4900 + 37 * i, datetime(2024, 1, 1) + timedelta(seconds=rnd.randrange(200)), 9 if i >= 380 else rnd.randrange(4), rnd.choice([*MARKS]), float(i % 30)) for i in range(400)]
    path = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")
    users = defaultdict(list)
    for i, ts, u, w, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        users[u].append((i, w))
    return path, users


def merged(words):
    """Words and places under runs of tags, with lists of places worked out step by step."""
    runs, run = [], []
    kind = lambda i: "O" if words[i][1] == "view" else "LOC" if words[i][0] % 3 == 0 else "PER"
    for i, (_, w) in enumerate(words):
        mark = MARKS[w]
        same = run != [] and kind(run[0]) == kind(i)
        if mark == "B":
            runs += [run] if run else []
            run = [i]
        elif mark == "I" and same:
            run = [*run, i]
        elif mark == "L" and same:
            runs.append([*run, i])
            run = []
        elif mark == "L" and len(run) == 1:
            runs.append([i])
        elif mark != "I":
            runs += [run, [i]] if run else [[i]]
            run = []
    out, at = [], 0
    for run in runs:
        text = " ".join(words[i][1] for i in run)
        out.append((text, kind(run[-1]), at, at + len(text) - 1))
        at += len(text) + 1
    return out


def tripled(words):
    out, s, v, o = [], None, None, None
    for i, w in words:
        s, v, o = w if w == "view" else s, w if w == "click" and i % 2 == 0 else v, w if w in ("signup", "purchase") else o
        if s and v and o:
            out.append((s, v, o))
            s = v = o = None
    return out


def tenses(words):
    out, will, to = Counter(), False, False
    for _, w in words:
        tense = "past" if w == "error" else "None"
        if w in ("click", "purchase"):
            if will:
                tense, will = "future", False
            elif to:
                tense, to = "future", False
        will, to = will or w == "view", to or w == "purchase"
        out[tense] += 1
    return [*out.items()]


def coded(words):
    return "".join({"view": "D", "click": "J", "purchase": "CN"[i % 2], "error": "x" if i % 5 == 0 else "H"}.get(w, "N") for i, w in words)


def phrases(words):
    return [(" ".join(w for _, w in words[m.start() : m.end()]),) for m in re.finditer("D?J*C*J*N+(HN+)*", coded(words))]


def labelled(words):
    """Labels by the words that each phrase has in the text: one scan a phrase, a find noted one word late."""
    plain = [w for _, w in words]
    labels = [""] * len(plain)
    for (p,) in phrases(words):
        want, k, i = p.split(" "), 0, 0
        while i < len(plain):
            if k == len(want):
                labels[i - k : i] = [p] * k
                if i == len(plain) - 1:
                    break
                k = 0
            k = k + 1 if plain[i] == want[k] else 0
            i += 1
    return [*enumerate(labels)]


@pytest.mark.parametrize("name, plain", [("win13_nlp05_merge_tags", merged), ("win15_nlp10_triples", tripled), ("win14_nlp08_tense", tenses), ("nlp09_noun_phrases", phrases), ("nlp09_phrase_labels", labelled)])
def test_all_events(spark, events, name, plain):
    path, users = events
    got = QUERIES[name](spark, path)
    got = Counter(tuple(r) for r in got.drop("confidence").collect())
    assert got == Counter((u, *x) for u, words in users.items() for x in plain(words)) and got


def test_alignment_of_whole_texts(spark, tmp_path):
    rnd = random.Random(6)
    texts = {i: [rnd.choice(["a", "of", "graph", "edge", "node"]) for _ in range(n)] for i, n in enumerate((0, 1, 39, 41, 300))}
    spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: (r.a, r.b) for r in QUERIES["nlp14_nlp15_alignment"](spark, str(tmp_path)).collect()}
    assert got == {i: tuple(" ".join(x) for x in nlp.align(w or [""], [x for x in w if len(x) > 2])[:2]) for i, w in texts.items()}
    assert [x for x in got[4][0].split(" ") if x != "[-]"] == texts[4]
