"""String functions as Column expressions, and the few that need Python as Arrow functions."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Words stripped from the beginning of an argument, one pass in this order (fixed values).
ARTICLES = ("the", "a", "our", "this", "and", "these")
#: Punctuation that separates nothing when keys are compared (fixed values).
KEY_PUNCTUATION = "[.,!?$]"
#: Characters that count as dashes (fixed values).
DASHES = "‐᠆﹣－⁃−"
#: ASCII punctuation as a regular-expression class.
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def clean_entity(c: Column) -> Column:
    """Runs of dashes as one '-', runs of white space as one space, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, f"[{DASHES}]+", "-"), "[ \\t\\n\\r]+", " "))


def clean_topic(c: Column) -> Column:
    """Without digits, ASCII punctuation and 'et al'; white space collapsed and trimmed; lower case."""
    c = F.regexp_replace(F.lower(c), "[0-9]", "")
    c = F.regexp_replace(c, ASCII_PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "et al", ""), "[ \\t\\n\\r]+", " "))


def duplicate_key(c: Column) -> Column:
    """The key under which names count as equal: lower case, punctuation as spaces, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), KEY_PUNCTUATION, " "), " +", " "))


def strip(c: Column) -> Column:
    """Without white space at either end, tabs and newlines included."""
    return F.regexp_replace(c, "^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$", "")


def country(address: Column) -> Column:
    """The last non-blank part of a comma-separated address; blank if only digits."""
    parts = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return F.when(last.rlike("^[0-9]+$"), "").when(last == "Russian Federation", "Russia").otherwise(last)


def clean_parts(c: Column) -> Column:
    """Lower-case parts between punctuation and white space, without empty ones."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def word_tokens(c: Column) -> Column:
    """Words with apostrophes; punctuation is dropped."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_']+)"), 1)


def initials(c: Column) -> Column:
    """First letters of the alphabetic parts, lower case."""
    return F.transform(F.filter(F.split(c, r"[^\p{L}]+"), lambda x: x != ""), lambda x: F.lower(F.substring(x, 1, 1)))


def char_ngrams(c: Column, n: int = 1) -> Column:
    """Character n-grams after ``, - . /`` are taken out; spaces are kept."""
    s = F.regexp_replace(c, "[,-./]", "")
    return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))), lambda i: F.substr(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def strip_articles(c: Column) -> Column:
    """Lower case without leading articles: each is tried once, in order."""
    c = F.lower(c)
    for word in ARTICLES:
        c = F.regexp_replace(c, f"^{word} ", "")
    return c


def label(c: Column, width: int = 30) -> Column:
    """A display label: ':' as ' - ', null as blank, long ones cut with '..'."""
    c = F.replace(F.coalesce(c, F.lit("")), F.lit(":"), F.lit(" - "))
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit(".."))).otherwise(c)


def tag_type(tag: Column) -> Column:
    """A span tag without its B-, I-, L- or U- prefix."""
    return F.regexp_replace(tag, "^[BILU]-", "")


def parent_id(sentence_id: Column) -> Column:
    """What stands before the last underscore."""
    return F.regexp_replace(sentence_id, "_[^_]*$", "")


def highlight(c: Column, keywords: list[str], style: str = "color:red", ignore_case: bool = True) -> Column:
    """Every occurrence of each keyword in turn, wrapped in a styled span."""
    for word in keywords:
        c = F.regexp_replace(c, ("(?i)" if ignore_case else "") + f"({re.escape(word)})", f'<span style="{style}">$1</span>')
    return c


def inverse(c: Column, word: str) -> Column:
    """A word in inverse video."""
    return F.replace(c, F.lit(word), F.lit(f"\x1b[7m{word}\x1b[0m"))


def join_pieces(tokens: Column) -> Column:
    """Word pieces joined: '##' marks a continuation."""
    return F.replace(F.array_join(tokens, " "), F.lit(" ##"), F.lit(""))


def without_markers(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("[BOS]"), F.lit("")), F.lit("[EOS]"), F.lit(""))


def role_spans(c: Column) -> Column:
    """(role, words) of a bracketed description ``[ROLE: words]``."""
    found = F.regexp_extract_all(c, F.lit(r"\[([^:\]]+: [^\]]*)\]"), 1)
    return F.transform(found, lambda x: F.struct(F.substring_index(x, ": ", 1).alias("role"), F.regexp_replace(x, "^[^:]+: ", "").alias("words")))


def file_stem(path: Column) -> Column:
    """A file's name without folders and extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


# --- similarity of two strings (need loops over both, so Arrow functions) ---


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """2 x common subsequence over both lengths: an edit ratio in which a substitution counts as two edits."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def parts_ratio(a: str, b: str, most: int = 4) -> float:
    """Mean ratio of the best assignment of the shorter name's parts; 0 beyond ``most`` parts."""
    x, y = (re.findall(r"[\w']+", s) for s in (a, b))
    if len(x) > len(y):
        x, y = y, x
    if not x or len(y) > most:
        return 0.0
    score = [[ratio(p, q) for q in y] for p in x]
    return max(sum(score[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(len(y)), len(x))) / len(x)


def initials_score(a: list[str], b: list[str]) -> float:
    """Overlap of initials, at most 0: common ones less missing ones, over the shorter list, with credit for order."""
    if not len(a) or not len(b):
        return -1.0
    x, y = Counter(a), Counter(b)
    union = x | y
    common = sum((x & y).values())
    miss = min(sum((union - x).values()), sum((union - y).values()))
    s = (common - miss) / min(len(a), len(b)) - 1
    if list(a) == list(b):
        s += 1
    elif [c for c in a if c in y] == [c for c in b if c in x]:
        s += 0.5
    return s - 1


@F.pandas_udf(DoubleType())
def edit_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def parts_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else parts_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def initials_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else initials_score(list(x), list(y)) for x, y in zip(a, b)], dtype="float64")
