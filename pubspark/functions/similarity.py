"""Likeness of titles, summaries and names.

Only ``shared_run`` needs Python: its walk over two word lists depends on each
step before it. It runs in Arrow batches, on candidate pairs only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, same_name_part

# Marks that part words in titles and in names.
TITLE_MARKS = "-–_,.;:’'!?”“# "
NAME_MARKS = "-–_,.;:!?# "


def _near(a: str, b: str, most: int = 3) -> bool:
    """The words' edit distance is at most ``most``; rows are given up once all their cells are beyond it."""
    if abs(len(a) - len(b)) > most:
        return False
    if a == b or max(len(a), len(b)) <= most:
        return True
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return False
        row = new
    return row[-1] <= most


def _walk(a: list[str], b: list[str], join: Callable[[str, str], str], edge: int, drift: int, allowed: int) -> int:
    """Words of b that a follows after the first ones; a word may be written in two on either side."""
    i = j = n = missed = 0
    while i + 1 < len(a) and j + 1 < len(b):
        i, j = i + 1, j + 1
        if _near(a[i], b[j]):
            n += 1
        elif i < len(a) - edge and _near(join(a[i], a[i + 1]), b[j]):
            n, i = n + 1, i + 1
        elif j < len(b) - edge and _near(a[i], join(b[j], b[j + 1])):
            n, j = n + 2, j + 1
        elif missed > allowed:
            break
        else:
            missed, i = missed + 1, i + drift
    return n


def run_share(a: str | None, b: str | None, allowed: int = 0) -> float:
    """The share of the longer text's words in the run around a word that both have.

    The run starts at the middle one of the words that the shorter text has once
    and the longer one has too. Backwards a miss uses up one more word of the
    shorter text, forwards none. Null or wordless texts give 0.
    """
    marks = str.maketrans(dict.fromkeys(TITLE_MARKS, " "))
    x, y = (re.findall(r"\w+", (t or "").translate(marks).lower()) for t in (a, b))
    if len(x) > len(y):
        x, y = y, x
    counts, known = Counter(x), set(y)
    starts = [w for w in x if counts[w] == 1 and w in known]
    if not starts:
        return 0.0
    word = starts[len(starts) // 2]
    s, t = x.index(word), y.index(word)
    before = _walk(x[s::-1], y[t::-1], lambda p, q: q + p, 1, 1, allowed)
    after = _walk(x[s:], y[t:], lambda p, q: p + q, 2, -1, allowed)
    return (1 + before + after) / len(y)


def shared_run(a: Column, b: Column, allowed: int = 0) -> Column:
    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([run_share(p, q, allowed) for p, q in zip(x, y, strict=True)], dtype="float64")

    return score(a, b)


def letter_ratio(a: Column, b: Column, most: int = 1000) -> Column:
    """Twice the letters that both texts have, by count, over all letters, of the lower-cased first ``most``."""
    x, y = (F.lower(F.left(c, F.lit(most))) for c in (a, b))
    times = lambda t, ch: F.length(t) - F.length(F.replace(t, ch))
    letters = F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))
    both = F.aggregate(letters, F.lit(0), lambda n, ch: n + F.least(times(x, ch), times(y, ch)))
    return F.when(F.length(x) + F.length(y) == 0, 1.0).otherwise(2.0 * both / (F.length(x) + F.length(y)))


def same_text(a: Column, b: Column, ratio: float) -> Column:
    """Both empty, or neither and alike by their letters."""
    none = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return F.when(none(a) & none(b), True).when(none(a) | none(b), False).otherwise(letter_ratio(a, b) >= ratio)


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1))


def name_words(c: Column) -> Column:
    """A name's words without marks and accents, lower-cased; capitals in a row are initials."""
    parted = F.regexp_replace(F.translate(c, NAME_MARKS, " " * len(NAME_MARKS)), "(?<=\\p{Lu})(?=\\p{Lu})", " ")
    return _words(fold(F.lower(parted)))


def _covered(a: Column, b: Column, fits: Callable[[Column, Column], Column]) -> Column:
    """Each word of the shorter list fits one of the longer list."""
    short, long = F.when(F.size(a) > F.size(b), b).otherwise(a), F.when(F.size(a) > F.size(b), a).otherwise(b)
    return F.forall(short, lambda x: F.exists(long, lambda y: fits(x, y)))


def same_name(a: Column, b: Column) -> Column:
    return _covered(name_words(a), name_words(b), same_name_part)


def same_affiliation(a: Column, b: Column) -> Column:
    """Words within two letters of each other; a name without words is like none."""
    x, y = (_words(F.lower(F.translate(c, NAME_MARKS, " " * len(NAME_MARKS)))) for c in (a, b))
    return (F.size(x) > 0) & (F.size(y) > 0) & _covered(x, y, lambda p, q: F.levenshtein(p, q) < 3)
