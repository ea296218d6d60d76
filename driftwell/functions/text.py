"""Text functions beyond the built-ins: common substrings, compressed lengths, dictionary runs."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def longest_common_substring(a: str, b: str) -> str:
    best, end, row = 0, 0, [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        above, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                row[j] = above[j - 1] + 1
                if row[j] > best:
                    best, end = row[j], i
    return a[end - best : end]


def longest_common_subsequence(a: str, b: str) -> str:
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return "".join(out)


def compression_similarity(a: str, b: str) -> float:
    """1 when the strings together compress no better than apart add up, towards 1 the more they share: 2 - C(ab)*2/(C(a)+C(b)), clipped."""
    size = lambda s: len(zlib.compress(s.encode("utf-8")))
    x, y, both = size(a), size(b), size(a + b)
    return max(0.0, min(1.0, 2 - 2 * both / (x + y))) if a or b else 1.0


def two(f, kind: str):
    """A column function of two text columns from a Python function; null if either is null."""

    def column(a: Column, b: Column) -> Column:
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([None if p is None or q is None else f(p, q) for p, q in zip(x, y)])

        return F.pandas_udf(run, kind)(a, b)

    return column


common_substring = two(longest_common_substring, "string")
common_subsequence = two(longest_common_subsequence, "string")
similarity_by_compression = two(compression_similarity, "double")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def stripped_similarity(a: Column, b: Column) -> Column:
    """As levenshtein_similarity, digits and punctuation left out."""
    strip = lambda c: F.regexp_replace(c, r"[^\p{L}\s]", "")
    return levenshtein_similarity(strip(a), strip(b))


def dictionary_run(text: Column, words: frozenset[str]) -> Column:
    """The longest run of dictionary words in a row, space-joined; the words go with the task."""

    def run(s: pd.Series) -> pd.Series:
        def best(t):
            top, now = [], []
            for w in (t or "").split():
                now = [*now, w] if w.strip(".,;:!?\"'()").lower() in words else []
                top = now if len(now) > len(top) else top
            return " ".join(top)

        return s.map(best)

    return F.pandas_udf(run, "string")(text)
