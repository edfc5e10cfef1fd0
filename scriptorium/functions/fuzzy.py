"""Fuzzy similarities from 0 to 100, as Arrow-batched functions.

ratio: 100 * (1 - indel distance / total length), by the longest common subsequence, computed with
bit-parallel integers. token_sort_ratio: of the sorted words. token_set_ratio: the best of the common
words against each side's words, and of the two sides; 100 if one side's words hold the other's.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and not (left and right):
        return 100.0
    common, one, two = " ".join(both), " ".join(left), " ".join(right)
    size = len(common)
    with_one, with_two = size + bool(size) + len(one), size + bool(size) + len(two)
    distance = len(one) + len(two) - 2 * lcs(one, two)
    best = 100.0 * (1 - distance / (with_one + with_two)) if with_one + with_two else 100.0
    if size:
        for n, rest in ((with_one, one), (with_two, two)):
            best = max(best, 100.0 * (1 - (1 + len(rest)) / (size + n)))
    return best


def norm(x: str | None) -> str:
    """Accents off, white space as one space, lower case."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", x or "") if not unicodedata.combining(c))
    return " ".join(plain.split()).lower()


def _column(f, clean):
    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple, float | None] = {}
        out = []
        for pair in zip(a, b):
            if pair not in seen:
                seen[pair] = None if pair[0] is None or pair[1] is None else f(clean(pair[0]), clean(pair[1]))
            out.append(seen[pair])
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(batch, "double")


def similarity(kind: str, a: Column, b: Column, normalised: bool = False) -> Column:
    """kind: ratio, token_sort or token_set; null if either side is."""
    f = {"ratio": ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio}[kind]
    return _column(f, norm if normalised else str)(a, b)
