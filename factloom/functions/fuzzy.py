"""Similarity of word sets, 0 to 100, for pairs of distinct strings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; the rows of the table are the bits of one number."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_similarity(a: str, b: str) -> float:
    """200 * common subsequence / both lengths; 100 for two empty strings."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * common_subsequence(a, b) / total


def word_set_similarity(a: str, b: str) -> float:
    """100 if one side's words are all on the other; else the best of comparing common words, and common words with each rest."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both = left & right
    only_left, only_right = left - right, right - left
    if both and not (only_left and only_right):
        return 100.0
    rest_left, rest_right = " ".join(sorted(only_left)), " ".join(sorted(only_right))
    shared = len(" ".join(sorted(both)))
    gap = bool(shared)
    whole_left, whole_right = shared + gap + len(rest_left), shared + gap + len(rest_right)
    same = shared + gap + common_subsequence(rest_left, rest_right)
    best = 200.0 * same / (whole_left + whole_right)
    if shared:
        best = max(best, 200.0 * shared / (shared + whole_left), 200.0 * shared / (shared + whole_right))
    return best


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([word_set_similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")
