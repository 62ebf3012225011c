"""Similarities of word lists, strings and vectors. difflib and LCS ratios are Arrow UDFs: no built-in matches them."""

from __future__ import annotations

import difflib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all different elements; 0 if both lists are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def overlap_coefficient(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def edit_similar(a: Column, b: Column, share: float = 0.3) -> Column:
    """Edit distance of at most ``share`` of the longer word, or one word begins with the other."""
    longer = F.greatest(F.length(a), F.length(b))
    return (F.levenshtein(a, b) <= longer * share) | a.startswith(b) | b.startswith(a)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio with its own heuristics for long strings; what it knows of ``b`` is kept while rows repeat it."""
    matcher, now, out = difflib.SequenceMatcher(None, "", ""), None, []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if y != now:
            matcher.set_seq2(y)
            now = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def _common(a: str, b: str, i: int, j: int, step: int) -> int:
    """How many characters agree from a[i] and b[j] on, in steps of 1 or -1."""
    n = 0
    while 0 <= i < len(a) and 0 <= j < len(b) and a[i] == b[j]:
        i, j, n = i + step, j + step, n + 1
    return n


def rare_places(b: str) -> list[int] | None:
    """Places of characters that difflib lets a match begin at; null where it takes all (strings under 200)."""
    if len(b) < 200:
        return None
    counts, most = Counter(b), len(b) // 100 + 1
    return [j for j, ch in enumerate(b) if counts[ch] <= most]


def most_matched(a: str, b: str, rare: list[int]) -> int:
    """A bound on the characters difflib can match, where common characters of ``b`` begin no match.

    Every matched block then holds a rare character of b, or is the common beginning of both
    strings; blocks don't overlap in b, and none is longer than the longest agreement around
    one of its rare characters.
    """
    at: dict[str, list[int]] = {}
    for i, ch in enumerate(a):
        at.setdefault(ch, []).append(i)
    total = _common(a, b, 0, 0, 1)
    for j in rare:
        total += max((_common(a, b, i, j, 1) + _common(a, b, i - 1, j - 1, -1) for i in at.get(b[j], ())), default=0)
    return total


def sequence_ratio_above(a: Column, b: Column, least: float) -> Column:
    """difflib's ratio; null where a bound shows that it is ``least`` at most, which saves the matching."""

    @F.pandas_udf(DoubleType())
    def kernel(a: pd.Series, b: pd.Series) -> pd.Series:
        matcher, now, rare, known, out = difflib.SequenceMatcher(None, "", ""), None, None, True, []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            if y != now:
                now, rare, known = y, rare_places(y), False
            if rare is not None and 2.0 * most_matched(x, y, rare) <= least * (len(x) + len(y)):
                out.append(None)
                continue
            if not known:
                matcher.set_seq2(y)
                known = True
            matcher.set_seq1(x)
            out.append(matcher.ratio())
        return pd.Series(out, dtype="float64")

    return kernel(a, b)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one row at a time in numpy."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    codes = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    row = np.zeros(len(codes) + 1, np.int32)
    for ch in a:
        match = np.where(codes == ord(ch), row[:-1] + 1, 0)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], match))
    return int(row[-1])


@F.pandas_udf(DoubleType())
def lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence over both lengths; 0 for two empty strings."""
    return pd.Series([None if x is None or y is None else (2.0 * lcs_length(x, y) / (len(x) + len(y)) if x or y else 0.0) for x, y in zip(a, b, strict=True)])
