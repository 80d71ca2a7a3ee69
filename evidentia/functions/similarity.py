"""Token-set and token-sort ratios by Indel distance, in [0, 1].

The ratios need a longest common subsequence, for which Spark has no function; it is found bit-parallel, one big-integer step per
character, in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: one bit vector over a, updated once for each character of b."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _ratio(distance: int, length: int) -> float:
    return 1.0 - distance / length if length else 1.0


def token_set_ratio(a: str | None, b: str | None) -> float:
    """1 if the tokens of one are all in the other; else the best of what is shared against either and of both remainders. 0 if either is blank."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both, ab, ba = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not ab or not ba):
        return 1.0
    shared = len(" ".join(both))
    gap = shared != 0
    la, lb = shared + gap + len(ab), shared + gap + len(ba)
    best = _ratio(len(ab) + len(ba) - 2 * lcs(ab, ba), la + lb)
    if not shared:
        return best
    return max(best, _ratio(gap + len(ab), shared + la), _ratio(gap + len(ba), shared + lb))


def token_sort_ratio(a: str | None, b: str | None) -> float:
    x, y = " ".join(sorted((a or "").split())), " ".join(sorted((b or "").split()))
    return _ratio(len(x) + len(y) - 2 * lcs(x, y), len(x) + len(y))


def _by_pair(ratio, a: Column, b: Column) -> Column:
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple, float] = {}
        for pair in zip(a, b, strict=True):
            if pair not in seen:
                seen[pair] = ratio(*pair)
        return pd.Series([seen[pair] for pair in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(of, DoubleType())(a, b)


def token_set(a: Column, b: Column) -> Column:
    return _by_pair(token_set_ratio, a, b)


def token_sort(a: Column, b: Column) -> Column:
    return _by_pair(token_sort_ratio, a, b)
