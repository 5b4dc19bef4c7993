"""Exact small-sample distributions of rank statistics (L8, L9), by dynamic programs over rank sums.

Without ties every assignment of ranks is equally likely, so a p-value is a
share of assignments. Counts are whole numbers of any size; only the last
division rounds. One row per group comes here, never the samples.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LARGEST_PRODUCT = 20_000   # n_x * n_y of a table of U


@lru_cache(maxsize=256)
def signed_rank_upto(n: int) -> list[int]:
    """Of the 2**n sign patterns of the ranks 1..n: how many have a sum of positive ranks up to s, for each s."""
    ways = [1]
    for rank in range(1, n + 1):   # a rank is positive or not
        ways = [a + b for a, b in zip(ways + [0] * rank, [0] * rank + ways)]
    return list(accumulate(ways))


@lru_cache(maxsize=256)
def rank_sum_upto(m: int, n: int) -> list[int]:
    """Of the choices of m places among m + n: how many have a U of at most u, for each u."""
    # by number of x's placed so far; U counts the y's below each x
    ways = [[int(k == 0 and u == 0) for u in range(m * n + 1)] for k in range(m + 1)]
    for below in range(n + 1):   # x's that stand above just so many y's; any number of them may
        for k in range(1, m + 1):
            row, less = ways[k], ways[k - 1]
            for u in range(below, m * n + 1):
                row[u] += less[u - below]
    return list(accumulate(ways[m]))


def signed_rank_p(n: int, w: float) -> tuple[float, float]:
    """``(two-sided, greater)`` of a sum ``w`` of positive ranks."""
    upto, total, s = signed_rank_upto(n), 1 << n, int(w)
    low, high = upto[s], total - (upto[s - 1] if s else 0)
    return float(min(Fraction(1), Fraction(2 * min(low, high), total))), float(Fraction(high, total))


def rank_sum_p(m: int, n: int, u: float) -> float:
    """Chance of a U of ``u`` or more."""
    m, n = min(m, n), max(m, n)    # U is distributed alike for both orders
    upto, s = rank_sum_upto(m, n), int(u)
    return float(Fraction(upto[-1] - (upto[s - 1] if s else 0), upto[-1]))


@F.pandas_udf(T.StructType([T.StructField("two", T.DoubleType()), T.StructField("greater", T.DoubleType())]))
def signed_rank_test(n: pd.Series, w: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([signed_rank_p(int(a), b) for a, b in zip(n, w)], columns=["two", "greater"])


@F.pandas_udf(T.DoubleType())
def rank_sum_test(m: pd.Series, n: pd.Series, u: pd.Series) -> pd.Series:
    return pd.Series([rank_sum_p(int(a), int(b), c) for a, b, c in zip(m, n, u)], dtype=float)

