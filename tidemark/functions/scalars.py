"""Scalar column expressions: weights, sizes, tests' helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.col(c)
    return F.lit(c)


def kernel_weight(dist, b: float = 1.0, e: float = 1.0) -> Column:
    """H5: 1 / (b + d^e)."""
    return F.lit(1.0) / (F.lit(float(b)) + F.pow(_c(dist), F.lit(float(e))))


def dependence_weight(y_i, y_j, y_j_pred, alpha: float = 0.5, b_factor: float = 1.0) -> Column:
    """H6: weight of sample i towards prototype j by label relations.

    same given label -> -1; different and the prototype's vote agrees with
    its own label -> 1 - alpha; vote disagrees with both -> alpha; vote
    equals the sample's label -> alpha * b_factor.
    """
    yi, yj, yp = _c(y_i), _c(y_j), _c(y_j_pred)
    return (F.when(yi == yj, F.lit(-1.0))
            .when(yj == yp, F.lit(1.0 - alpha))
            .when(yi != yp, F.lit(float(alpha)))
            .otherwise(F.lit(alpha * b_factor)))


def sample_size(n, frac: float | None = None, n_errors: int | None = None) -> Column:
    """H7: ceil(frac * n), or the fixed count when given."""
    if n_errors is not None:
        return F.lit(int(n_errors)).cast("bigint")
    return F.ceil(_c(n) * F.lit(float(frac))).cast("bigint")


def chained_fraction(frac) -> Column:
    """H8: per-stage fraction so three chained stages add ``frac`` overall."""
    return F.pow(F.lit(1.0) + _c(frac), F.lit(1.0 / 3.0)) - F.lit(1.0)


def chained_fraction_py(frac: float) -> float:
    return (1.0 + frac) ** (1.0 / 3.0) - 1.0


def n_clean(p_plus: float = 0.05, p_chance: float = 0.05) -> int:
    """Clean items in a row needed to stop, floor(ln p_chance / ln(1 - p_plus))."""
    return int(math.log(p_chance) / math.log(1.0 - p_plus))


def pvalue_stars(p) -> Column:
    """Significance stars."""
    p = _c(p)
    return (F.when(p < 0.001, F.lit("***")).when(p < 0.01, F.lit("**"))
            .when(p < 0.05, F.lit("*")).otherwise(F.lit("n.s.")))


def logit(p, eps: float = 1e-9) -> Column:
    """ln(p / (1 - p)) with p clipped to [eps, 1 - eps]."""
    q = F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1.0 - eps))
    return F.log(q / (F.lit(1.0) - q))


def logistic(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


# Abramowitz & Stegun 7.1.26 coefficients for erf(x), x >= 0.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x) -> Column:
    """erf by A&S 7.1.26 (absolute error < 1.5e-7); odd extension for x < 0."""
    x = _c(x)
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * ax)
    a1, a2, a3, a4, a5 = ERF_A
    poly = t * (F.lit(a1) + t * (F.lit(a2) + t * (F.lit(a3) + t * (F.lit(a4) + t * F.lit(a5)))))
    y = F.lit(1.0) - poly * F.exp(-ax * ax)
    return F.signum(x) * y


def normal_cdf(z) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(_c(z) / F.lit(math.sqrt(2.0))))


def _triangle(m: Column) -> Column:
    """Number of pairs among m + 1 items: 1 + 2 + ... + m."""
    half = F.call_function("div", m + m % F.lit(2), F.lit(2))
    return half * (m + F.lit(1) - m % F.lit(2))


def pair_to_index(i, j, n) -> Column:
    """H9 forward: position of pair (i, j), i < j, in the lexicographic list of pairs of n items.

    Counted from the list's end: behind the pair lie the ``n - 1 - j`` later
    pairs of its own row and the triangle of pairs among the items after i.
    """
    i, j, n = _c(i).cast("bigint"), _c(j).cast("bigint"), _c(n).cast("bigint")
    last = _triangle(n - F.lit(1)) - F.lit(1)
    return (last - _triangle(n - F.lit(2) - i) - (n - F.lit(1) - j)).cast("bigint")


def pair_from_index(k, n) -> tuple[Column, Column]:
    """H9 inverse: the pair (i, j) at position k among the pairs of n items.

    With r pairs behind it, the pair's row has the largest triangle that
    doesn't exceed r behind itself. The root on doubles is corrected by one
    step of exact integers; no product exceeds n * n.
    """
    k, n = _c(k).cast("bigint"), _c(n).cast("bigint")
    r = _triangle(n - F.lit(1)) - F.lit(1) - k
    guess = F.floor((F.sqrt(F.lit(8.0) * r.cast("double") + F.lit(1.0)) - F.lit(1.0)) / F.lit(2.0)).cast("bigint")
    t = (F.when(_triangle(guess) > r, guess - 1)
         .when(_triangle(guess + 1) <= r, guess + 1).otherwise(guess))
    return (n - F.lit(2) - t).cast("bigint"), (n - F.lit(1) - (r - _triangle(t))).cast("bigint")
