"""Tail probabilities of test statistics, for tables with a row for each test.

The regularised incomplete beta and gamma functions have no built-in form, so
these are Arrow functions over whole batches of tests.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or _TINY)
    total = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or _TINY)
            c = (1 + step / c) or _TINY
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def gamma_tail(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    total = d
    for i in range(1, 1000):
        b += 2
        d = 1 / ((b - i * (i - a) * d) or _TINY)
        c = (b - i * (i - a) / c) or _TINY
        total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def _each(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else f(*map(float, row)) for row in zip(*columns, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|) of Student's distribution; null or no freedom: null."""
    return _each(lambda v, n: beta_share(n / 2, 0.5, n / (n + v * v)) if n > 0 else None, t, df)


@F.pandas_udf(DoubleType())
def f_upper(f: pd.Series, one: pd.Series, two: pd.Series) -> pd.Series:
    """P(F >= f)."""
    return _each(lambda v, a, b: beta_share(b / 2, a / 2, b / (b + a * v)) if a > 0 and b > 0 else None, f, one, two)


@F.pandas_udf(DoubleType())
def chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(X >= x) of the chi-squared distribution."""
    return _each(lambda v, n: gamma_tail(n / 2, v / 2) if n > 0 else None, x, df)


@F.pandas_udf(DoubleType())
def z_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|) of the normal distribution."""
    return _each(lambda v: math.erfc(abs(v) / math.sqrt(2)), z)


#: Pairs up to which the distribution of signed ranks is worked out whole.
EXACT = 50


def signed_rank_p(n: Column, w: Column) -> Column:
    """Two-sided p of the smaller sum of signed ranks of n pairs without ties, from all 2**n signs; null beyond EXACT pairs.

    The number of subsets of the ranks 1 to n with each sum grows rank by rank;
    it is worked out in the row, a row being a test.
    """
    ranks = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))

    def with_rank(counts: Column, k: Column) -> Column:
        sums = F.sequence(F.lit(0), (k * (k + 1) / 2).cast("int"))
        return F.transform(sums, lambda s: F.coalesce(F.get(counts, s), F.lit(0.0)) + F.when(s >= k, F.get(counts, s - k)).otherwise(0.0))

    counts = F.aggregate(ranks, F.array(F.lit(1.0)), with_rank)
    below = F.aggregate(F.slice(counts, F.lit(1), F.floor(w).cast("int") + 1), F.lit(0.0), lambda a, x: a + x)
    return F.when(n <= EXACT, F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n)))
