"""Confidence bounds of the estimates, as scalar functions and as Column expressions for one row a group."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SketchArgumentError

#: One-sided tail probabilities of 1, 2 and 3 standard deviations.
TAILS = {k: 0.5 * math.erfc(k / math.sqrt(2)) for k in (1, 2, 3)}
#: Up to so many retained keys the binomial is searched instead of approximated.
SMALL = 120


def check_deviations(k: int) -> int:
    if k not in TAILS:
        raise SketchArgumentError("bounds are given for 1, 2 or 3 standard deviations", num_std_dev=k)
    return k


def _log_pmf(n: int, x: int, p: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p)


def _at_most(n: int, x: int, p: float) -> float:
    """P(Binomial(n, p) <= x)."""
    if x >= n:
        return 1.0
    return math.fsum(math.exp(_log_pmf(n, i, p)) for i in range(x + 1))


def _normal(n: float, theta: float, k: int, sign: int) -> float:
    centre = (n + sign * 0.5) / theta
    b = k * math.sqrt((1 - theta) / theta)
    return centre + b * b / 2 + sign * b / 2 * math.sqrt(b * b + 4 * centre)


@lru_cache(maxsize=65536)
def sampled_lower(n: int, theta: float, k: int) -> float:
    """Lower bound on the number of distinct keys if n were kept, each with probability theta."""
    check_deviations(k)
    if n == 0 or theta >= 1.0:
        return float(n)
    if n == 1:
        found = math.log1p(-TAILS[k]) / math.log1p(-theta)
    elif n > SMALL:
        found = _normal(n, theta, k, -1)
    elif theta > 1 - 1e-5:
        found = float(n)
    else:
        low, high = n, max(n + 1, math.ceil(n / theta) + 1)
        while high - low > 1:  # the largest count under which n or more would still be too unlikely
            mid = (low + high) // 2
            low, high = (mid, high) if 1 - _at_most(mid, n - 1, theta) <= TAILS[k] else (low, mid)
        found = float(low)
    return min(max(found, float(n)), n / theta)


@lru_cache(maxsize=65536)
def sampled_upper(n: int, theta: float, k: int) -> float:
    """The upper bound for the same."""
    check_deviations(k)
    if theta >= 1.0:
        return float(n)
    if n == 0:
        return float(math.ceil(math.log(TAILS[k]) / math.log1p(-theta)))
    if n > SMALL:
        found = _normal(n, theta, k, 1)
    elif theta > 1 - 1e-5:
        found = n + 1.0
    else:
        low = max(n, math.floor(n / theta))
        high = 2 * low + 16
        while _at_most(high, n, theta) > TAILS[k]:
            high *= 2
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if _at_most(mid, n, theta) <= TAILS[k] else (mid, high)
        found = float(high)
    return max(found, n / theta)


def sampled_bounds(n: Column, theta: Column, k: int, empty: Column | None = None) -> Column:
    """struct<lower, upper> for one row a group: the searches of small samples run in Arrow batches."""
    check_deviations(k)

    @F.pandas_udf("lower double, upper double")
    def run(ns: pd.Series, thetas: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"lower": [sampled_lower(int(a), float(t), k) for a, t in zip(ns, thetas)], "upper": [sampled_upper(int(a), float(t), k) for a, t in zip(ns, thetas)]})

    found = run(n.cast("long"), theta)
    if empty is None:
        return found
    return F.when(empty, F.struct(F.lit(0.0).alias("lower"), F.lit(0.0).alias("upper"))).otherwise(found)


def ratio_bounds(inside: int, whole: int, share: float) -> tuple[float, float, float]:
    """Two-deviation bounds and estimate of a proportion seen as inside of whole in a sample of the given sampling share.

    The tails of the binomial by the normal approximation to the incomplete beta function
    (Abramowitz and Stegun 26.5.22), with the deviation shrunk for a sample that is a large part of all.
    """
    if whole == 0:
        return 0.0, 0.5, 1.0
    adjusted = 2.0 * math.sqrt(1.0 - share) if share < 1 else 0.0

    def invert(a: float, b: float, y: float) -> float:
        lam = (y * y - 3) / 6
        h = 2 / (1 / (2 * a - 1) + 1 / (2 * b - 1))
        w = y * math.sqrt(h + lam) / h - (1 / (2 * b - 1) - 1 / (2 * a - 1)) * (lam + 5 / 6 - 2 / (3 * h))
        return a / (a + b * math.exp(2 * w))

    def lower(k: int, n: int) -> float:
        if n == 0 or k == 0:
            return 0.0
        if k == n:
            return math.exp(math.log(0.5 * math.erfc(adjusted / math.sqrt(2))) / n)
        if k == 1:
            return 1 - (1 - 0.5 * math.erfc(adjusted / math.sqrt(2))) ** (1 / n)
        return 1 - invert(n - k + 1, k, -adjusted)

    if adjusted == 0:
        return inside / whole, inside / whole, inside / whole
    return min(lower(inside, whole), inside / whole), inside / whole, max(1 - lower(whole - inside, whole), inside / whole)
