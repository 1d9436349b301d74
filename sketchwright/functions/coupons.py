"""How many distinct keys leave so many distinct coupons (row, number of leading zeros)."""

from __future__ import annotations

import math
from functools import lru_cache


def expected_coupons(lg_k: int, n: float) -> float:
    """Mean number of distinct coupons of n keys: column c of a row is hit with probability 2^-(c+1) / k by each."""
    k = 1 << lg_k
    total = 0.0
    for column in range(64):
        p = 2.0 ** -(column + 1) / k
        total += -k * math.expm1(n * math.log1p(-p))
    return total


@lru_cache(maxsize=65536)
def distinct_for(lg_k: int, coupons: int) -> float:
    """The n whose expected_coupons are as given, at least the coupons: the estimate that needs no order of arrival."""
    if coupons < 2:
        return float(coupons)
    low, high = float(coupons), 2.0 * coupons
    while expected_coupons(lg_k, high) < coupons:
        low, high = high, 4 * high
        if high > 1e300:
            return high
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if expected_coupons(lg_k, mid) < coupons else (low, mid)
    return max(float(coupons), (low + high) / 2)
