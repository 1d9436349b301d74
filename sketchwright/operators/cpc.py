"""Distinct counting by coupons: which (row, leading zeros) pairs were seen.

State: `by` columns, row INT, bits BIGINT (bit c: column c was seen), lg_k INT. Merging is OR; the
estimate needs only the number of coupons. Estimates that use the order of the keys (HIP) are in
ordered_estimate().
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SketchArgumentError
from ..functions.bounds import check_deviations
from ..functions.coupons import distinct_for
from ..functions.hashing import DEFAULT_SEED, leading_zeros, seed_hash, with_counted_hash
from ..functions.relative_errors import cpc_error
from .theta import _joined

MIN_LG_K, MAX_LG_K, DEFAULT_LG_K = 4, 26, 11

# Largest stored size, in bytes over the 40 of the preamble, for lg_k 4 to 19; beyond, 0.6 k.
SIZES = (24, 36, 56, 100, 180, 344, 660, 1292, 2540, 5020, 9968, 19836, 39532, 78880, 157516, 314656)


def check_lg_k(lg_k: int) -> int:
    if not MIN_LG_K <= lg_k <= MAX_LG_K:
        raise SketchArgumentError(f"lg_k must be from {MIN_LG_K} to {MAX_LG_K}", lg_k=lg_k)
    return lg_k


def max_serialized_bytes(lg_k: int) -> int:
    check_lg_k(lg_k)
    return 40 + (SIZES[lg_k - 4] if lg_k <= 19 else int(0.6 * (1 << lg_k)))


def coupons(df: DataFrame, key: str, by: Sequence[str] = (), lg_k: int = DEFAULT_LG_K, seed: int = DEFAULT_SEED, carried: Sequence[str] = ()) -> DataFrame:
    """by, carried, row, col of each key that counts."""
    check_lg_k(lg_k)
    seed_hash(seed)
    rows = with_counted_hash(df.select(*by, *carried, F.col(key).alias("__key")), "__key", "__h1", "__h2", seed)
    row = F.col("__h1").bitwiseAND((1 << lg_k) - 1).cast("int")
    col = F.least(leading_zeros(F.col("__h2")), F.lit(63)).cast("int")
    if lg_k == 26:  # the pair that would be all ones is moved
        row = F.when((row == (1 << 26) - 1) & (col == 63), row.bitwiseXOR(1)).otherwise(row)
    return rows.select(*by, *carried, row.alias("row"), col.alias("col"))


def build(df: DataFrame, key: str, by: Sequence[str] = (), lg_k: int = DEFAULT_LG_K, seed: int = DEFAULT_SEED) -> DataFrame:
    rows = coupons(df, key, by, lg_k, seed)
    return rows.groupBy(*by, "row").agg(F.bit_or(F.expr("shiftleft(1L, col)")).alias("bits")).withColumn("lg_k", F.lit(lg_k))


def union(*states: DataFrame, by: Sequence[str] = (), lg_max_k: int = MAX_LG_K) -> DataFrame:
    """Merges states; a group gets the least lg_k of its inputs and lg_max_k, rows fold, columns stay."""
    check_lg_k(lg_max_k)
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    least = rows.groupBy(*by).agg(F.least(F.min("lg_k"), F.lit(lg_max_k)).alias("__lg"))
    rows = _joined(rows, least, by)
    row = F.col("row").bitwiseAND(F.pow(F.lit(2), F.col("__lg")).cast("int") - 1)
    return rows.groupBy(*by, row.alias("row")).agg(F.bit_or("bits").alias("bits"), F.min("__lg").alias("lg_k"))


def reduce_k(state: DataFrame, lg_k: int, by: Sequence[str] = ()) -> DataFrame:
    return union(state, by=by, lg_max_k=lg_k)


def num_coupons(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row a group: lg_k, num_coupons, is_empty."""
    rows = state.groupBy(*by).agg(F.min("lg_k").alias("lg_k"), F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("num_coupons"))
    return rows.withColumn("is_empty", F.col("num_coupons") == 0)


def bounds(state: DataFrame, num_std_dev: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """lower, estimate and upper: the number of keys whose expected coupons are those seen, and its errors."""
    check_deviations(num_std_dev)

    @F.pandas_udf("lower double, estimate double, upper double")
    def run(lg: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([coupon_bounds(0 if pd.isna(k) else int(k), int(c), num_std_dev) for k, c in zip(lg, n)], columns=["lower", "estimate", "upper"])

    rows = num_coupons(state, by).withColumn("__b", run("lg_k", "num_coupons"))
    return rows.select(*by, F.col("__b.lower").alias("lower"), F.col("__b.estimate").alias("estimate"), F.col("__b.upper").alias("upper"))


def coupon_bounds(lg_k: int, coupons: int, deviations: int, hip: float | None = None) -> tuple[float, float, float]:
    """lower, estimate, upper; hip: the estimate of a summary that saw all its keys in order."""
    if coupons == 0:
        return 0.0, 0.0, 0.0
    value = distinct_for(lg_k, coupons) if hip is None else hip
    errors = [cpc_error(lg_k, deviations, upper, hip is not None) for upper in (False, True)]
    return max(float(coupons), value / (1 + errors[0])), value, float(math.ceil(value / (1 - errors[1])))


def estimate(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return bounds(state, 1, by).select(*by, "estimate")


def ordered_estimate(df: DataFrame, key: str, order: str, by: Sequence[str] = (), lg_k: int = DEFAULT_LG_K, seed: int = DEFAULT_SEED) -> DataFrame:
    """estimate (HIP): each new coupon adds the inverse of the chance that a key brings a new one, in the order of a column.

    Only first appearances matter: coupons are made distinct by their least `order` before the sequential
    part, which then sees at most 64 k rows a group.
    """
    firsts = coupons(df, key, by, lg_k, seed, [order]).groupBy(*by, "row", "col").agg(F.min(order).alias("__at"))
    k = 1 << lg_k

    @F.pandas_udf("double")
    def run(cols: pd.Series) -> pd.Series:
        out = []
        for c in cols:
            chance = 2.0 ** -(np.asarray(c, np.float64) + 1)
            before = k - np.concatenate([[0.0], np.cumsum(chance)[:-1]])
            out.append(float((k / before).sum()))
        return pd.Series(out)

    packed = firsts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__at", "row", "col"))).alias("__c"))
    return packed.select(*by, run(F.col("__c.col")).alias("estimate"))


def validate(state: DataFrame) -> DataFrame:
    """Rows of a state that can't be: outside the table, or without a coupon. Empty for a valid state."""
    return state.where((F.col("row") < 0) | (F.col("row") >= F.pow(F.lit(2), F.col("lg_k"))) | (F.col("bits") == 0))
