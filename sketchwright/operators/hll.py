"""Distinct counting by registers: in each slot, the longest run of leading zeros seen.

State: `by` columns, slot INT, value INT for the slots that were hit, lg_k INT. A maximum per slot is all
that merging needs, so the state rolls up under any grouping. Estimates are those of merged summaries
(composite estimator); estimates that depend on the order of the keys come from Spark's own sketch.

A second state, `by` columns and sketch BINARY, is that of Spark's own aggregate: it keeps the coupons of small
groups one by one and registers of large ones, and read() tells which, with the estimate that goes with it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SketchArgumentError
from ..functions.bounds import check_deviations
from ..functions.coupons import distinct_for
from ..functions.hashing import DEFAULT_SEED, leading_zeros, with_counted_hash
from ..functions.relative_errors import hll_error
from ..sources import codecs
from .theta import _joined

MIN_LG_K, MAX_LG_K, DEFAULT_LG_K = 4, 21, 12
COUPON_BITS = 26
#: Relative standard error while coupons are kept one by one.
COUPON_RSE = 0.409 / (1 << 13)


def check_lg_k(lg_k: int) -> int:
    if not MIN_LG_K <= lg_k <= MAX_LG_K:
        raise SketchArgumentError(f"lg_k must be from {MIN_LG_K} to {MAX_LG_K}", lg_k=lg_k)
    return lg_k


def coupon_columns(h1: Column, h2: Column) -> tuple[Column, Column]:
    """The 26-bit slot and the value 1 + leading zeros (at most 63) of a hash."""
    slot = h1.bitwiseAND((1 << COUPON_BITS) - 1).cast("int")
    return slot, (F.least(leading_zeros(h2), F.lit(62)) + 1).cast("int")


def coupons(df: DataFrame, key: str, by: Sequence[str] = (), seed: int = DEFAULT_SEED) -> DataFrame:
    """by, slot26, value: hashed once, they feed states of any lg_k. Null keys are left out."""
    rows = with_counted_hash(df.select(*by, F.col(key).alias("__key")), "__key", "__h1", "__h2", seed)
    slot, value = coupon_columns(F.col("__h1"), F.col("__h2"))
    return rows.select(*by, slot.alias("slot26"), value.alias("value"))


def from_coupons(rows: DataFrame, by: Sequence[str] = (), lg_k: int = DEFAULT_LG_K) -> DataFrame:
    check_lg_k(lg_k)
    return rows.groupBy(*by, F.col("slot26").bitwiseAND((1 << lg_k) - 1).alias("slot")).agg(F.max("value").alias("value")).withColumn("lg_k", F.lit(lg_k))


def build(df: DataFrame, key: str, by: Sequence[str] = (), lg_k: int = DEFAULT_LG_K, seed: int = DEFAULT_SEED) -> DataFrame:
    """Registers of the distinct keys of each group. The map side already combines, so the shuffle carries at most 2^lg_k rows a group and task."""
    return from_coupons(coupons(df, key, by, seed), by, lg_k)


def union(*states: DataFrame, by: Sequence[str] = (), lg_max_k: int = MAX_LG_K) -> DataFrame:
    """Merges states; the result has the least lg_k of a group's inputs and lg_max_k. Values don't change when slots fold."""
    check_lg_k(lg_max_k)
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    least = rows.groupBy(*by).agg(F.least(F.min("lg_k"), F.lit(lg_max_k)).alias("__lg"))
    rows = _joined(rows, least, by)
    slot = F.col("slot").bitwiseAND(F.pow(F.lit(2), F.col("__lg")).cast("int") - 1)
    return rows.groupBy(*by, slot.alias("slot")).agg(F.max("value").alias("value"), F.min("__lg").alias("lg_k"))


def downsample(state: DataFrame, lg_k: int, by: Sequence[str] = ()) -> DataFrame:
    return union(state, by=by, lg_max_k=lg_k)


def facts(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row a group: lg_k, hit (slots), kxq0 and kxq1, the sums of 2^-value below and from 32 on, over all slots."""
    inverse = F.pow(F.lit(2.0), -F.col("value"))
    rows = state.groupBy(*by).agg(
        F.min("lg_k").alias("lg_k"),
        F.count("slot").alias("hit"),
        F.coalesce(F.sum(F.when(F.col("value") < 32, inverse)), F.lit(0.0)).alias("low"),
        F.coalesce(F.sum(F.when(F.col("value") >= 32, inverse)), F.lit(0.0)).alias("kxq1"),
    )
    return rows.select(*by, "lg_k", "hit", (F.col("low") + F.pow(F.lit(2.0), F.col("lg_k")) - F.col("hit")).alias("kxq0"), "kxq1")


def classic_estimate(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """estimate by the harmonic mean of the registers, with linear counting while many slots are empty; pure SQL."""
    k = F.pow(F.lit(2.0), F.col("lg_k"))
    alpha = F.when(F.col("lg_k") == 4, 0.673).when(F.col("lg_k") == 5, 0.697).when(F.col("lg_k") == 6, 0.709).otherwise(0.7213 / (1 + 1.079 / k))
    raw = alpha * k * k / (F.col("kxq0") + F.col("kxq1"))
    empty = k - F.col("hit")
    value = F.when((raw <= 2.5 * k) & (empty > 0), k * F.log(k / F.when(empty > 0, empty))).otherwise(raw)
    return facts(state, by).select(*by, F.when(F.col("hit").isNull() | (F.col("hit") == 0), 0.0).otherwise(value).alias("estimate"))


def to_binary(state: DataFrame, by: Sequence[str] = (), bits: int = 8) -> DataFrame:
    """A row a group with sketch BINARY: registers of 8, 6 or 4 bits, marked as merged. Spark's hll_sketch_* functions read it."""
    groups = state.groupBy(*by).agg(F.min("lg_k").alias("lg_k"), F.collect_list(F.struct("slot", "value")).alias("__r"))

    def packed(lg_k: int, slots: np.ndarray, values: np.ndarray) -> bytes:
        registers = np.zeros(1 << lg_k, np.uint8)
        registers[slots] = values
        return codecs.encode_hll(registers, bits)

    @F.pandas_udf("binary")
    def pack(lg: pd.Series, slots: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(n) else packed(int(n), np.asarray(s, np.int64), np.asarray(v, np.int64)) for n, s, v in zip(lg, slots, values)])

    return groups.select(*by, pack("lg_k", F.col("__r.slot"), F.col("__r.value")).alias("sketch"))


def keys_until(lg_k: int, hit: int) -> float:
    """How many keys hit so many of 2^lg_k slots, on average: k (1/k + 1/(k-1) + ... + 1/(k-hit+1))."""

    def harmonic(n: int) -> float:
        if n < 32:
            return math.fsum(1 / i for i in range(1, n + 1))
        return math.log(n) + np.euler_gamma + 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4) - 1 / (252 * n**6)

    k = 1 << lg_k
    return k * (harmonic(k) - harmonic(k - hit))


def linear_estimate(lg_k: int, hit: int) -> float:
    """keys_until; with all slots hit, k ln 2k."""
    k = 1 << lg_k
    return k * math.log(2 * k) if hit >= k else keys_until(lg_k, hit)


def _composite(rounded: int, lg_k: int, hit: int) -> float:
    """The composite estimate from Spark's, which is rounded: where that is the linear one, the linear one unrounded."""
    linear = linear_estimate(lg_k, hit)
    return linear if abs(rounded - linear) <= 0.5 + 1e-6 else float(rounded)


def estimate(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """estimate DOUBLE of the composite estimator, 0 for a group without keys. Up to about 0.64 * 2^lg_k keys it counts empty slots; beyond, it is a whole number."""
    return bounds(state, 1, by).select(*by, "estimate")


def bounds(state: DataFrame, num_std_dev: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """lower, estimate and upper; no lower than the number of slots hit."""
    check_deviations(num_std_dev)
    rows = to_binary(state, by).withColumn("__rounded", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)))
    found = _joined(rows.drop("sketch"), facts(state, by).select(*by, "lg_k", "hit"), by)

    @F.pandas_udf("lower double, estimate double, upper double")
    def run(rounded: pd.Series, lg: pd.Series, hit: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_bounds(_composite(int(r), int(k), int(h)), int(k), int(h), False, num_std_dev) if h > 0 else (0.0,) * 3 for r, k, h in zip(rounded, lg, hit)], columns=["lower", "estimate", "upper"])

    return found.withColumn("__b", run("__rounded", "lg_k", "hit")).select(*by, "__b.lower", "__b.estimate", "__b.upper")


def linear_bounds(state: DataFrame, num_std_dev: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """lower, estimate and upper from the slots hit alone, whatever their number: how many keys hit as many on average, 0 for none.
    The errors are those of bounds(). They hold while many slots are empty; with few or none left, bounds() is nearer."""
    check_deviations(num_std_dev)

    @F.pandas_udf("lower double, estimate double, upper double")
    def run(lg: pd.Series, hit: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_bounds(keys_until(int(k), int(h)), int(k), int(h), False, num_std_dev) if h > 0 else (0.0,) * 3 for k, h in zip(lg, hit)], columns=["lower", "estimate", "upper"])

    return facts(state, by).withColumn("__b", run("lg_k", "hit")).select(*by, "__b.lower", "__b.estimate", "__b.upper")


def _bounds(value: float, lg_k: int, hit: int, hip: bool, num_std_dev: int) -> tuple[float, float, float]:
    low, high = (hll_error(lg_k, num_std_dev, upper, hip) for upper in (False, True))
    return max(value / (1 + low), float(hit)), value, value / (1 + high)


def sketches(df: DataFrame, key: str, by: Sequence[str] = (), lg_k: int = DEFAULT_LG_K) -> DataFrame:
    """by, sketch: Spark's own aggregate of integer, string or binary keys. What is shuffled is a summary for each task and group."""
    check_lg_k(lg_k)
    return df.groupBy(*by).agg(F.hll_sketch_agg(key, lg_k).alias("sketch"))


def merge_sketches(*states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, sketch of the union; a coarser `by` rolls groups up. Small summaries stay small as long as their union is."""
    rows = None
    for s in states:
        one = s.select(*by, "sketch")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*by).agg(F.hll_union_agg("sketch", True).alias("sketch"))


def read(states: DataFrame, num_std_dev: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """by, mode (list, set or registers), register_bits, lg_k, is_empty, is_merged, lower, estimate, upper of stored summaries.

    Coupons kept one by one are inverted as in small_estimate(); registers give the composite estimate if merged, else
    the one of the keys' order (HIP), each with its own errors. Null summaries are left out.
    """
    check_deviations(num_std_dev)
    fields = "mode string, register_bits int, lg_k int, is_empty boolean, is_merged boolean, lower double, estimate double, upper double"

    @F.pandas_udf(fields)
    def run(stored: pd.Series, rounded: pd.Series) -> pd.DataFrame:
        out = []
        for v, r in zip(stored, rounded):
            s = codecs.decode_hll(bytes(v))
            if s.registers is None:
                found = _coupon_bounds(len(s.packed), num_std_dev)
            else:
                hit = int(np.count_nonzero(s.registers))
                value = _composite(int(r), s.lg_k, hit) if s.merged else s.hip
                found = _bounds(value, s.lg_k, hit, not s.merged, num_std_dev)
            out.append((s.mode, s.bits, s.lg_k, found[1] == 0, s.merged, *found))
        return pd.DataFrame(out, columns=[f.split()[0] for f in fields.split(", ")])

    rows = states.where(F.col("sketch").isNotNull())
    return rows.withColumn("__s", run("sketch", F.hll_sketch_estimate("sketch"))).select(*by, "__s.*")


def _coupon_bounds(n: int, num_std_dev: int) -> tuple[float, float, float]:
    value = max(float(n), distinct_for(COUPON_BITS, n))
    return max(float(n), value / (1 + num_std_dev * COUPON_RSE)), value, value / (1 - num_std_dev * COUPON_RSE)


def small_estimate(rows: DataFrame, by: Sequence[str] = (), num_std_dev: int = 2) -> DataFrame:
    """lower, estimate, upper of coupons(): right to about 5e-5 while there are few against 2^26 slots."""
    check_deviations(num_std_dev)
    found = rows.groupBy(*by).agg(F.countDistinct("slot26", "value").alias("n"))

    @F.pandas_udf("lower double, estimate double, upper double")
    def invert(n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_coupon_bounds(int(c), num_std_dev) for c in n], columns=["lower", "estimate", "upper"])

    return found.withColumn("__b", invert("n")).select(*by, "__b.lower", "__b.estimate", "__b.upper")


def ordered_estimate(df: DataFrame, key: str, by: Sequence[str] = (), lg_k: int = DEFAULT_LG_K) -> DataFrame:
    """estimate BIGINT by Spark's built-in sketch, which uses the order of the keys where it saw them all."""
    check_lg_k(lg_k)
    return df.groupBy(*by).agg(F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(key, lg_k)), F.lit(0)).alias("estimate"))


def sizes(lg_k: int, bits: int = 8) -> int:
    """Bytes of stored registers of 4, 6 or 8 bits, without exceptions."""
    check_lg_k(lg_k)
    if bits not in (4, 6, 8):
        raise SketchArgumentError("registers have 4, 6 or 8 bits", bits=bits)
    return 40 + math.ceil((1 << lg_k) * bits / 8) + (bits == 6)
