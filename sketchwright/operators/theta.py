"""Distinct counting and set algebra over samples of hashes: the k smallest, and a threshold theta.

State: `by` columns, theta BIGINT, is_empty BOOLEAN, lg_k INT, and one row for each retained hash
(hash BIGINT; null in the single row of a group that retains none). Theta in 2^63 - 1 parts; all
retained hashes are below it. States are kept trimmed to the k smallest, so equal key sets give equal
states whatever the order or the merging. `by` may be empty: one group, present on empty input too.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SketchArgumentError
from ..functions.bounds import check_deviations, ratio_bounds, sampled_bounds
from ..functions.hashing import DEFAULT_SEED, seed_hash, with_hash
from ..sources import codecs

MAX_THETA = 2**63 - 1
MIN_LG_K, MAX_LG_K, DEFAULT_LG_K = 5, 26, 12
#: Key types whose built-in aggregate hashes the same bytes as with_hash.
NATIVE_TYPES = ("byte", "short", "integer", "long", "string", "binary")


def check_lg_k(lg_k: int) -> int:
    if not MIN_LG_K <= lg_k <= MAX_LG_K:
        raise SketchArgumentError(f"lg_k must be from {MIN_LG_K} to {MAX_LG_K}", lg_k=lg_k)
    return lg_k


def start_theta(p: float) -> int:
    if not 0 < p <= 1:
        raise SketchArgumentError("the sampling probability must be in (0, 1]", p=p)
    return MAX_THETA if p == 1 else int(MAX_THETA * p)


def hashed(df: DataFrame, key: str, seed: int = DEFAULT_SEED, skip_empty: bool = True) -> DataFrame:
    """df with hash, the upper 63 bits of h1; null for keys that are not counted."""
    return with_hash(df, key, "__h1", "__h2", seed, skip_empty).withColumn("hash", F.shiftrightunsigned("__h1", 1)).drop("__h1", "__h2")



def _trim(rows: DataFrame, by: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """rows: by, hash (distinct in a group, or null), theta, is_empty, lg_k, carried -> trimmed state, a null row only where nothing is kept.

    A group's k smallest hashes are ranked in two steps: first within the tasks that hold its rows, then
    among their survivors, at most k + 1 a task; so no task ranks all hashes of many merged states.
    """
    k = F.pow(F.lit(2), F.col("lg_k")).cast("int")
    rows = rows.withColumn("hash", F.when(F.col("hash") < F.col("theta"), F.col("hash"))).withColumn("__slice", F.spark_partition_id())
    near = Window.partitionBy(*by, "__slice").orderBy(F.col("hash").asc_nulls_last())
    rows = rows.withColumn("__rank", F.row_number().over(near)).where(F.col("__rank") <= k + 1).drop("__slice", "__rank")
    order = Window.partitionBy(*by).orderBy(F.col("hash").asc_nulls_last())
    group = Window.partitionBy(*by)
    ranked = rows.withColumn("__rank", F.row_number().over(order))
    ranked = ranked.withColumn("__cut", F.min(F.when(F.col("__rank") == k + 1, F.col("hash"))).over(group))
    ranked = ranked.withColumn("theta", F.least("theta", F.coalesce("__cut", F.lit(MAX_THETA))))
    kept = ranked.where("hash < theta or __rank = 1")
    return kept.select(*by, F.when(F.col("hash") < F.col("theta"), F.col("hash")).alias("hash"), "theta", "is_empty", "lg_k", *carried)


def _native(df: DataFrame, key: str, by: Sequence[str], lg_k: int) -> DataFrame:
    """by, theta, is_empty, hashes array of the groups, by Spark's own aggregate.

    It is one pass with a map-side combine: what is shuffled is a sample for each task and group. It keeps
    at least the k smallest hashes and a threshold that is the next one, so trimming it to k gives the state.
    """
    kind = df.schema[key].dataType.typeName()
    value = F.col(key) if kind in ("string", "binary") else F.col(key).cast("long")
    k = 1 << lg_k

    @F.pandas_udf("theta long, is_empty boolean, hashes array<long>")
    def unpack(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            found = codecs.decode_theta(bytes(v))
            hashes = sorted(found.hashes)
            out.append((hashes[k] if len(hashes) > k else found.theta, found.empty, hashes[:k]))
        return pd.DataFrame(out, columns=["theta", "is_empty", "hashes"])

    rows = df.groupBy(*by).agg(F.theta_sketch_agg(value, lg_k).alias("__s")).withColumn("__s", unpack("__s"))
    return rows.select(*by, "__s.theta", "__s.is_empty", "__s.hashes")


def _is_native(df: DataFrame, key: str, p: float, seed: int, skip_empty: bool) -> bool:
    return p == 1 and seed == DEFAULT_SEED and skip_empty and df.schema[key].dataType.typeName() in NATIVE_TYPES


def build(df: DataFrame, key: str, by: Sequence[str] = (), lg_k: int = DEFAULT_LG_K, p: float = 1.0, seed: int = DEFAULT_SEED, native: bool = True, skip_empty: bool = True) -> DataFrame:
    """The state of the distinct keys of each group. Null keys are not counted; a group with none is empty.

    Whole samples of the usual seed come from the built-in aggregate (native); others are hashed in
    columns, made distinct by one aggregate, and trimmed. Both give the same state.
    """
    check_lg_k(lg_k)
    seed_hash(seed)
    rows = df.select(*by, F.col(key).alias("__key"))
    if native and _is_native(rows, "__key", p, seed, skip_empty):
        found = _native(rows, "__key", by, lg_k)
        return found.select(*by, F.explode_outer("hashes").alias("hash"), "theta", "is_empty", F.lit(lg_k).alias("lg_k"))
    distinct = sampled(rows, "__key", by, p, seed, skip_empty).groupBy(*by, "hash").agg(F.max("counted").alias("__seen"))
    return _started(distinct, by, lg_k, p)


def sampled(rows: DataFrame, key: str, by: Sequence[str], p: float, seed: int, skip_empty: bool = True, carried: Sequence[str] = ()) -> DataFrame:
    """by, carried, hash (null if out of the sample), counted (whether there is a key). A projection, no filter: Spark would push a
    filter on the hash below the steps that compute it, and the whole hash would be written out in it, twice at each step."""
    found = hashed(rows, key, seed, skip_empty)
    inside = (F.col("hash") > 0) & (F.col("hash") < start_theta(p))
    out = found.select(*by, *carried, F.when(inside, F.col("hash")).alias("hash"), F.col("hash").isNotNull().alias("counted"))
    if by:
        return out
    none = [F.lit(None).cast(out.schema[c].dataType).alias(c) for c in (*carried, "hash")]  # the one group is present on empty input too
    return out.unionByName(rows.sparkSession.range(1).select(*none, F.lit(False).alias("counted")))


def _started(distinct: DataFrame, by: Sequence[str], lg_k: int, p: float, carried: Sequence[str] = ()) -> DataFrame:
    """The state of distinct rows by, hash, __seen, carried. A group's null row stays only where nothing else does, and says whether it saw a key."""
    start = start_theta(p)
    rows = distinct.select(*by, "hash", *carried, "__seen", F.lit(start).alias("theta"), F.lit(False).alias("is_empty"), F.lit(lg_k).alias("lg_k"))
    rows = _trim(rows, by, [*carried, "__seen"]).withColumn("is_empty", ~F.col("__seen"))
    return rows.select(*by, "hash", F.when(F.col("is_empty"), F.lit(MAX_THETA)).otherwise(F.col("theta")).alias("theta"), "is_empty", "lg_k", *carried)


def _joined(a: DataFrame, b: DataFrame, by: Sequence[str], how: str = "left", where: Column | None = None) -> DataFrame:
    """Joins on the group columns, nulls equal, and `where`; without group columns one of a and b is a single row."""
    if not by:
        return a.join(b, F.lit(True) if where is None else where, how)
    right = b.select(*[F.col(c).alias(f"__r_{c}") for c in by], *[c for c in b.columns if c not in by])
    on = [a[c].eqNullSafe(right[f"__r_{c}"]) for c in by] + ([] if where is None else [where])
    return a.join(right, on, how).drop(*[f"__r_{c}" for c in by])


def _met(states: Sequence[DataFrame], by: Sequence[str], carried: Sequence = ()) -> DataFrame:
    """A row for each group and hash of any input: by, hash, in (bit i: input i), and facts over the group.

    any (bit i: input i has the group), theta and theta0, theta1 (least of all, of input 0 and 1, empty inputs
    left out), empty (bit i: input i is empty), lg_k. The inputs are read once; a group's rows, at most 2^lg_k for
    each state merged into it, meet in one window.
    """
    rows = None
    for i, s in enumerate(states):
        one = s.withColumn("__i", F.lit(1 << i).cast("long"))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    full = F.when(~F.col("is_empty"), F.col("theta"))
    each = rows.groupBy(*by, "hash").agg(
        F.bit_or("__i").alias("in"),
        F.min(full).alias("__t"),
        *[F.min(F.when(F.col("__i") == 1 << i, full)).alias(f"__t{i}") for i in (0, 1)],
        F.bit_or(F.when(F.col("is_empty"), F.lit(0)).otherwise(F.col("__i"))).alias("__f"),
        F.min("lg_k").alias("__k"),
        *carried,
    )
    group = Window.partitionBy(*by)
    return each.withColumns(
        {
            "any": F.bit_or("in").over(group),
            "full": F.bit_or("__f").over(group),
            "theta": F.coalesce(F.min("__t").over(group), F.lit(MAX_THETA)),
            **{f"theta{i}": F.coalesce(F.min(f"__t{i}").over(group), F.lit(MAX_THETA)) for i in (0, 1)},
            "lg_k": F.min("__k").over(group),
        }
    ).drop("__t", "__t0", "__t1", "__f", "__k")


def union(*states: DataFrame, by: Sequence[str] = (), lg_k: int | None = None) -> DataFrame:
    """Keys of any input. Also merges a finer state's groups: give the coarser `by`."""
    rows = _met(states, by)
    size = F.lit(check_lg_k(lg_k)) if lg_k else F.col("lg_k")
    return _trim(rows.select(*by, "hash", "theta", (F.col("full") == 0).alias("is_empty"), size.alias("lg_k")), by)


def _settled(rows: DataFrame, by: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """rows with hash null where dropped -> state; exact and without keys is empty."""
    group = Window.partitionBy(*by)
    first = Window.partitionBy(*by).orderBy(F.col("hash").asc_nulls_last())
    gone = F.col("is_empty") | ((F.count("hash").over(group) == 0) & (F.col("theta") == MAX_THETA))
    rows = rows.withColumn("is_empty", gone).withColumn("__first", F.row_number().over(first)).where("hash is not null or __first = 1")
    theta = F.when(F.col("is_empty"), F.lit(MAX_THETA)).otherwise(F.col("theta"))
    return rows.select(*by, "hash", theta.alias("theta"), "is_empty", "lg_k", *carried)


def intersection(*states: DataFrame, by: Sequence[str] = (), carried: dict[str, Column] | None = None) -> DataFrame:
    """Keys of all inputs; a group that an input lacks is left out. carried: aggregates over a key's rows, by name."""
    if not states:
        raise SketchArgumentError("an intersection needs an input")
    every = (1 << len(states)) - 1
    names = list(carried or {})
    rows = _met(states, by, [c.alias(n) for n, c in (carried or {}).items()]).where(F.col("any") == every)
    kept = (F.col("in") == every) & (F.col("full") == every) & (F.col("hash") < F.col("theta"))
    rows = rows.select(*by, F.when(kept, F.col("hash")).alias("hash"), "theta", (F.col("full") != every).alias("is_empty"), "lg_k", *[F.when(kept, F.col(c)).alias(c) for c in names])
    return _settled(rows, by, names)


def a_not_b(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keys of a that b lacks; further columns of a stay. Groups that b lacks are a's."""
    extra = [c for c in a.columns if c not in (*by, "hash", "theta", "is_empty", "lg_k")]
    b = b.select(*by, "hash", "theta", "is_empty", "lg_k")
    rows = _met([a, b], by, [F.first(c, True).alias(c) for c in extra]).where(F.col("any").bitwiseAND(1) == 1)
    theta = F.when(F.col("full") == 3, F.col("theta")).otherwise(F.col("theta0"))
    kept = (F.col("in") == 1) & (F.col("hash") < theta)
    rows = rows.select(*by, F.when(kept, F.col("hash")).alias("hash"), theta.alias("theta"), (F.col("full").bitwiseAND(1) == 0).alias("is_empty"), "lg_k", *[F.when(kept, F.col(c)).alias(c) for c in extra])
    return _settled(rows, by, extra)


def fraction(theta: Column) -> Column:
    return theta.cast("double") / F.lit(float(MAX_THETA))


def summary(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row a group: retained, theta, theta_fraction, is_empty, is_estimation_mode, lg_k, estimate."""
    rows = state.groupBy(*by).agg(F.count("hash").alias("retained"), F.min("theta").alias("theta"), F.min("is_empty").alias("is_empty"), F.min("lg_k").alias("lg_k"))
    share = fraction(F.col("theta"))
    estimate = F.when(F.col("is_empty"), 0.0).otherwise(F.col("retained") / share)
    return rows.select(*by, "retained", "theta", share.alias("theta_fraction"), "is_empty", ((F.col("theta") < MAX_THETA) & ~F.col("is_empty")).alias("is_estimation_mode"), "lg_k", estimate.alias("estimate"))


def estimate(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return summary(state, by).select(*by, "estimate")


def bounds(state: DataFrame, num_std_dev: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """lower, estimate and upper of each group."""
    check_deviations(num_std_dev)
    rows = summary(state, by)
    found = sampled_bounds(F.col("retained"), F.col("theta_fraction"), num_std_dev, F.col("is_empty"))
    rows = rows.withColumn("__b", found)
    return rows.select(*by, F.col("__b.lower").alias("lower"), "estimate", F.col("__b.upper").alias("upper"))


def jaccard(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """lower, estimate and upper of |A and B| / |A or B| at two deviations.

    Two empty sets are alike, an empty and another one are not. Shares are counted among the keys under
    the lesser theta. A group that one side lacks is empty there.
    """
    keys = [s.select(*by, "hash", "theta", "is_empty", "lg_k") for s in (a, b)]
    there = F.col("hash") < F.col("theta")
    facts = _met(keys, by).groupBy(*by).agg(
        F.count_if(there).alias("whole"),
        F.count_if(there & (F.col("in") == 3)).alias("inside"),
        F.count_if(F.col("hash").isNotNull()).alias("kept"),
        F.min("full").alias("full"),
        F.min("theta").alias("theta"),
        F.max(F.greatest("theta0", "theta1")).alias("most"),
    )

    @F.pandas_udf("lower double, estimate double, upper double")
    def run(inside: pd.Series, whole: pd.Series, kept: pd.Series, full: pd.Series, theta: pd.Series, most: pd.Series) -> pd.DataFrame:
        out = []
        for i, w, n, f, t, m in zip(inside, whole, kept, full, theta, most):
            if f != 3:
                out.append((1.0,) * 3 if f == 0 else (0.0,) * 3)
            elif i == w == n and t == m:
                out.append((1.0,) * 3)
            else:
                out.append(ratio_bounds(int(i), int(w), int(t) / MAX_THETA))
        return pd.DataFrame(out, columns=["lower", "estimate", "upper"])

    found = facts.withColumn("__j", run("inside", "whole", "kept", "full", "theta", "most"))
    return found.select(*by, F.col("__j.lower").alias("lower"), F.col("__j.estimate").alias("estimate"), F.col("__j.upper").alias("upper"))


def exactly_equal(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """is_equal for each group: the same retained hashes, theta and emptiness."""
    keys = [s.select(*by, "hash", "theta", "is_empty", "lg_k") for s in (a, b)]
    same = (F.col("any") == 3) & F.col("full").isin(0, 3) & (F.col("theta0") == F.col("theta1")) & (F.col("hash").isNull() | (F.col("in") == 3))
    return _met(keys, by).groupBy(*by).agg(F.bool_and(same).alias("is_equal"))


def compact(state: DataFrame, by: Sequence[str] = (), ordered: bool = True) -> DataFrame:
    """A row a group with the hashes in an array: at most 2^lg_k of them."""
    hashes = F.collect_list("hash")
    return state.groupBy(*by).agg(F.min("theta").alias("theta"), F.min("is_empty").alias("is_empty"), F.min("lg_k").alias("lg_k"), (F.sort_array(hashes) if ordered else hashes).alias("hashes"))


def expand(compacted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The state of compact()ed rows."""
    return compacted.select(*by, F.explode_outer("hashes").alias("hash"), "theta", "is_empty", "lg_k")
