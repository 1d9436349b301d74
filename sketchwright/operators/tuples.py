"""Theta samples whose keys carry a summary: per-key aggregates of a uniform sample of the distinct keys.

State: the columns of a theta state and `summary`. A policy says how values of one key become its
summary (update) and how summaries of one key from several states become one (combine); both are
aggregate functions on a Column, so they run inside Spark's aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SketchArgumentError
from ..functions.hashing import DEFAULT_SEED, seed_hash
from . import theta

Aggregate = Callable[[Column], Column]


@dataclass(frozen=True)
class Policy:
    update: Aggregate
    combine: Aggregate | None = None

    def combined(self) -> Aggregate:
        if self.combine is None:
            raise SketchArgumentError("this operation needs a policy with a combine function")
        return self.combine


def element_sum(c: Column) -> Column:
    """Element-wise sum of arrays of doubles of one length."""
    zero = F.transform(F.first(c), lambda _: F.lit(0.0))
    return F.aggregate(F.collect_list(c), zero, lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q))


def text_concat(c: Column) -> Column:
    """Strings joined in ascending order, so the result doesn't depend on the order of the rows."""
    return F.array_join(F.sort_array(F.collect_list(c)), "")


SUM = Policy(F.sum, F.sum)
MIN = Policy(F.min, F.min)
MAX = Policy(F.max, F.max)
COUNT = Policy(F.count, F.sum)
ARRAY_SUM = Policy(element_sum, element_sum)
TEXT = Policy(text_concat, text_concat)


def build(df: DataFrame, key: str, value: str, by: Sequence[str] = (), policy: Policy = SUM, lg_k: int = theta.DEFAULT_LG_K, p: float = 1.0, seed: int = DEFAULT_SEED) -> DataFrame:
    """The state of (key, value) rows.

    Where the built-in aggregate can tell each group's theta, a first pass does, and values of hashes above
    it are dropped in a join with a row a group, before anything is shuffled by key. (The condition takes
    nulls, or Spark would derive a filter on the hash and write the whole hash out in it.)
    """
    theta.check_lg_k(lg_k)
    seed_hash(seed)
    rows = df.select(*by, F.col(key).alias("__key"), F.col(value).alias("__value"))
    keyed = theta.sampled(rows, "__key", by, p, seed, carried=["__value"])
    if not theta._is_native(rows, "__key", p, seed, True):
        value = F.when(F.col("hash").isNotNull(), F.col("__value"))
        each = keyed.groupBy(*by, "hash").agg(F.max("counted").alias("__seen"), policy.update(value).alias("summary"))
        return theta._started(each, by, lg_k, p, ["summary"])
    groups = theta._native(rows.drop("__value"), "__key", by, lg_k).select(*by, F.col("theta").alias("__theta"), "is_empty")
    below = theta._joined(keyed, groups.drop("is_empty"), by, "inner", F.coalesce("hash", F.lit(theta.MAX_THETA)) < F.col("__theta"))
    each = below.groupBy(*by, "hash").agg(policy.update(F.col("__value")).alias("summary"))
    state = theta._joined(groups, each, by)
    return state.select(*by, "hash", F.col("__theta").alias("theta"), "is_empty", F.lit(lg_k).alias("lg_k"), "summary")


def union(*states: DataFrame, by: Sequence[str] = (), policy: Policy = SUM, lg_k: int | None = None) -> DataFrame:
    """Keys of any input, with combined summaries."""
    rows = theta._met(states, by, [policy.combined()(F.col("summary")).alias("summary")])
    size = F.lit(theta.check_lg_k(lg_k)) if lg_k else F.col("lg_k")
    there = F.when(F.col("hash") < F.col("theta"), F.col("summary"))
    return theta._trim(rows.select(*by, "hash", "theta", (F.col("full") == 0).alias("is_empty"), size.alias("lg_k"), there.alias("summary")), by, ["summary"])


def intersection(*states: DataFrame, by: Sequence[str] = (), policy: Policy | None = None) -> DataFrame:
    """Keys of all inputs. There is no default for what becomes of their summaries."""
    if policy is None:
        raise SketchArgumentError("an intersection needs a policy")
    return theta.intersection(*states, by=by, carried={"summary": policy.combined()(F.col("summary"))})


def a_not_b(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keys of a that b lacks, with a's summaries; b is any tuple or theta state."""
    return theta.a_not_b(a, b, by)


def subset_sum(state: DataFrame, by: Sequence[str] = (), value: Column | None = None, where: Column | None = None) -> DataFrame:
    """sum_estimate of the summaries (or a value made of them) over all keys, or those that meet `where`."""
    x = F.col("summary") if value is None else value
    x = F.when(F.col("hash").isNotNull() if where is None else where & F.col("hash").isNotNull(), x)
    rows = state.groupBy(*by).agg(F.coalesce(F.sum(x), F.lit(0)).cast("double").alias("__sum"), F.min("theta").alias("theta"))
    return rows.select(*by, (F.col("__sum") / theta.fraction(F.col("theta"))).alias("sum_estimate"))


summary = theta.summary
estimate = theta.estimate
bounds = theta.bounds


def jaccard(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of the keys; summaries are not looked at."""
    return theta.jaccard(*[s.select(*by, "hash", "theta", "is_empty", "lg_k") for s in (a, b)], by)


def exactly_equal(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return theta.exactly_equal(*[s.select(*by, "hash", "theta", "is_empty", "lg_k") for s in (a, b)], by)


def compact(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row a group with entries array<struct<hash, summary>> by ascending hash."""
    entry = F.when(F.col("hash").isNotNull(), F.struct("hash", "summary"))
    return state.groupBy(*by).agg(F.min("theta").alias("theta"), F.min("is_empty").alias("is_empty"), F.min("lg_k").alias("lg_k"), F.sort_array(F.collect_list(entry)).alias("entries"))
