"""Heavy hitters: counters for the most frequent items, with a common offset for what was dropped.

State: `by` columns, item and lb BIGINT, the lower bound of a tracked item's weight, and one more row a
group, whose item is null, with the group's offset and weight BIGINT (null in the other rows). An item's
weight is from lb to lb + offset; an untracked item's at most offset. All that is added when states are
merged stands in one row a key, so merging, under any grouping, is one sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SketchArgumentError
from .theta import _joined

MIN_LG, MAX_LG = 3, 26
LOAD = 0.75
EPSILON = 3.5


def lg_of(max_map_size: int) -> int:
    """The exponent of a map size, which must be a power of two."""
    if max_map_size < 1 or max_map_size & (max_map_size - 1):
        raise SketchArgumentError("the map size must be a power of 2", max_map_size=max_map_size)
    lg = max(MIN_LG, max_map_size.bit_length() - 1)
    if lg > MAX_LG:
        raise SketchArgumentError("the map size is too large", max_map_size=max_map_size)
    return lg


def capacity(max_map_size: int) -> int:
    """Items that a map of this size tracks."""
    return int(LOAD * (1 << lg_of(max_map_size)))


def epsilon(max_map_size: int) -> float:
    """The width of the bounds is at most epsilon * the total weight."""
    return EPSILON / (1 << lg_of(max_map_size))


def epsilon_for_lg(lg: int) -> float:
    return EPSILON / (1 << lg)


def apriori_error(max_map_size: int, total_weight: int) -> float:
    return epsilon(max_map_size) * total_weight


def _purge(rows: DataFrame, by: Sequence[str], keep: int) -> DataFrame:
    """rows: by, item, lb, offset, weight, one row an item. Keeps `keep` items: the count of the next one is taken off all and becomes offset.

    All items at or below the next count go, so its size bounds what any dropped item weighed; it is at
    most the weight over keep + 1. Ranks are taken in two steps: first within the tasks that hold the
    items after the aggregation by item, then among their survivors, so no task ranks all items of a group.
    """
    first = Window.partitionBy(*by, "__slice").orderBy(F.desc_nulls_first("lb"))
    few = rows.withColumn("__slice", F.spark_partition_id()).withColumn("__rank", F.row_number().over(first))
    few = few.where((F.col("__rank") <= keep + 2) | F.col("item").isNull()).drop("__slice", "__rank")
    group = Window.partitionBy(*by)
    ranked = few.withColumn("__rank", F.row_number().over(group.orderBy(F.desc_nulls_last("lb"))))
    cut = F.coalesce(F.max(F.when(F.col("__rank") == keep + 1, F.col("lb"))).over(group), F.lit(0))
    ranked = ranked.withColumn("__cut", cut).where("item is null or lb > __cut")
    return ranked.select(*by, "item", (F.col("lb") - F.col("__cut")).alias("lb"), (F.col("offset") + F.col("__cut")).alias("offset"), "weight")


def build(df: DataFrame, item: str, max_map_size: int, by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """The heaviest items of each group. Null items and counts of 0 don't count; negative counts are refused."""
    keep = capacity(max_map_size)
    w = F.col(count).cast("long") if count else F.lit(1).cast("long")
    checked = F.when(w < 0, F.raise_error(F.lit("counts must not be negative")).cast("long")).otherwise(w)
    rows = df.select(*by, F.col(item).alias("item"), checked.alias("__w")).where("item is not null")
    counts = rows.groupBy(*by, "item").agg(F.sum("__w").alias("lb")).where("lb > 0")
    facts = rows.groupBy(*by).agg(F.coalesce(F.sum("__w"), F.lit(0)).alias("weight"))
    facts = facts.select(*by, F.lit(None).cast(rows.schema["item"].dataType).alias("item"), F.lit(None).cast("long").alias("lb"), F.lit(0).cast("long").alias("offset"), "weight")
    none = F.lit(None).cast("long")
    return _purge(counts.select(*by, "item", "lb", none.alias("offset"), none.alias("weight")).unionByName(facts), by, keep)


def merge(*states: DataFrame, max_map_size: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds states; a coarser `by` rolls groups up. Weights and offsets add also where nothing is tracked."""
    rows = None
    for s in states:
        one = s.select(*by, "item", "lb", "offset", "weight")
        rows = one if rows is None else rows.unionByName(one)
    added = rows.groupBy(*by, "item").agg(*[F.sum(c).alias(c) for c in ("lb", "offset", "weight")])
    return _purge(added, by, capacity(max_map_size))


def facts(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, offset, weight: a row a group."""
    return state.where(F.col("item").isNull()).select(*by, "offset", "weight")


def rows_of(state: DataFrame) -> DataFrame:
    """item, estimate, lower_bound, upper_bound of the tracked items, and their group's offset."""
    by = [c for c in state.columns if c not in ("item", "lb", "offset", "weight")]
    tracked = _joined(state.where("item is not null").select(*by, "item", "lb"), facts(state, by).select(*by, "offset"), by)
    upper = F.col("lb") + F.col("offset")
    return tracked.select(*by, "item", upper.alias("estimate"), F.col("lb").alias("lower_bound"), upper.alias("upper_bound"), "offset")


def frequent_items(state: DataFrame, no_false_positives: bool = True, threshold: int = 0) -> DataFrame:
    """Items above the threshold, which is at least the offset: surely (no false positives) or possibly (no false negatives).

    Sorted by descending estimate, ties by the item.
    """
    least = F.greatest(F.lit(threshold), F.col("offset"))
    found = rows_of(state).where((F.col("lower_bound") if no_false_positives else F.col("upper_bound")) > least)
    return found.drop("offset").orderBy(F.desc("estimate"), "item")


def estimates(state: DataFrame, probes: DataFrame, item: str, by: Sequence[str] = ()) -> DataFrame:
    """probes with estimate, lower_bound, upper_bound; an untracked item has 0, 0 and the offset."""
    asked = _joined(probes.select(*by, F.col(item).alias("__item")).distinct(), facts(state, by).select(*by, F.col("offset").alias("__offset")), by)
    right = state.where("item is not null").select(*[F.col(c).alias(f"__r_{c}") for c in by], F.col("item").alias("__tracked"), "lb")
    found = asked.join(right, [asked["__item"] == right["__tracked"], *[asked[c].eqNullSafe(right[f"__r_{c}"]) for c in by]], "left")
    offset = F.coalesce("__offset", F.lit(0))
    return found.select(
        *by,
        F.col("__item").alias(item),
        F.when(F.col("lb").isNotNull(), F.col("lb") + offset).otherwise(0).alias("estimate"),
        F.coalesce("lb", F.lit(0)).alias("lower_bound"),
        (F.coalesce("lb", F.lit(0)) + offset).alias("upper_bound"),
    )


def statistics(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """num_active, total_weight, maximum_error and is_empty (nothing is tracked) of each group."""
    rows = state.groupBy(*by).agg(F.count("item").alias("num_active"), F.max("weight").alias("total_weight"), F.max("offset").alias("maximum_error"))
    return rows.withColumn("is_empty", F.col("num_active") == 0)
