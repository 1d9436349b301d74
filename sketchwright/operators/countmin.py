"""Point frequencies: a table of counters, each item counted once in every row.

State: `by` columns, row INT, bucket INT, cnt BIGINT for the counters that were touched, and one more
row a group, with row -1 and bucket 0, whose cnt is the total: the sum of absolute weights. So every
column but cnt is a key and merging, under any grouping, is one sum.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SketchArgumentError
from ..functions.hashing import DEFAULT_SEED, murmur3_bytes, seed_hash, signed, unsigned_mod, with_hash
from .theta import _joined

#: The row number under which a group's total stands.
TOTAL = -1


def suggest_num_buckets(relative_error: float) -> int:
    if not relative_error > 0:
        raise SketchArgumentError("the relative error must be above 0", relative_error=relative_error)
    return math.ceil(math.e / relative_error)


def suggest_num_hashes(confidence: float) -> int:
    if not 0 <= confidence <= 1:
        raise SketchArgumentError("the confidence must be in [0, 1]", confidence=confidence)
    return 127 if confidence == 1 else min(127, max(1, math.ceil(math.log(1 / (1 - confidence)))))


@dataclass(frozen=True)
class Config:
    num_hashes: int
    num_buckets: int
    seed: int = DEFAULT_SEED

    def __post_init__(self) -> None:
        if self.num_hashes < 1 or self.num_buckets < 3 or self.num_hashes * self.num_buckets >= 1 << 30:
            raise SketchArgumentError("a table needs a row, 3 buckets and fewer than 2^30 counters", num_hashes=self.num_hashes, num_buckets=self.num_buckets)
        seed_hash(self.seed)

    @property
    def row_seeds(self) -> list[int]:
        return [murmur3_bytes(struct.pack("<Q", i), self.seed)[0] for i in range(self.num_hashes)]

    @property
    def relative_error(self) -> float:
        return math.e / self.num_buckets


def placed(df: DataFrame, item: str, config: Config, carried: Sequence[str], extra: int | None = None) -> DataFrame:
    """carried, row, bucket: the counters of each row's item, one row each, and one of row `extra`. Hash after aggregating: this multiplies rows."""
    out = df
    for i, seed in enumerate(config.row_seeds):
        out = with_hash(out, item, f"__r{i}", "__h2", signed(seed), skip_empty=False).drop("__h2")
    places = [F.struct(F.lit(i).alias("row"), unsigned_mod(F.col(f"__r{i}"), config.num_buckets).cast("int").alias("bucket")) for i in range(config.num_hashes)]
    if extra is not None:
        places.append(F.struct(F.lit(extra).alias("row"), F.lit(0).alias("bucket")))
    cells = F.array(*places)
    return out.select(*carried, F.explode(cells).alias("__c")).select(*carried, "__c.row", "__c.bucket")


def build(df: DataFrame, item: str, config: Config, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Counts items, or adds their weights (BIGINT, negative ones too). Null items and weights of 0 don't count."""
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    rows = df.select(*by, F.col(item).alias("__item"), w.alias("__w")).where("__item is not null and __w <> 0")
    items = rows.groupBy(*by, "__item").agg(F.sum("__w").alias("__w"), F.sum(F.abs("__w")).alias("__a"))
    cells = placed(items, "__item", config, [*by, "__w", "__a"], TOTAL)
    added = F.when(F.col("row") == TOTAL, F.col("__a")).otherwise(F.col("__w"))
    return cells.groupBy(*by, "row", "bucket").agg(F.sum(added).alias("cnt"))


def merge(*states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds tables of one configuration; a coarser `by` rolls groups up."""
    rows = None
    for s in states:
        one = s.select(*by, "row", "bucket", "cnt")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*by, "row", "bucket").agg(F.sum("cnt").alias("cnt"))


def totals(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """total of each group."""
    return state.where(F.col("row") == TOTAL).select(*by, F.col("cnt").alias("total"))


def counters(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, row, bucket, cnt and the group's total beside each counter."""
    return _joined(state.where(F.col("row") != TOTAL), totals(state, by), by).select(*by, "row", "bucket", "cnt", "total")


def estimate(state: DataFrame, probes: DataFrame, item: str, config: Config, by: Sequence[str] = ()) -> DataFrame:
    """probes with estimate, lower_bound and upper_bound: the least of an item's counters, untouched ones being 0.

    lower_bound equals the estimate by convention; it is no guarantee. upper_bound adds total * e / buckets.
    probes holds the group columns and the item; items that repeat are looked up once.
    """
    asked = probes.select(*by, F.col(item).alias("__item")).where("__item is not null").distinct()
    cells = placed(asked, "__item", config, [*by, "__item"])
    right = state.select(*[F.col(c).alias(f"__r_{c}") for c in by], F.col("row").alias("__row"), F.col("bucket").alias("__bucket"), "cnt")
    on = [cells["row"] == right["__row"], cells["bucket"] == right["__bucket"], *[cells[c].eqNullSafe(right[f"__r_{c}"]) for c in by]]
    found = cells.join(right, on, "left").groupBy(*by, "__item").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))
    found = _joined(found, totals(state, by), by)
    upper = F.col("estimate") + F.floor(F.coalesce("total", F.lit(0)) * F.lit(config.relative_error)).cast("long")
    return found.select(*by, F.col("__item").alias(item), "estimate", F.col("estimate").alias("lower_bound"), upper.alias("upper_bound"))


def halve(state: DataFrame) -> DataFrame:
    """All counters and totals halved, rounding down; for counters that are never negative."""
    return state.withColumn("cnt", F.shiftright("cnt", 1))


def decay(state: DataFrame, factor: float) -> DataFrame:
    """All counters and totals times factor in (0, 1], cut to integers."""
    if not 0 < factor <= 1:
        raise SketchArgumentError("the decay factor must be in (0, 1]", decay=factor)
    return state.withColumn("cnt", F.floor(F.col("cnt") * F.lit(float(factor))).cast("long"))


def total_weight(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """total_weight and is_empty of each group."""
    rows = state.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("row") == TOTAL, F.col("cnt"))), F.lit(0)).alias("total_weight"))
    return rows.withColumn("is_empty", F.col("total_weight") == 0)
