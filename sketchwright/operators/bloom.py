"""Membership: bit sets in which an item sets the bits its two hashes name.

State: `by` columns, word INT, bits BIGINT for the words that have a bit set.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SketchArgumentError
from ..functions.hashing import DEFAULT_SEED, canonical_bits, signed, unsigned_mod, with_xxh64, wrapping

MAX_BITS = (2**31 - 33) * 64
MAX_HASHES = 32767


def suggest_num_bits(max_items: int, fpp: float) -> int:
    if max_items <= 0 or not 0 < fpp <= 1:
        raise SketchArgumentError("sizing needs items and a false-positive probability in (0, 1]", max_items=max_items, fpp=fpp)
    return min(MAX_BITS, max(64, math.ceil(-max_items * math.log(fpp) / math.log(2) ** 2)))


def suggest_num_hashes(max_items: int, num_bits: int) -> int:
    if max_items <= 0 or num_bits <= 0:
        raise SketchArgumentError("sizing needs items and bits", max_items=max_items, num_bits=num_bits)
    return min(MAX_HASHES, max(1, math.ceil(num_bits / max_items * math.log(2))))


def suggest_num_hashes_from_fpp(fpp: float) -> int:
    if not 0 < fpp <= 1:
        raise SketchArgumentError("the false-positive probability must be in (0, 1]", fpp=fpp)
    return min(MAX_HASHES, max(1, math.ceil(-math.log2(fpp))))


@dataclass(frozen=True)
class Config:
    num_bits: int
    num_hashes: int
    seed: int = DEFAULT_SEED

    def __post_init__(self) -> None:
        if not 0 < self.num_bits <= MAX_BITS or not 0 < self.num_hashes <= MAX_HASHES:
            raise SketchArgumentError("bits or hashes out of range", num_bits=self.num_bits, num_hashes=self.num_hashes)
        object.__setattr__(self, "num_bits", -(-self.num_bits // 64) * 64)

    @classmethod
    def with_accuracy(cls, max_items: int, fpp: float, seed: int = DEFAULT_SEED) -> Config:
        bits = suggest_num_bits(max_items, fpp)
        return cls(bits, suggest_num_hashes(max_items, bits), seed)

    @property
    def words(self) -> int:
        return self.num_bits // 64

    def is_compatible(self, other: Config) -> bool:
        return self == other


def _hashed(df: DataFrame, item: str, config: Config) -> DataFrame:
    kind = df.schema[item].dataType.typeName()
    if kind in ("string", "binary"):
        import xxhash

        seed = config.seed

        @F.pandas_udf("h0 long, h1 long")
        def run(values: pd.Series) -> pd.DataFrame:
            first = [xxhash.xxh64_intdigest(bytes(v), seed) for v in values]
            second = [xxhash.xxh64_intdigest(bytes(v), h) for v, h in zip(values, first)]
            return pd.DataFrame({"h0": [signed(h) for h in first], "h1": [signed(h) for h in second]}, dtype="int64")

        df = df.withColumn("__x", run(F.col(item).cast("binary")))
        return df.withColumns({"__h0": F.col("__x.h0"), "__h1": F.col("__x.h1")}).drop("__x")
    if kind in ("float", "double"):
        df = df.withColumn("__bits", canonical_bits(F.col(item)))
        return with_xxh64(with_xxh64(df, "__bits", "__h0", config.seed), "__bits", "__h1", "__h0").drop("__bits")
    if kind not in ("byte", "short", "integer", "long"):
        raise SketchArgumentError(f"items of type {kind} can't be hashed")
    return with_xxh64(with_xxh64(df, item, "__h0", config.seed), item, "__h1", "__h0")


def placed(df: DataFrame, item: str, config: Config, carried: Sequence[str]) -> DataFrame:
    """carried, word, bit: the bits of each item, a row each."""
    out = _hashed(df, item, config).select(*carried, "__h0", "__h1", F.explode(F.sequence(F.lit(1), F.lit(config.num_hashes))).alias("__i"))
    with wrapping(df.sparkSession):
        out = out.withColumn("__p", F.shiftrightunsigned(F.col("__h0") + F.col("__i") * F.col("__h1"), 1))
    place = unsigned_mod(F.col("__p"), config.num_bits)
    return out.withColumn("__p", place).select(*carried, F.shiftright("__p", 6).cast("int").alias("word"), F.col("__p").bitwiseAND(63).cast("int").alias("bit"))


def build(df: DataFrame, item: str, config: Config, by: Sequence[str] = ()) -> DataFrame:
    """The filter of the items of each group; null items are left out. Items are made distinct before they are hashed."""
    items = df.select(*by, F.col(item).alias("__item")).where("__item is not null").distinct()
    cells = placed(items, "__item", config, by)
    return cells.groupBy(*by, "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def contains(state: DataFrame, probes: DataFrame, item: str, config: Config, by: Sequence[str] = ()) -> DataFrame:
    """The distinct probed items with might_contain: false is certain. An empty filter contains nothing."""
    asked = probes.select(*by, F.col(item).alias("__item")).where("__item is not null").distinct()
    cells = placed(asked, "__item", config, [*by, "__item"])
    right = state.select(*[F.col(c).alias(f"__r_{c}") for c in by], F.col("word").alias("__word"), "bits")
    on = [cells["word"] == right["__word"], *[cells[c].eqNullSafe(right[f"__r_{c}"]) for c in by]]
    hit = F.coalesce(F.expr("(shiftrightunsigned(bits, bit) & 1) = 1"), F.lit(False))
    found = cells.join(right, on, "left").groupBy(*by, "__item").agg(F.bool_and(hit).alias("might_contain"))
    return found.select(*by, F.col("__item").alias(item), "might_contain")


def contains_and_insert(df: DataFrame, item: str, config: Config, order: str, by: Sequence[str] = ()) -> DataFrame:
    """df with was_there: whether the filter of the rows before, by `order`, contained the item.

    A bit is set before a row if an earlier row sets it, so a row's answer is whether the earliest row of
    each of its bits comes before it: one minimum for each bit instead of a sequential scan.
    """
    rows = df.withColumn("__item", F.col(item)).where(F.col(item).isNotNull())
    firsts = rows.groupBy(*by, "__item").agg(F.min(order).alias("__first"))
    cells = placed(firsts, "__item", config, [*by, "__item", "__first"])
    earliest = cells.groupBy(*by, "word", "bit").agg(F.min("__first").alias("__set"))
    keys = [*by, "word", "bit"]
    right = earliest.select(*[F.col(c).alias(f"__r_{c}") for c in keys], "__set")
    known = cells.join(right, [cells[c].eqNullSafe(right[f"__r_{c}"]) for c in keys]).groupBy(*by, "__item").agg(F.max("__set").alias("__all"))
    keys = [*by, "__item"]
    right = known.select(*[F.col(c).alias(f"__r_{c}") for c in keys], "__all")
    joined = rows.join(right, [rows[c].eqNullSafe(right[f"__r_{c}"]) for c in keys])
    return joined.select(*df.columns, (F.col("__all") < F.col(order)).alias("was_there"))


def union(*states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Items of any filter; a coarser `by` rolls groups up."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy(*by, "word").agg(F.bit_or("bits").alias("bits"))


def intersect(*states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bits that all filters have."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    both = rows.groupBy(*by, "word").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("__n"))
    return both.where((F.col("__n") == len(states)) & (F.col("bits") != 0)).drop("__n")


def invert(state: DataFrame, config: Config, by: Sequence[str] = ()) -> DataFrame:
    """All bits flipped; groups that have no bit set are not in the state and stay out."""
    spark: SparkSession = state.sparkSession
    words = spark.range(config.words).select(F.col("id").cast("int").alias("__w"))
    groups = state.select(*by).distinct() if by else spark.range(1).select()
    dense = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(config.words - 1))).alias("__w")) if by else words
    right = state.select(*[F.col(c).alias(f"__r_{c}") for c in by], "word", "bits")
    on = [dense["__w"] == right["word"], *[dense[c].eqNullSafe(right[f"__r_{c}"]) for c in by]]
    out = dense.join(right, on, "left").select(*by, F.col("__w").alias("word"), F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long"))).alias("bits"))
    return out.where("bits <> 0")


def statistics(state: DataFrame, config: Config, by: Sequence[str] = ()) -> DataFrame:
    """bits_used, capacity, num_hashes, load_factor, estimated_fpp and is_empty of each group."""
    rows = state.groupBy(*by).agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("bits_used"))
    load = F.col("bits_used") / F.lit(float(config.num_bits))
    return rows.select(
        *by,
        "bits_used",
        F.lit(config.num_bits).cast("long").alias("capacity"),
        F.lit(config.num_hashes).alias("num_hashes"),
        load.alias("load_factor"),
        F.pow(load, F.lit(float(config.num_hashes))).alias("estimated_fpp"),
        (F.col("bits_used") == 0).alias("is_empty"),
    )


