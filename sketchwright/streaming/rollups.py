"""Summaries over event-time windows of a stream, and state tables that late batches are merged into."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import hll


def windowed_registers(stream: DataFrame, ts: str, key: str, window: str, watermark: str, by: Sequence[str] = (), lg_k: int = hll.DEFAULT_LG_K) -> DataFrame:
    """window_start, by, slot, value, lg_k: registers of each window. State is at most 2^lg_k rows an open window and group."""
    rows = stream.withWatermark(ts, watermark)
    coupons = hll.coupons(rows, key, [*by, ts])
    slot = F.col("slot26").bitwiseAND((1 << hll.check_lg_k(lg_k)) - 1)
    found = coupons.groupBy(F.window(ts, window).alias("__w"), *by, slot.alias("slot")).agg(F.max("value").alias("value"))
    return found.select(F.col("__w.start").alias("window_start"), *by, "slot", "value", F.lit(lg_k).alias("lg_k"))


def windowed_theta(stream: DataFrame, ts: str, key: str, window: str, watermark: str, by: Sequence[str] = (), lg_k: int = 12) -> DataFrame:
    """window_start, by, sketch BINARY, estimate: the built-in sample of each window's keys, as one aggregate."""
    rows = stream.withWatermark(ts, watermark)
    found = rows.groupBy(F.window(ts, window).alias("__w"), *by).agg(F.theta_sketch_agg(key, lg_k).alias("sketch"))
    return found.select(F.col("__w.start").alias("window_start"), *by, "sketch", F.theta_sketch_estimate("sketch").alias("estimate"))


def merging_into(path: str, build: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: builds a batch's state and merges it into the newest version under path; late data is one more merge.

    Versions are named by the batch, so a batch that is run again replaces its own version and is not counted twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = build(batch)
        if number > 0:
            before = latest(spark, path, number - 1)
            if before is not None:
                state = merge(before, state)
        state.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return run


def replacing(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch in complete mode: the newest result as a version under path, written by the executors; latest() reads it."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return run


def latest(spark, path: str, number: int) -> DataFrame | None:
    """The state after batch `number`, or after the last one before it that is there."""
    while number >= 0:
        try:
            return spark.read.parquet(f"{path}/batch={number:012d}")
        except AnalysisException:
            number -= 1
    return None


