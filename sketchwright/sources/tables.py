"""State tables: Parquet in and out, and groups as one BINARY value each."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import DEFAULT_SEED
from ..operators import bloom, countmin, cpc, theta
from ..operators.tdigest import DEFAULT_K
from . import codecs


def save(state: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """A state as Parquet; partitioned by group columns, a reader of some groups skips the others' files."""
    state.write.mode(mode).partitionBy(*partition_by).parquet(path) if partition_by else state.write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def theta_to_binary(state: DataFrame, by: Sequence[str] = (), compressed: bool = False, seed: int = DEFAULT_SEED) -> DataFrame:
    """by, sketch BINARY: readable by Spark's theta_* functions."""
    encode = codecs.encode_theta_compressed if compressed else codecs.encode_theta

    @F.pandas_udf("binary")
    def pack(hashes: pd.Series, limit: pd.Series, empty: pd.Series) -> pd.Series:
        return pd.Series([encode([int(x) for x in h], int(t), bool(e), seed=seed) for h, t, e in zip(hashes, limit, empty)])

    rows = theta.compact(state, by)
    return rows.select(*by, pack("hashes", "theta", "is_empty").alias("sketch"))


def theta_from_binary(df: DataFrame, sketch: str = "sketch", by: Sequence[str] = (), lg_k: int = theta.DEFAULT_LG_K, seed: int = DEFAULT_SEED) -> DataFrame:
    """The state of stored samples, a row a group in; null values are left out."""

    @F.pandas_udf("hashes array<long>, theta long, is_empty boolean")
    def unpack(values: pd.Series) -> pd.DataFrame:
        found = [codecs.decode_theta(bytes(v), seed) for v in values]
        return pd.DataFrame({"hashes": [f.hashes for f in found], "theta": [f.theta for f in found], "is_empty": [f.empty for f in found]})

    rows = df.where(F.col(sketch).isNotNull()).withColumn("__s", unpack(sketch))
    return theta.expand(rows.select(*by, F.col("__s.hashes").alias("hashes"), F.col("__s.theta").alias("theta"), F.col("__s.is_empty").alias("is_empty"), F.lit(lg_k).alias("lg_k")), by)


def hll_from_binary(df: DataFrame, sketch: str = "sketch", by: Sequence[str] = ()) -> DataFrame:
    """Registers of stored sketches, whatever their register width; coupons of small ones are folded into registers."""

    @F.pandas_udf("lg_k int, slots array<int>, registers array<int>")
    def unpack(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            s = codecs.decode_hll(bytes(v))
            registers = s.registers if s.registers is not None else np.zeros(1 << s.lg_k, np.uint8)
            np.maximum.at(registers, s.packed & (1 << s.lg_k) - 1, (s.packed >> 26).astype(np.uint8))
            hit = np.flatnonzero(registers)
            rows.append((s.lg_k, hit.tolist(), registers[hit].astype(int).tolist()))
        return pd.DataFrame(rows, columns=["lg_k", "slots", "registers"])

    rows = df.where(F.col(sketch).isNotNull()).withColumn("__s", unpack(sketch))
    cells = rows.select(*by, F.col("__s.lg_k").alias("lg_k"), F.explode(F.arrays_zip("__s.slots", "__s.registers")).alias("__c"))
    return cells.select(*by, F.col("__c.slots").alias("slot"), F.col("__c.registers").alias("value"), "lg_k")


def hll_coupons_to_binary(rows: DataFrame, by: Sequence[str] = (), lg_k: int = 12) -> DataFrame:
    """by, sketch BINARY of small groups' coupons (slot26, value), kept one by one as a list or a set. Larger groups take
    4 bytes a coupon: they meet Python as arrays of packed coupons, never as objects."""

    @F.pandas_udf("binary")
    def pack(coupons: pd.Series) -> pd.Series:
        return pd.Series([codecs.encode_hll_packed(np.asarray(c, np.int32).view(np.uint32), lg_k) for c in coupons])

    fits = F.col("slot26").between(0, (1 << 26) - 1) & F.col("value").between(0, 63)
    coupon = F.when(fits, F.shiftleft(F.col("value").cast("int"), 26).bitwiseOR(F.col("slot26").cast("int"))).otherwise(F.raise_error(F.lit("a coupon is out of range")))
    groups = rows.select(*by, coupon.alias("__c")).distinct().groupBy(*by).agg(F.collect_list("__c").alias("__c"))
    return groups.select(*by, pack("__c").alias("sketch"))


def hll_coupons_from_binary(df: DataFrame, sketch: str = "sketch", by: Sequence[str] = ()) -> DataFrame:
    """by, slot26, value of stored lists and sets; summaries that have registers by now have no coupons."""

    @F.pandas_udf("array<int>")
    def unpack(values: pd.Series) -> pd.Series:  # takes nulls: a filter would be pushed below what makes the bytes, which would make them twice
        return pd.Series([None if v is None else codecs.decode_hll(bytes(v)).packed.view(np.int32) for v in values], dtype=object)

    rows = df.select(*by, F.explode(unpack(sketch)).alias("__c"))
    return rows.select(*by, F.col("__c").bitwiseAND((1 << 26) - 1).alias("slot26"), F.shiftrightunsigned("__c", 26).alias("value"))


def tuple_to_binary(state: DataFrame, kind: str, by: Sequence[str] = (), seed: int = DEFAULT_SEED) -> DataFrame:
    """by, sketch BINARY; kind names the stored type of the summaries: u32, i32, u64, i64, f32 or f64."""
    codec = codecs.summary_codec(kind)
    number = float if kind[0] == "f" else int

    @F.pandas_udf("binary")
    def pack(hashes: pd.Series, summaries: pd.Series, limit: pd.Series, empty: pd.Series) -> pd.Series:
        return pd.Series([codecs.encode_tuple([(int(a), number(b)) for a, b in zip(h, x)], codec, int(t), bool(e), seed=seed) for h, x, t, e in zip(hashes, summaries, limit, empty)])

    there = F.when(F.col("hash").isNotNull(), F.struct("hash", "summary"))
    rows = state.groupBy(*by).agg(F.min("theta").alias("theta"), F.min("is_empty").alias("is_empty"), F.sort_array(F.collect_list(there)).alias("e"))
    return rows.select(*by, pack("e.hash", "e.summary", "theta", "is_empty").alias("sketch"))


def tuple_from_binary(df: DataFrame, kind: str, sketch: str = "sketch", by: Sequence[str] = (), lg_k: int = theta.DEFAULT_LG_K, seed: int = DEFAULT_SEED) -> DataFrame:
    codec = codecs.summary_codec(kind)
    value = "double" if kind[0] == "f" else "long"

    @F.pandas_udf(f"hashes array<long>, summaries array<{value}>, theta long, is_empty boolean")
    def unpack(values: pd.Series) -> pd.DataFrame:
        found = [codecs.decode_tuple(bytes(v), codec, seed) for v in values]
        return pd.DataFrame({"hashes": [[h for h, _ in e] for _, e in found], "summaries": [[x for _, x in e] for _, e in found], "theta": [t.theta for t, _ in found], "is_empty": [t.empty for t, _ in found]})

    rows = df.where(F.col(sketch).isNotNull()).withColumn("__s", unpack(sketch))
    cells = rows.select(*by, F.explode_outer(F.arrays_zip("__s.hashes", "__s.summaries")).alias("__c"), F.col("__s.theta").alias("theta"), F.col("__s.is_empty").alias("is_empty"))
    return cells.select(*by, F.col("__c.hashes").alias("hash"), "theta", "is_empty", F.lit(lg_k).alias("lg_k"), F.col("__c.summaries").alias("summary"))


def bloom_to_binary(state: DataFrame, config: bloom.Config, by: Sequence[str] = ()) -> DataFrame:
    @F.pandas_udf("binary")
    def pack(words: pd.Series, bits: pd.Series) -> pd.Series:
        out = []
        for w, b in zip(words, bits):
            dense = np.zeros(config.words, np.int64)
            dense[np.asarray(w, np.int64)] = np.asarray(b, np.int64)
            out.append(codecs.encode_bloom(dense.view(np.uint64), config.num_hashes, config.seed))
        return pd.Series(out)

    rows = state.groupBy(*by).agg(F.collect_list(F.struct("word", "bits")).alias("w"))
    return rows.select(*by, pack("w.word", "w.bits").alias("sketch"))


def bloom_from_binary(df: DataFrame, sketch: str = "sketch", by: Sequence[str] = ()) -> DataFrame:
    @F.pandas_udf("words array<int>, bits array<long>")
    def unpack(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            dense = codecs.decode_bloom(bytes(v))[0]
            hit = np.flatnonzero(dense)
            rows.append((hit.tolist(), dense[hit].view(np.int64).tolist()))
        return pd.DataFrame(rows, columns=["words", "bits"])

    rows = df.where(F.col(sketch).isNotNull()).withColumn("__s", unpack(sketch))
    cells = rows.select(*by, F.explode(F.arrays_zip("__s.words", "__s.bits")).alias("__c"))
    return cells.select(*by, F.col("__c.words").alias("word"), F.col("__c.bits").alias("bits"))


def countmin_to_binary(state: DataFrame, config: countmin.Config, by: Sequence[str] = ()) -> DataFrame:
    @F.pandas_udf("binary")
    def pack(row: pd.Series, bucket: pd.Series, cnt: pd.Series, total: pd.Series) -> pd.Series:
        out = []
        for r, b, c, t in zip(row, bucket, cnt, total):
            dense = np.zeros((config.num_hashes, config.num_buckets), np.int64)
            dense[np.asarray(r, np.int64), np.asarray(b, np.int64)] = np.asarray(c, np.int64)
            out.append(codecs.encode_countmin(dense, 0 if pd.isna(t) else int(t), config.seed))
        return pd.Series(out)

    total = F.col("row") == countmin.TOTAL
    cells = F.collect_list(F.when(~total, F.struct("row", "bucket", "cnt")))
    rows = state.groupBy(*by).agg(cells.alias("c"), F.max(F.when(total, F.col("cnt"))).alias("total"))
    return rows.select(*by, pack("c.row", "c.bucket", "c.cnt", "total").alias("sketch"))


def countmin_from_binary(df: DataFrame, sketch: str = "sketch", by: Sequence[str] = (), seed: int = DEFAULT_SEED, kind: str = "i64") -> DataFrame:
    @F.pandas_udf("rows array<int>, buckets array<int>, counts array<long>")
    def unpack(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            dense, total = codecs.decode_countmin(bytes(v), seed, kind)
            r, b = np.nonzero(dense)
            rows.append(([countmin.TOTAL, *r.tolist()], [0, *b.tolist()], [total, *dense[r, b].tolist()]))
        return pd.DataFrame(rows, columns=["rows", "buckets", "counts"])

    found = df.where(F.col(sketch).isNotNull()).withColumn("__s", unpack(sketch))
    cells = found.select(*by, F.explode(F.arrays_zip("__s.rows", "__s.buckets", "__s.counts")).alias("__c"))
    return cells.select(*by, F.col("__c.rows").alias("row"), F.col("__c.buckets").alias("bucket"), F.col("__c.counts").alias("cnt"))


def frequent_to_binary(state: DataFrame, lg_max: int, by: Sequence[str] = (), kind: str = "i64") -> DataFrame:
    """kind: i64, u64 or string items."""
    own = str if kind == "string" else int

    @F.pandas_udf("binary")
    def pack(items: pd.Series, counts: pd.Series, weight: pd.Series, offset: pd.Series) -> pd.Series:
        return pd.Series([codecs.encode_frequent([(own(a), int(b)) for a, b in zip(i, c)], lg_max, int(w), int(o), kind) for i, c, w, o in zip(items, counts, weight, offset)])

    there = F.when(F.col("item").isNotNull(), F.struct("item", "lb"))
    rows = state.groupBy(*by).agg(F.sort_array(F.collect_list(there)).alias("e"), F.max("weight").alias("weight"), F.max("offset").alias("offset"))
    return rows.select(*by, pack("e.item", "e.lb", "weight", "offset").alias("sketch"))


def frequent_from_binary(df: DataFrame, sketch: str = "sketch", by: Sequence[str] = (), kind: str = "i64") -> DataFrame:
    value = "string" if kind == "string" else "long"

    @F.pandas_udf(f"items array<{value}>, counts array<long>, weight long, offset long")
    def unpack(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            items, _, weight, offset = codecs.decode_frequent(bytes(v), kind)
            rows.append(([None, *(i for i, _ in items)], [None, *(c for _, c in items)], weight, offset))
        return pd.DataFrame(rows, columns=["items", "counts", "weight", "offset"])

    found = df.where(F.col(sketch).isNotNull()).withColumn("__s", unpack(sketch))
    cells = found.select(*by, F.explode(F.arrays_zip("__s.items", "__s.counts")).alias("__c"), "__s")
    fact = F.col("__c.items").isNull()
    return cells.select(*by, F.col("__c.items").alias("item"), F.col("__c.counts").alias("lb"), F.when(fact, F.col("__s.offset")).alias("offset"), F.when(fact, F.col("__s.weight")).alias("weight"))


def tdigest_to_binary(state: DataFrame, by: Sequence[str] = (), k: int = DEFAULT_K) -> DataFrame:
    @F.pandas_udf("binary")
    def pack(low: pd.Series, high: pd.Series, means: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([codecs.encode_tdigest(k, a, b, [float(x) for x in m], [int(x) for x in w]) for a, b, m, w in zip(low, high, means, weights)])

    return state.select(*by, pack("min", "max", "means", "weights").alias("sketch"))


def tdigest_from_binary(df: DataFrame, sketch: str = "sketch", by: Sequence[str] = (), floats: bool = False) -> DataFrame:
    @F.pandas_udf("min double, max double, weight long, means array<double>, weights array<long>")
    def unpack(values: pd.Series) -> pd.DataFrame:
        found = [codecs.decode_tdigest(bytes(v), floats) for v in values]
        return pd.DataFrame([(a, b, sum(w), m, w) for _, a, b, m, w in found], columns=["min", "max", "weight", "means", "weights"])

    rows = df.where(F.col(sketch).isNotNull()).withColumn("__s", unpack(sketch))
    return rows.select(*by, "__s.min", "__s.max", "__s.weight", "__s.means", "__s.weights").where("weight > 0")


def cpc_from_binary(df: DataFrame, sketch: str = "sketch", by: Sequence[str] = (), num_std_dev: int = 2, seed: int = DEFAULT_SEED) -> DataFrame:
    """by, lg_k, num_coupons, is_empty, lower, estimate, upper from stored coupons, which stay packed."""

    @F.pandas_udf("lg_k int, num_coupons long, is_empty boolean, lower double, estimate double, upper double")
    def read(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            f = codecs.cpc_facts(bytes(v), seed)
            lower, value, upper = cpc.coupon_bounds(f.lg_k, f.num_coupons, num_std_dev, None if f.merged else f.hip)
            rows.append((f.lg_k, f.num_coupons, f.is_empty, lower, value, upper))
        return pd.DataFrame(rows, columns=["lg_k", "num_coupons", "is_empty", "lower", "estimate", "upper"])

    return df.where(F.col(sketch).isNotNull()).withColumn("__s", read(sketch)).select(*by, "__s.*")
