"""The hashes that summaries are made of, as Column expressions, and the encodings of what is hashed.

BIGINT keys are hashed inside whole-stage code generation. The 64-bit products wrap around, which ANSI
mode forbids, so each step is analysed with ANSI off; the mode is kept in the analysed plan and the
session's own setting is put back before anything runs. Steps are separate projections: as one nested
expression the plan would double with each step.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SketchArgumentError

DEFAULT_SEED = 9001

# The multipliers and increments of MurmurHash3 x64 128 and of XXH64.
M_C1, M_C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
M_F1, M_F2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
M_A1, M_A2 = 0x52DCE729, 0x38495AB5
X_P1, X_P2, X_P3, X_P4, X_P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def signed(x: int) -> int:
    """The two's complement BIGINT with the low 64 bits of x."""
    x &= 2**64 - 1
    return x - 2**64 if x >= 2**63 else x


def _lit(x: int) -> Column:
    return F.lit(signed(x)).cast("long")


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Expressions analysed inside use wrapping 64-bit arithmetic."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _rotl(c: Column, n: int) -> Column:
    return F.shiftleft(c, n).bitwiseOR(F.shiftrightunsigned(c, 64 - n))


def _xor_shift(c: Column, n: int) -> Column:
    return c.bitwiseXOR(F.shiftrightunsigned(c, n))


def with_murmur3(df: DataFrame, key: str, h1: str = "h1", h2: str = "h2", seed: int = DEFAULT_SEED) -> DataFrame:
    """df with the two halves of MurmurHash3 x64 128 of the 8 little-endian bytes of a BIGINT column; null keys give null."""
    k, a, b = "__k", h1, h2
    with wrapping(df.sparkSession):
        df = df.withColumn(k, F.col(key).cast("long") * _lit(M_C1))
        df = df.withColumn(k, _rotl(F.col(k), 31) * _lit(M_C2))
        df = df.withColumns({a: F.col(k).bitwiseXOR(_lit(seed)).bitwiseXOR(_lit(8)), b: F.when(F.col(k).isNotNull(), _lit(seed ^ 8))})
        df = df.withColumn(a, F.col(a) + F.col(b)).drop(k)
        df = df.withColumn(b, F.col(b) + F.col(a))
        for multiplier in (M_F1, M_F2):
            df = df.withColumns({c: _xor_shift(F.col(c), 33) * _lit(multiplier) for c in (a, b)})
        df = df.withColumns({c: _xor_shift(F.col(c), 33) for c in (a, b)})
        df = df.withColumn(a, F.col(a) + F.col(b))
        return df.withColumn(b, F.col(b) + F.col(a))


def with_xxh64(df: DataFrame, key: str, out: str, seed: int | str = DEFAULT_SEED) -> DataFrame:
    """df with XXH64 of the 8 little-endian bytes of a BIGINT column; seed is a number or the name of a column."""
    start = F.col(seed) if isinstance(seed, str) else _lit(seed)
    with wrapping(df.sparkSession):
        df = df.withColumn("__x", F.col(key).cast("long") * _lit(X_P2))
        df = df.withColumn("__x", _rotl(F.col("__x"), 31) * _lit(X_P1))
        df = df.withColumn(out, (start + _lit(X_P5) + _lit(8)).bitwiseXOR(F.col("__x"))).drop("__x")
        df = df.withColumn(out, _rotl(F.col(out), 27) * _lit(X_P1) + _lit(X_P4))
        df = df.withColumn(out, _xor_shift(F.col(out), 33) * _lit(X_P2))
        df = df.withColumn(out, _xor_shift(F.col(out), 29) * _lit(X_P3))
        return df.withColumn(out, _xor_shift(F.col(out), 32))


def murmur3_bytes(data: bytes, seed: int = DEFAULT_SEED) -> tuple[int, int]:
    """MurmurHash3 x64 128 of any bytes, as two unsigned numbers."""
    mask = 2**64 - 1

    def rotl(x: int, n: int) -> int:
        return ((x << n) | (x >> (64 - n))) & mask

    def scramble(k: int, first: int, turn: int, second: int) -> int:
        return rotl(k * first & mask, turn) * second & mask

    def finish(h: int) -> int:
        for multiplier in (M_F1, M_F2):
            h = (h ^ (h >> 33)) * multiplier & mask
        return h ^ (h >> 33)

    a = b = seed & mask
    whole = len(data) // 16 * 16
    for x, y in struct.iter_unpack("<QQ", data[:whole]):
        a = (rotl(a ^ scramble(x, M_C1, 31, M_C2), 27) + b) * 5 + M_A1 & mask
        b = (rotl(b ^ scramble(y, M_C2, 33, M_C1), 31) + a) * 5 + M_A2 & mask
    tail = data[whole:]
    if len(tail) > 8:
        b ^= scramble(int.from_bytes(tail[8:], "little"), M_C2, 33, M_C1)
    if tail:
        a ^= scramble(int.from_bytes(tail[:8], "little"), M_C1, 31, M_C2)
    a, b = a ^ len(data), b ^ len(data)
    a = a + b & mask
    b = finish(b + a & mask)
    a = finish(a)
    a = a + b & mask
    return a, b + a & mask


def murmur3_many(values: list[bytes], seed: int = DEFAULT_SEED) -> np.ndarray:
    """murmur3_bytes of each value, as rows of two signed numbers; values of one number of 16-byte blocks are hashed together."""
    out = np.empty((len(values), 2), np.int64)
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    blocks = lengths // 16
    order = np.argsort(blocks, kind="stable")
    cuts = np.flatnonzero(np.diff(blocks[order])) + 1
    with np.errstate(over="ignore"):
        for rows in np.split(order, cuts) if len(values) else ():
            whole = int(blocks[rows[0]])
            padded = b"".join(values[i].ljust(16 * whole + 16, b"\0") for i in rows)
            words = np.frombuffer(padded, "<u8").reshape(len(rows), 2 * whole + 2)
            a = np.full(len(rows), seed & (2**64 - 1), np.uint64)
            b = a.copy()
            for k in range(whole):
                a = (_turn(a ^ _scrambled(words[:, 2 * k], M_C1, 31, M_C2), 27) + b) * np.uint64(5) + np.uint64(M_A1)
                b = (_turn(b ^ _scrambled(words[:, 2 * k + 1], M_C2, 33, M_C1), 31) + a) * np.uint64(5) + np.uint64(M_A2)
            size = lengths[rows].astype(np.uint64)  # the tail is padded with zeros, which scramble to zero
            a = a ^ _scrambled(words[:, -2], M_C1, 31, M_C2) ^ size
            b = b ^ _scrambled(words[:, -1], M_C2, 33, M_C1) ^ size
            a = a + b
            b = b + a
            a, b = _finished(a), _finished(b)
            a = a + b
            out[rows, 0], out[rows, 1] = a.view(np.int64), (b + a).view(np.int64)
    return out


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def _scrambled(x: np.ndarray, first: int, turn: int, second: int) -> np.ndarray:
    return _turn(x * np.uint64(first), turn) * np.uint64(second)


def _finished(x: np.ndarray) -> np.ndarray:
    for multiplier in (M_F1, M_F2):
        x = (x ^ x >> np.uint64(33)) * np.uint64(multiplier)
    return x ^ x >> np.uint64(33)


def with_murmur3_bytes(df: DataFrame, key: str, h1: str = "h1", h2: str = "h2", seed: int = DEFAULT_SEED, skip_empty: bool = True) -> DataFrame:
    """The same for the raw bytes of a STRING or BINARY column, in Arrow batches whose distinct values are hashed together. Empty values give null if skip_empty."""

    @F.pandas_udf("h1 long, h2 long")
    def run(values: pd.Series) -> pd.DataFrame:
        codes, distinct = pd.factorize(values.map(bytes, na_action="ignore"))
        found = np.vstack([murmur3_many(list(distinct), seed), np.zeros((1, 2), np.int64)])[codes]  # nulls have the code -1
        missing = (codes < 0) | (np.array([not v for v in distinct] + [False], bool)[codes] if skip_empty else False)
        return pd.DataFrame({name: pd.arrays.IntegerArray(found[:, k].copy(), missing.copy()) for k, name in enumerate(("h1", "h2"))})

    df = df.withColumn("__h", run(F.col(key).cast("binary")))
    return df.withColumns({h1: F.col("__h.h1"), h2: F.col("__h.h2")}).drop("__h")


def with_hash(df: DataFrame, key: str, h1: str = "h1", h2: str = "h2", seed: int = DEFAULT_SEED, skip_empty: bool = True) -> DataFrame:
    """with_murmur3 or with_murmur3_bytes by the column's type: integers widen to BIGINT, floats are made canonical."""
    kind = df.schema[key].dataType.typeName()
    if kind in ("string", "binary", "char", "varchar"):
        return with_murmur3_bytes(df, key, h1, h2, seed, skip_empty)
    if kind in ("float", "double"):
        df = df.withColumn("__bits", canonical_bits(F.col(key)))
        return with_murmur3(df, "__bits", h1, h2, seed).drop("__bits")
    if kind in ("byte", "short", "integer", "long"):
        return with_murmur3(df, key, h1, h2, seed)
    raise SketchArgumentError(f"keys of type {kind} can't be hashed; cast {key} to BIGINT, DOUBLE, STRING or BINARY")


def with_counted_hash(df: DataFrame, key: str, h1: str = "h1", h2: str = "h2", seed: int = DEFAULT_SEED) -> DataFrame:
    """with_hash without the rows whose key doesn't count. The filter is on the key, so that it stays short: one on the hash would be
    pushed below the steps that compute it, with the whole hash written out."""
    kind = df.schema[key].dataType.typeName()
    counts = F.octet_length(key) > 0 if kind in ("string", "binary", "char", "varchar") else F.col(key).isNotNull()
    return with_hash(df.where(counts), key, h1, h2, seed)


def sign_extended(c: Column, bits: int = 64) -> Column:
    """An integer of `bits` bits reinterpreted as signed, then widened: an unsigned 32-bit 2^32-1 becomes -1."""
    if bits == 64:
        return c.cast("long")
    wide = c.cast("long").bitwiseAND((1 << bits) - 1)
    return F.when(wide >= 1 << (bits - 1), wide - (1 << bits)).otherwise(wide)


def natural_extended(c: Column) -> Column:
    """An integer widened with its own signedness."""
    return c.cast("long")


def canonical_bits(c: Column) -> Column:
    """The IEEE bits of a float as BIGINT, with one NaN and one zero."""

    @F.pandas_udf("long")
    def bits(values: pd.Series) -> pd.Series:
        x = values.to_numpy(dtype="float64", na_value=np.nan) + 0.0
        return pd.Series(np.where(np.isnan(x), np.int64(0x7FF8000000000000), x.view(np.int64)))

    return F.when(c.isNotNull(), bits(c.cast("double")))


def seed_hash(seed: int) -> int:
    """The 16 bits that stand for a seed in stored summaries; a seed that gives 0 can't be used."""
    short = murmur3_bytes(struct.pack("<Q", seed & (2**64 - 1)), 0)[0] & 0xFFFF
    if short == 0:
        raise SketchArgumentError(f"the seed {seed} has the hash 0; choose another")
    return short


def leading_zeros(c: Column) -> Column:
    """Of the 64 bits of a BIGINT."""
    return F.when(c < 0, 0).when(c == 0, 64).otherwise(F.lit(64) - F.length(F.bin(c)))


def unsigned_mod(c: Column, n: int) -> Column:
    """The 64 bits of c as an unsigned number, mod n (n < 2^61)."""
    half = F.shiftrightunsigned(c, 1) % n
    return (half * 2 + c.bitwiseAND(1)) % n


# --- the same for DuckDB, for the oracles ---

_U = "::UHUGEINT"
_MASK = f"18446744073709551615{_U}"


def _sql_mul(x: str, c: int) -> str:
    return f"(({x} * {c}{_U}) & {_MASK})"


def _sql_rotl(x: str, n: int) -> str:
    return f"((({x} << {n}) & {_MASK}) | ({x} >> {64 - n}))"


def _sql_shift(x: str, n: int) -> str:
    return f"xor({x}, {x} >> {n})"


def murmur3_sql(source: str, key: str, columns: str, name: str = "m", seed: int = DEFAULT_SEED) -> str:
    """CTEs (without WITH) ending in `name`: `columns` of source, and h1, h2 as UHUGEINT, of a BIGINT key."""
    unsigned = f"(CASE WHEN {key} < 0 THEN ({key}::HUGEINT + 18446744073709551616::HUGEINT)::UHUGEINT ELSE {key}{_U} END)"
    own = [c.split(" AS ")[-1].strip() for c in columns.split(",")] if columns else []
    kept = ", ".join([*own, ""]) if own else ""
    first = f"{columns}, " if columns else ""
    ctes = [f"{name}0 AS (SELECT {first}{_sql_mul(unsigned, M_C1)} AS k FROM {source} WHERE {key} IS NOT NULL)"]
    steps = [
        f"{_sql_mul(_sql_rotl('k', 31), M_C2)} AS k",
        f"xor(k, {seed ^ 8}{_U}) AS a, {seed ^ 8}{_U} AS b",
        f"((a + b) & {_MASK}) AS a, b",
        f"a, ((b + a) & {_MASK}) AS b",
        f"{_sql_mul(_sql_shift('a', 33), M_F1)} AS a, {_sql_mul(_sql_shift('b', 33), M_F1)} AS b",
        f"{_sql_mul(_sql_shift('a', 33), M_F2)} AS a, {_sql_mul(_sql_shift('b', 33), M_F2)} AS b",
        f"{_sql_shift('a', 33)} AS a, {_sql_shift('b', 33)} AS b",
        f"((a + b) & {_MASK}) AS a, b",
        f"a AS h1, ((b + a) & {_MASK}) AS h2",
    ]
    for i, step in enumerate(steps, 1):
        last = i == len(steps)
        ctes.append(f"{name if last else f'{name}{i}'} AS (SELECT {kept}{step} FROM {name}{i - 1})")
    return ",\n".join(ctes)


def xxh64_sql(source: str, key: str, columns: str, out: str, name: str, seed: int | str = DEFAULT_SEED) -> str:
    """CTEs ending in `name`: `columns` of source and XXH64 of a BIGINT (or, as UHUGEINT, unsigned) key as `out`."""
    start = seed if isinstance(seed, str) else f"{seed}{_U}"
    kept = f"{columns}, " if columns else ""
    own = ", ".join(c.split(" AS ")[-1].strip() for c in columns.split(",")) + ", " if columns else ""
    ctes = [f"{name}0 AS (SELECT {kept}{_sql_mul(f'({key}){_U}', X_P2)} AS x, (({start} + {X_P5}{_U} + 8{_U}) & {_MASK}) AS s FROM {source})"]
    steps = [
        f"{_sql_mul(_sql_rotl('x', 31), X_P1)} AS x, s",
        "xor(s, x) AS x",
        f"(({_sql_mul(_sql_rotl('x', 27), X_P1)} + {X_P4}{_U}) & {_MASK}) AS x",
        f"{_sql_mul(_sql_shift('x', 33), X_P2)} AS x",
        f"{_sql_mul(_sql_shift('x', 29), X_P3)} AS x",
        f"{_sql_shift('x', 32)} AS {out}",
    ]
    for i, step in enumerate(steps, 1):
        ctes.append(f"{name if i == len(steps) else f'{name}{i}'} AS (SELECT {own}{step} FROM {name}{i - 1})")
    return ",\n".join(ctes)
