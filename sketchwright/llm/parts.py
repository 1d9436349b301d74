"""Documents dealt by ranges of their ids, and polynomial hashes over arrays, for the two substring operators."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_text, splitters, whole, with_range

#: Units of a part at least (they grow with the input), and at most. A text has a unit for each UNIT bytes begun. A part holds whole documents; it is the unit of a Python task.
PART_UNITS, MOST_UNITS, UNIT = 1000, 8000, 8192


def dealt(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, int]:
    """(part int, doc_id long, bytes binary) and the number of parts. Parts ascend with the id; null ids are in the last.

    Parts are cut by the bytes of their texts: at most 64 MB, or one document if that is larger.
    """
    slim = docs.select(whole(key).alias("doc_id"), plain_text(F.col(text)).cast("binary").alias("bytes"))
    units = 1 + F.floor(F.octet_length("bytes") / UNIT)
    cuts = splitters(slim.where("doc_id is not null"), "doc_id", units, PART_UNITS, MOST_UNITS)
    placed = with_range(slim, "doc_id", cuts, "part")
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.col("part"))
    return placed.select(part.cast("int").alias("part"), "doc_id", "bytes"), len(cuts) + 2


def buckets_for(parts: int) -> int:
    """Ranges of hash values: a power of two that grows with the parts, so a range's share of a part stays about as large."""
    return 1 << max(4, (2 * parts - 1).bit_length())


def in_order(table: pa.Table) -> tuple[pa.Array, list[bytes]]:
    """Ids and texts of a part by ascending id, nulls last, equal ids by text: the same order in every pass."""
    table = table.combine_chunks()
    order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("bytes", "ascending")])
    table = table.take(order)
    return table.column("doc_id").combine_chunks(), table.column("bytes").to_pylist()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        p = np.full(length, b, np.uint64)
        p[0] = 1
        return np.cumprod(p, dtype=np.uint64)

    return run(base), run(pow(base, -1, 1 << 64))


class Polynomial:
    """Rabin-Karp hashes mod 2^64 of all slices of an array of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        power, self.inverse = _powers(base, 1 << max(10, n.bit_length()))
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power[:n], out=self.prefix[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[end] - self.prefix[start]) * self.inverse[start])


#: Random values for each byte, and odd bases for bytes and words, of two independent hashes.
BYTE_VALUES, OTHER_VALUES = np.random.default_rng(11).integers(0, 2**64, (2, 256), dtype=np.uint64)
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
OTHER_BYTE_BASE, OTHER_WORD_BASE = 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F


def is_pair_in(a: np.ndarray, b: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Whether each (a, b) is a row of pairs."""
    both = np.concatenate([np.stack([a, b], axis=1), pairs])
    order = np.lexsort((np.arange(len(both)) < len(a), both[:, 1], both[:, 0]))  # of equal ones those of pairs first
    ranked = both[order]
    starts = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)])[: len(ranked)]
    found = np.zeros(len(both), bool)
    found[order] = (order >= len(a))[np.flatnonzero(starts)][np.cumsum(starts) - 1] if len(both) else False
    return found[: len(a)]
