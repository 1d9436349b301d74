"""Quantiles, ranks, CDF and PMF by centroids that are small at the tails.

State: a row a group: min, max DOUBLE, weight BIGINT, means ARRAY<DOUBLE>, weights ARRAY<BIGINT>. Building
is in two steps: each task makes a digest of its values of a group, a second one merges them; both in
Arrow batches, since whether a centroid takes a value depends on the ones before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SketchArgumentError

MIN_K, DEFAULT_K = 10, 200
MERGE_ROWS = 64


def check_k(k: int) -> int:
    if not MIN_K <= k <= 65535:
        raise SketchArgumentError(f"k must be from {MIN_K} to 65535", k=k)
    return k


def compress(means: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted centroids merged greedily while the size limit q (1 - q) / norm at both of its ends allows; the first and last stay single.

    Centroids far below the limit are found by a search in the running weight, so the loop has one step a result, not one an input.
    """
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order].astype(np.float64)
    n = len(means)
    if n <= 2:
        return means, weights.astype(np.int64)
    upto = np.concatenate([[0.0], np.cumsum(weights)])
    moment = np.concatenate([[0.0], np.cumsum(means * weights)])
    total = upto[-1]
    norm = 2.0 * k / (4.0 * math.log(max(total / (2.0 * k), 1.0)) + 24.0)

    def limit(q: float) -> float:
        return q * (1.0 - q) / norm

    cuts, start = [0, 1], 1
    while start < n - 1:
        q0 = upto[start] / total
        # The far end can grow while its weight is at most total * the smaller of the limits at both ends.
        low, high = start + 1, n - 1
        step = 1
        while low + step <= high and upto[low + step] - upto[start] <= total * min(limit(q0), limit(upto[low + step] / total)):
            low += step
            step *= 2
        while step > 1:
            step //= 2
            if low + step <= high and upto[low + step] - upto[start] <= total * min(limit(q0), limit(upto[low + step] / total)):
                low += step
        cuts.append(low)
        start = low
    cuts.append(n)
    edges = np.array(sorted(set(cuts)))
    w = np.diff(upto[edges])
    m = np.diff(moment[edges]) / w
    single = np.diff(edges) == 1
    m[single] = means[edges[:-1]][single]
    with np.errstate(invalid="ignore"):
        m = np.where(np.isfinite(m), m, means[edges[:-1]])
    return np.clip(m, means[0], means[-1]), w.astype(np.int64)


class Digest:
    """Centroids of one group."""

    def __init__(self, low: float, high: float, means: np.ndarray, weights: np.ndarray):
        self.low, self.high, self.means, self.weights = low, high, np.asarray(means, np.float64), np.asarray(weights, np.float64)
        self.total = float(self.weights.sum())

    def _points(self) -> tuple[np.ndarray, np.ndarray]:
        """Cumulative weight and value where they are known: the ends, and the middle of each centroid."""
        middle = np.cumsum(self.weights) - self.weights / 2
        return np.concatenate([[0.0], middle, [self.total]]), np.concatenate([[self.low], self.means, [self.high]])

    def quantile(self, rank: float) -> float | None:
        if not 0 <= rank <= 1:
            raise SketchArgumentError("ranks are in [0, 1]", rank=rank)
        if not self.total:
            return None
        at = rank * self.total
        if at < 1 or len(self.means) == 1 and self.total == 1:
            return self.low
        if at > self.total - 1:
            return self.high
        middle = np.cumsum(self.weights) - self.weights / 2
        i = int(np.searchsorted(middle, at, "right")) - 1
        if i < 0:
            return float(self.low + (self.means[0] - self.low) * at / middle[0])
        if i >= len(middle) - 1:
            room = self.total - middle[-1]
            return float(min(self.high, self.means[-1] + (self.high - self.means[-1]) * (at - middle[-1]) / room)) if room else float(self.high)
        a, b = self.means[i], self.means[i + 1]
        left, right = at - middle[i], middle[i + 1] - at
        # A centroid of weight 1 is a value: it holds half a unit on both sides.
        if self.weights[i] == 1 and left < 0.5:
            return float(a)
        if self.weights[i + 1] == 1 and right <= 0.5:
            return float(b)
        share = left / (left + right)
        return float(a * (1 - share) + b * share)

    def rank(self, value: float) -> float | None:
        if math.isnan(value):
            raise SketchArgumentError("the rank of NaN is not defined")
        if not self.total:
            return None
        if value < self.low:
            return 0.0
        if value > self.high:
            return 1.0
        if len(self.means) == 1 and self.total == 1:
            return 0.5
        first, last = np.searchsorted(self.means, value, "left"), np.searchsorted(self.means, value, "right")
        before = float(self.weights[:first].sum())
        if last > first:
            return (before + float(self.weights[first:last].sum()) / 2) / self.total
        points, values = self._points()
        i = int(np.searchsorted(values, value, "right")) - 1
        if i >= len(values) - 1:
            return 1.0
        a, b = values[i], values[i + 1]
        share = (value / 2 - a / 2) / (b / 2 - a / 2) if b > a else 0.5
        return float((points[i] + (points[i + 1] - points[i]) * share) / self.total)


def _pack(groups: pd.DataFrame, by: Sequence[str], k: int) -> tuple:
    means = np.concatenate([np.asarray(m, np.float64) for m in groups["means"]]) if len(groups) else np.zeros(0)
    weights = np.concatenate([np.asarray(w, np.int64) for w in groups["weights"]]) if len(groups) else np.zeros(0, np.int64)
    m, w = compress(means, weights, k) if len(means) else (means, weights)
    return groups["min"].min(), groups["max"].max(), int(w.sum()), m, w


def _fields(df: DataFrame, by: Sequence[str]) -> str:
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema)
    return own + "min double, max double, weight long, means array<double>, weights array<long>"


def build(df: DataFrame, value: str, by: Sequence[str] = (), k: int = DEFAULT_K) -> DataFrame:
    """The digest of the finite values of each group; NaN, infinities and nulls are left out, a group of nothing else too.

    What is shuffled is a digest for each task and group, not values.
    """
    check_k(k)
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v) and abs(__v) < double('infinity')")
    names = list(by)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def fold(parts: list, m: np.ndarray, w: np.ndarray) -> list:
            m, w = np.concatenate([*(p[0] for p in parts), m]), np.concatenate([*(p[1] for p in parts), w])
            return [compress(m, w, k)]

        for batch in batches:
            keyed = batch.groupby(names, dropna=False, sort=False)["__v"] if names else [((), batch["__v"])]
            for key, v in keyed:
                v = v.to_numpy(np.float64)
                key = tuple(None if x is pd.NaT or x != x else x for x in (key if isinstance(key, tuple) else (key,)))
                low, high, parts = held.get(key, (math.inf, -math.inf, []))
                held[key] = (min(low, v.min()), max(high, v.max()), fold(parts, v, np.ones(len(v), np.int64)))
            if len(held) > 50_000:
                yield table(held)
                held.clear()
        yield table(held)

    def table(held: dict[tuple, list]) -> pd.DataFrame:
        rows = [(*key, low, high, int(parts[0][1].sum()), parts[0][0].tolist(), parts[0][1].tolist()) for key, (low, high, parts) in held.items()]
        return pd.DataFrame(rows, columns=[*names, "min", "max", "weight", "means", "weights"])

    schema = _fields(df, by)
    return merge(rows.mapInPandas(local, schema), by=by, k=k)


def merge(*states: DataFrame, by: Sequence[str] = (), k: int = DEFAULT_K) -> DataFrame:
    """Merges digests; a coarser `by` rolls groups up.

    A group's digests are first merged MERGE_ROWS hash slices at a time, then the slices' digests: no task
    gathers all tasks' digests of one group.
    """
    check_k(k)
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    schema = _fields(rows, by)
    names = [f.name for f in rows.select(*by).schema] if by else []

    def fold(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["weight"] > 0].sort_values(["min", "max", "weight"])
        if not len(group):
            return pd.DataFrame(columns=[*names, "min", "max", "weight", "means", "weights"])
        low, high, weight, m, w = _pack(group, names, k)
        return pd.DataFrame([[*key[: len(names)], low, high, weight, m.tolist(), w.tolist()]], columns=[*names, "min", "max", "weight", "means", "weights"])

    sliced = rows.withColumn("__slice", F.pmod(F.xxhash64("min", "max", "weight"), F.lit(MERGE_ROWS)))
    part = sliced.groupBy(*by, "__slice").applyInPandas(fold, schema)
    return part.groupBy(*by).applyInPandas(fold, schema)


def _ask(state: DataFrame, points: Sequence[float], kind: str, ask) -> Column:
    @F.pandas_udf(kind)
    def run(low: pd.Series, high: pd.Series, means: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([None if m is None else ask(Digest(a, b, m, w)) for a, b, m, w in zip(low, high, means, weights)])

    return run("min", "max", "means", "weights")


def quantiles(state: DataFrame, ranks: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """quantiles ARRAY<DOUBLE> at the given ranks."""
    for r in ranks:
        if not 0 <= r <= 1:
            raise SketchArgumentError("ranks are in [0, 1]", rank=r)
    return state.select(*by, _ask(state, ranks, "array<double>", lambda d: [d.quantile(r) for r in ranks]).alias("quantiles"))


def ranks(state: DataFrame, values: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """ranks ARRAY<DOUBLE> of the given values: the share of smaller values, plus half of the equal ones."""
    if any(math.isnan(v) for v in values):
        raise SketchArgumentError("the rank of NaN is not defined")
    return state.select(*by, _ask(state, values, "array<double>", lambda d: [d.rank(v) for v in values]).alias("ranks"))


def _check_split(points: Sequence[float]) -> None:
    if not points or any(math.isnan(p) for p in points) or any(a >= b for a, b in zip(points, points[1:])):
        raise SketchArgumentError("split points must be given, strictly ascending and no NaN")


def cdf(state: DataFrame, split_points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """cdf ARRAY<DOUBLE>: the ranks of the split points, and 1."""
    _check_split(split_points)
    return state.select(*by, _ask(state, split_points, "array<double>", lambda d: [*(d.rank(p) for p in split_points), 1.0]).alias("cdf"))


def pmf(state: DataFrame, split_points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """pmf ARRAY<DOUBLE>: the shares between the split points, and beyond them."""
    _check_split(split_points)

    def ask(d: Digest) -> list[float]:
        return np.diff([0.0, *(d.rank(p) for p in split_points), 1.0]).tolist()

    return state.select(*by, _ask(state, split_points, "array<double>", ask).alias("pmf"))
