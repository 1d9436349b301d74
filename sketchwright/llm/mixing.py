"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, fresh, plain_text, written

#: Key ranges for each source. Only the range in which a budget ends is cut, so a source's sort is split this many ways.
RANGES = 4096


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """In (0, 1), from the first 52 bits of the key's MD5, so that reruns and other engines agree."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sizes: (source, source_size), a row per source. Adds weight and target.

    share * total is dealt by weight; a target stops at most * source_size and what it leaves is dealt
    again by weight. The fixed point is least(most * size, level * weight): sources in the order of
    most * size / weight stop as long as the level that the others would get reaches their own stop.
    The windows here run over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("stop", F.col("source_size") * F.lit(float(most)))
    filling = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    before, everywhere = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    stopped = F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    total = F.sum("source_size").over(everywhere) * F.lit(float(share))
    ranked = ranked.withColumn("level", (total - stopped) / weight_left)
    full = F.col("stop") / F.col("weight")
    first_open = F.min(F.when(F.col("level") < full, F.struct(full.alias("full"), F.col("level").alias("level")))).over(everywhere)
    dealt = F.coalesce(F.least(first_open["level"] * F.col("weight"), F.col("stop")), F.col("stop"))
    return ranked.select("source", "source_size", dealt.alias("target"))


def quality(docs: DataFrame, labels: DataFrame | None, key: str) -> tuple[DataFrame, Column]:
    """docs with a sampling weight: 2 for documents labelled good, 0.5 for bad ones, 1 for others."""
    if labels is None:
        return docs, F.lit(1.0)
    best = labels.groupBy(F.col("doc_id").alias("__labelled")).agg(F.max("quality").alias("__quality"))
    joined = docs.join(best, docs[key] == best["__labelled"], "left")
    return joined, F.when(F.col("__quality") == 1, 2.0).when(F.col("__quality") == 0, 0.5).otherwise(1.0)


def plan(docs: DataFrame, labels: DataFrame | None = None, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row per row of docs: doc_id, size, source_size, target, taken (words taken, repeats counted).

    A document's key is an exponential variate over its quality weight. A source first gives as many
    complete epochs as its target holds, then documents in the order of their keys while the budget
    lasts; the one in which it ends is taken if that leaves the sum nearer to the budget. Null text
    has size 0, a null source is a source of its own and the last; ties go by id, then by a hash of
    the text. Empty input gives no rows. No document is taken more than ceil(most) times.
    """
    slim = docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        words_of(F.col(text)).alias("size"),
        F.xxhash64(plain_text(F.col(text))).alias("tie"),
    )
    slim, weight = quality(slim, labels, "doc_id")
    rows = slim.select("doc_id", "source", "size", "tie", (-F.log(uniform(F.col("doc_id"))) / weight).alias("place"))
    spread = F.least(F.lit(RANGES - 1), F.floor((1 - F.exp(-F.col("place"))) * RANGES)).cast("int")
    rows = rows.select("*", F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), spread.alias("range"))
    rows = written(rows, "mix-rows")

    pieces = rows.groupBy("none", "name", "range").agg(F.sum("size").alias("piece"))
    per_source = pieces.groupBy("none", "name").agg(F.sum("piece").alias("source_size"))
    named = per_source.select(F.when(~F.col("none"), F.col("name")).alias("source"), "source_size")
    targets = source_targets(named, weights, share, most)
    targets = targets.select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target")
    upto = Window.partitionBy("none", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begun = pieces.withColumn("begun", F.coalesce(F.sum("piece").over(upto), F.lit(0))).drop("piece")
    begun = begun.join(targets, ["none", "name"])

    within = Window.partitionBy("none", "name", "range").orderBy("place", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(begun, ["none", "name", "range"]).withColumn("upto", F.col("begun") + F.sum("size").over(within))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = F.col("target") - epochs * F.col("source_size")
    once = F.when(F.col("upto") - F.col("size") / 2.0 <= budget, F.col("size")).otherwise(0)
    taken = (F.col("size") * epochs + once).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "tie", F.when(~F.col("none"), F.col("name")).alias("source"))


def mix(docs: DataFrame, labels: DataFrame | None = None, **how) -> DataFrame:
    """The rows of docs, each as often as plan() takes it; documents of size 0 stay out.

    Rows that repeat id, text and source are taken as often as the one of them that plan() takes most.
    """
    key, text, source = how.get("key", "doc_id"), how.get("text", "text"), how.get("source", "source")
    dealt = plan(docs, labels, **how).where("taken > 0")

    def name(column):
        return F.coalesce(column.cast("string"), F.lit(""))

    k, t, s, times, n = fresh(docs, "__key", "__tie", "__source", "__times", "__n")
    most = F.max(F.col("taken") / F.col("size")).cast("int").alias(times)
    taken = dealt.groupBy(name(F.col("doc_id")).alias(k), F.col("tie").alias(t), name(F.col("source")).alias(s)).agg(most)
    marked = docs.select("*", name(F.col(key)).alias(k), F.xxhash64(plain_text(F.col(text))).alias(t), name(F.col(source)).alias(s))
    joined = marked.join(taken, [k, t, s])
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
