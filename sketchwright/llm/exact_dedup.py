"""Exact dedup by skew-safe combining: local winners, salted winners, global winners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, met, plain_text, written


def sha256(normal: Column) -> Column:
    return F.sha2(normal, 256)


def normal_text(text: str) -> Column:
    return F.regexp_replace(plain_text(F.col(text)), SPACES, " ")


def _rows(docs: DataFrame, text: str, key: str, digest: Callable[[Column], Column]) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), normal_text(text).alias("normal")).withColumn("digest", digest(F.col("normal")))


def winners(rows: DataFrame, salts: int = 32) -> DataFrame:
    """rows: (doc_id, normal, digest). Returns (digest, normal, keep_id, group_size): one row per distinct normalised text.

    Each stage groups by digest and full content, so a colliding digest never merges texts.
    Stage 1 is the map-side combine of the salted grouping, stage 2 merges a digest's rows within
    a salt, stage 3 merges the salts' winners. A group of any size thus reaches a reducer as one row
    for each map task, and its final one as one row for each salt.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    salted = salted.groupBy("salt", "digest", "normal").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return salted.groupBy("digest", "normal").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def _settled(docs: DataFrame, text: str, key: str, salts: int, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame | None]:
    """The winners without their texts, written; and the digests that several of these texts share, or None.

    Winners are told apart by whole texts, so a digest that only one of them has belongs to one text in all
    rows: there it names the text. Rows with a digest of several texts must be told apart by their texts.
    """
    best = written(winners(_rows(docs, text, key, digest), salts).drop("normal"), "exact-winners")
    shared = best.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    return best, None if shared.isEmpty() else written(shared, "exact-shared")


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = 32, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of rows that repeat the smallest doc_id of a group all count as kept:
    the id is what stays. A null doc_id never wins over a number; a group of null ids keeps null.
    Empty input gives no rows. Other columns of docs are not read. Rows of a group with over a thousandth
    of all rows get their winner by broadcast, others by a shuffle on the digest.
    """
    best, shared = _settled(docs, text, key, salts, digest)
    every = _rows(docs, text, key, digest).withColumn("text_sha256", F.col("digest") if digest is sha256 else sha256(F.col("normal")))
    rows = every.drop("normal")
    total = best.agg(F.sum("group_size")).collect()[0][0] or 0
    counted = best.withColumn("copies", F.col("group_size"))
    if shared is not None:
        rows, counted = (x.join(shared, "digest", "left_anti") for x in (rows, counted))
    found = met(rows, counted, "digest", "copies", total, F.xxhash64("doc_id").cast("string"))
    if shared is not None:
        others = every.join(shared, "digest", "left_semi")
        found = found.unionByName(others.join(winners(others.drop("text_sha256"), salts), ["digest", "normal"]).select(*found.columns))
    return found.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = 32, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of docs that groups() keeps, with all their columns; rows that repeat the kept id and text stay once.

    Null and repeated ids and empty input are as in groups(). The join pairs digest and id, so a large
    group's rows spread over the reducers.
    """

    def name(column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.lit(""))

    d, k, n = fresh(docs, "digest", "key", "normal")
    best, shared = _settled(docs, text, key, salts, digest)
    marked = docs.withColumn(d, digest(normal_text(text))).withColumn(k, name(F.col(key)))
    wanted = best.select(F.col("digest").alias(d), name(F.col("keep_id")).alias(k))
    plain, ids = marked, wanted
    if shared is not None:
        shared = shared.select(F.col("digest").alias(d))
        plain, ids = (x.join(shared, d, "left_anti") for x in (marked, wanted))
    kept = plain.join(ids, [d, k], "left_semi").dropDuplicates([d, k]).drop(d, k)
    if shared is not None:
        others = marked.join(shared, d, "left_semi").withColumn(n, normal_text(text))
        told = winners(others.select(F.col(key).alias("doc_id"), F.col(n).alias("normal"), F.col(d).alias("digest")), salts)
        told = told.select(F.col("digest").alias(d), F.col("normal").alias(n), name(F.col("keep_id")).alias(k))
        kept = kept.unionByName(others.join(told, [d, n, k], "left_semi").dropDuplicates([d, n, k]).drop(d, n, k))
    return kept
