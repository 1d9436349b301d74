"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fingerprint, license_scan, mixing, pii, simhash, substring_dedup, suffix_dedup, toxicity
from .common import documents


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.removal(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.plan(documents(spark, sf_dir), labels).drop("tie", "source")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokens(documents(spark, sf_dir), vocabulary_path(), with_ids=False)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.removal(documents(spark, sf_dir))
    spans = F.size("spans").cast("long")
    return found.select("doc_id", "n_bytes", "n_removed", spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(documents(spark, sf_dir))
    n_spans = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", n_spans.alias("n_spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("blocks")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_mixing": op2_mixing,
        "op3_bpe": op3_bpe,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_toxicity": op5_toxicity,
        "op6_fingerprints": op6_fingerprints,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_pii": op8_pii,
        "op9_simhash": op9_simhash,
        "op10_license_scan": op10_license_scan,
    }


OP2_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, text FROM documents
), q AS (
  SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1
), r AS (
  SELECT d.doc_id, source, CAST(size AS BIGINT) AS size, text,
    -ln((CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)
      / CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS place
  FROM d LEFT JOIN q ON d.doc_id = q.doc_id
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3]::DOUBLE AS weight
  FROM r GROUP BY source
), w AS (
  SELECT source, source_size, weight, 2.0::DOUBLE * source_size AS stop,
    sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS all_weights,
    coalesce(sum(2.0::DOUBLE * source_size) OVER f, 0) AS stopped, coalesce(sum(weight) OVER f, 0) AS weights
  FROM s WINDOW f AS (ORDER BY 2.0::DOUBLE * source_size / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT *, (total - stopped) / (all_weights - weights) AS level FROM w
), l AS (
  SELECT arg_min(level, stop / weight) AS level FROM v WHERE level < stop / weight
), t AS (
  SELECT source, source_size, coalesce(least(l.level * weight, stop), stop) AS target FROM v CROSS JOIN l
), p AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY place, r.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * epochs + CASE WHEN upto - size / 2.0 <= target - epochs * source_size THEN size ELSE 0 END AS BIGINT) AS taken
FROM p
"""

OP7_SQL = """
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS normal FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, sha256(normal) AS text_sha256
FROM n WINDOW g AS (PARTITION BY normal)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op7_exact_dedup": OP7_SQL}
