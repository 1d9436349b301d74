"""The registered queries of the summaries, each with the SQL that computes the same."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import murmur3_sql, xxh64_sql
from ..functions.relative_errors import hll_error
from ..operators import bloom, countmin, cpc, frequent, hll, tdigest, theta, tuples
from ..sources import tables
from ..streaming import rollups
from .rollup import SketchTable

Query = Callable[[SparkSession, str], DataFrame]
MAX = theta.MAX_THETA


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- theta ---

FLAG, MODE = "l_returnflag", "l_linestatus"
LG = 9


def _by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theta.build(_table(spark, sf_dir, "lineitem"), "l_orderkey", [FLAG], lg_k=LG)


def theta_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theta.summary(_by_flag(spark, sf_dir), [FLAG])


def theta_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_flag(spark, sf_dir).select(FLAG, "hash", "theta")


def theta_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theta.summary(theta.build(_table(spark, sf_dir, "lineitem"), "l_orderkey", [FLAG], lg_k=14, p=0.25), [FLAG])


def theta_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theta.summary(theta.build(_table(spark, sf_dir, "customer"), "c_custkey", ["c_mktsegment"], lg_k=16), ["c_mktsegment"])


def theta_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = theta.build(_table(spark, sf_dir, "lineitem"), "l_orderkey", [FLAG, MODE], lg_k=LG)
    return theta.summary(theta.union(fine.drop(MODE), by=[FLAG], lg_k=LG), [FLAG])


def theta_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theta.bounds(_by_flag(spark, sf_dir), 2, [FLAG])


def _customers(spark: SparkSession, sf_dir: str, priority: str, lg_k: int = 7) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == priority)
    return theta.build(orders, "o_custkey", ["o_orderstatus"], lg_k=lg_k)


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _customers(spark, sf_dir, "1-URGENT"), _customers(spark, sf_dir, "2-HIGH")


def theta_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theta.summary(theta.union(*_two(spark, sf_dir), by=["o_orderstatus"]), ["o_orderstatus"])


def theta_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theta.summary(theta.intersection(*_two(spark, sf_dir), by=["o_orderstatus"]), ["o_orderstatus"])


def theta_a_not_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theta.summary(theta.a_not_b(*_two(spark, sf_dir), by=["o_orderstatus"]), ["o_orderstatus"])


def theta_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theta.jaccard(*_two(spark, sf_dir), by=["o_orderstatus"]).select("o_orderstatus", "estimate")


def theta_jaccard_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theta.jaccard(*_two(spark, sf_dir), by=["o_orderstatus"])


def theta_exactly_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return theta.exactly_equal(theta.union(a, b, by=["o_orderstatus"]), theta.union(b, a, by=["o_orderstatus"]), ["o_orderstatus"])


def theta_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact rows, unfolded again."""
    return theta.summary(theta.expand(theta.compact(_by_flag(spark, sf_dir), [FLAG]), [FLAG]), [FLAG])


def _theta_sql(source: str, key: str, by: str, lg_k: int, name: str, p: float = 1.0) -> str:
    """CTEs ending in `name`: by, hash, theta."""
    k, start = 1 << lg_k, theta.start_theta(p)
    return f"""{murmur3_sql(source, key, by, f"{name}_m")},
{name}_d AS (SELECT DISTINCT {by}, CAST(h1 >> 1 AS BIGINT) AS hash FROM {name}_m WHERE CAST(h1 >> 1 AS BIGINT) BETWEEN 1 AND {start - 1}),
{name}_r AS (SELECT {by}, hash, row_number() OVER (PARTITION BY {by} ORDER BY hash) AS r FROM {name}_d),
{name}_t AS (SELECT {by}, coalesce(min(CASE WHEN r = {k + 1} THEN hash END), {start}) AS theta FROM {name}_r GROUP BY {by}),
{name} AS (SELECT r.{by}, r.hash, t.theta FROM {name}_r r JOIN {name}_t t ON r.{by} IS NOT DISTINCT FROM t.{by} WHERE r.hash < t.theta)"""


def _summary_sql(name: str, by: str, lg_k: int) -> str:
    return f"""SELECT {by}, count(hash) AS retained, min(theta) AS theta, min(theta)::DOUBLE / {MAX}::DOUBLE AS theta_fraction, FALSE AS is_empty,
  min(theta) < {MAX} AS is_estimation_mode, {lg_k} AS lg_k, count(hash) / (min(theta)::DOUBLE / {MAX}::DOUBLE) AS estimate
FROM {name} GROUP BY {by}"""


_FLAG_SQL = _theta_sql("lineitem", "l_orderkey", FLAG, LG, "s")
_BY = "o_orderstatus"
_SIDES_SQL = f"""oa AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'), ob AS (SELECT * FROM orders WHERE o_orderpriority = '2-HIGH'),
{_theta_sql("oa", "o_custkey", _BY, 7, "a")},
{_theta_sql("ob", "o_custkey", _BY, 7, "b")},
ta AS (SELECT {_BY}, min(theta) AS theta FROM a GROUP BY 1), tb AS (SELECT {_BY}, min(theta) AS theta FROM b GROUP BY 1),
t AS (SELECT {_BY}, least(ta.theta, tb.theta) AS theta FROM ta JOIN tb USING ({_BY}))"""
_UNION_SQL = f"""{_SIDES_SQL},
ud AS (SELECT DISTINCT x.{_BY}, hash, t.theta FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x JOIN t USING ({_BY}) WHERE hash < t.theta),
ur AS (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY hash) AS r FROM ud),
ut AS (SELECT {_BY}, coalesce(min(CASE WHEN r = 129 THEN hash END), min(theta)) AS cut FROM ur GROUP BY 1),
u AS (SELECT ur.{_BY}, hash, cut AS theta FROM ur JOIN ut USING ({_BY}) WHERE hash < cut)"""


def _kept_sql(name: str) -> str:
    return f"""SELECT {_BY}, count(hash) AS retained, min(theta) AS theta, min(theta)::DOUBLE / {MAX}::DOUBLE AS theta_fraction, FALSE AS is_empty,
  min(theta) < {MAX} AS is_estimation_mode, 7 AS lg_k, count(hash) / (min(theta)::DOUBLE / {MAX}::DOUBLE) AS estimate
FROM (SELECT t.{_BY}, t.theta, k.hash FROM t LEFT JOIN {name} k ON t.{_BY} = k.{_BY} AND k.hash < t.theta) GROUP BY 1"""


# --- tuple ---


def _spend(spark: SparkSession, sf_dir: str, policy: tuples.Policy = tuples.SUM) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").withColumn("qty", F.col("l_quantity").cast("long"))
    return tuples.build(rows, "l_orderkey", "qty", [FLAG], policy, lg_k=LG)


def tuple_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spend(spark, sf_dir).select(FLAG, "hash", "summary")


def tuple_subset_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuples.subset_sum(_spend(spark, sf_dir), [FLAG])


def tuple_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spend(spark, sf_dir, tuples.MAX).select(FLAG, "hash", "summary")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = _table(spark, sf_dir, "orders").withColumn("one", F.lit(1).cast("long"))
    return tuple(tuples.build(orders.where(F.col("o_orderpriority") == p), "o_custkey", "one", [_BY], lg_k=7) for p in ("1-URGENT", "2-HIGH"))


def tuple_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuples.union(*_sides(spark, sf_dir), by=[_BY]).select(_BY, "hash", "summary")


def tuple_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuples.intersection(*_sides(spark, sf_dir), by=[_BY], policy=tuples.SUM).where("hash is not null").select(_BY, "hash", "summary")


def tuple_a_not_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuples.a_not_b(*_sides(spark, sf_dir), by=[_BY]).where("hash is not null").select(_BY, "hash", "summary")


def _keyed_sql(value: str) -> str:
    return f"""WITH {_FLAG_SQL},
{murmur3_sql("lineitem", "l_orderkey", f"{FLAG}, l_quantity", "v")},
w AS (SELECT {FLAG}, CAST(h1 >> 1 AS BIGINT) AS hash, CAST({value}(CAST(l_quantity AS BIGINT)) AS BIGINT) AS summary FROM v GROUP BY 1, 2)
"""


_COUNTS_SQL = f"""WITH {_UNION_SQL},
{murmur3_sql("orders", "o_custkey", "o_orderstatus, o_orderpriority", "v")},
n AS (SELECT {_BY}, CAST(h1 >> 1 AS BIGINT) AS hash, count(*) FILTER (o_orderpriority = '1-URGENT') AS na,
  count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS nab FROM v GROUP BY 1, 2)
"""


# --- stored forms: states written to bytes and read back ---


def theta_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.theta_from_binary(tables.theta_to_binary(_by_flag(spark, sf_dir), [FLAG]), by=[FLAG], lg_k=LG).select(FLAG, "hash", "theta")


def theta_bytes_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.theta_from_binary(tables.theta_to_binary(_by_flag(spark, sf_dir), [FLAG], compressed=True), by=[FLAG], lg_k=LG).select(FLAG, "hash", "theta")


def tuple_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tuple_from_binary(tables.tuple_to_binary(_spend(spark, sf_dir), "i64", [FLAG]), "i64", by=[FLAG], lg_k=LG).select(FLAG, "hash", "summary")


def hll_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.hll_from_binary(hll.to_binary(hll_registers(spark, sf_dir), [FLAG]), by=[FLAG])


def hll_bytes_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.hll_from_binary(hll.to_binary(hll_registers(spark, sf_dir), [FLAG], 6), by=[FLAG])


def hll_bytes_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.hll_from_binary(hll.to_binary(hll_registers(spark, sf_dir), [FLAG], 4), by=[FLAG])


def hll_coupon_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hll.coupons(_table(spark, sf_dir, "customer"), "c_custkey", ["c_mktsegment"])
    return tables.hll_coupons_from_binary(tables.hll_coupons_to_binary(rows, ["c_mktsegment"]), by=["c_mktsegment"])


def bloom_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bloom_from_binary(tables.bloom_to_binary(bloom_words(spark, sf_dir), BLOOM))


def countmin_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countmin.counters(tables.countmin_from_binary(tables.countmin_to_binary(_quantities(spark, sf_dir), CM, [FLAG]), by=[FLAG]), [FLAG])


def frequent_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = tables.frequent_from_binary(tables.frequent_to_binary(_hitters(spark, sf_dir), 6, [FLAG]), by=[FLAG])
    return frequent.frequent_items(state, False)


def tdigest_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tdigest_from_binary(tables.tdigest_to_binary(_prices(spark, sf_dir), [FLAG]), by=[FLAG]).select(FLAG, "min", "max", "weight")


# --- string keys: eight characters, whose bytes make the BIGINT that SQL hashes ---


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").withColumn("word", F.lpad(F.col("l_orderkey").cast("string"), 8, "0"))


_WORD = "lpad(CAST(l_orderkey AS VARCHAR), 8, '0')"
_TEXTS_SQL = f"w AS (SELECT {FLAG}, {' + '.join(f'CAST(ascii(substr({_WORD}, {i + 1}, 1)) AS BIGINT) * {256**i}' for i in range(8))} AS k, CAST(l_quantity AS BIGINT) AS qty FROM lineitem)"


def theta_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theta.build(_texts(spark, sf_dir), "word", [FLAG], lg_k=LG).select(FLAG, "hash", "theta")


def theta_text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the built-in aggregate."""
    return theta.build(_texts(spark, sf_dir), "word", [FLAG], lg_k=LG, native=False).select(FLAG, "hash", "theta")


def tuple_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir).withColumn("qty", F.col("l_quantity").cast("long"))
    return tuples.build(rows, "word", "qty", [FLAG], lg_k=LG).select(FLAG, "hash", "summary")


def hll_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hll.build(_texts(spark, sf_dir), "word", [FLAG], lg_k=10)


def cpc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpc.build(_texts(spark, sf_dir), "word", [FLAG], lg_k=10)


def countmin_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countmin.counters(countmin.build(_texts(spark, sf_dir), "word", CM, [FLAG]), [FLAG])


def bloom_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.build(_texts(spark, sf_dir).where("l_quantity > 45"), "word", BLOOM)


def frequent_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").withColumn("word", F.lpad(F.col("l_suppkey").cast("string"), 8, "0"))
    return frequent.frequent_items(frequent.build(rows, "word", HITTERS, [FLAG]), False)


# --- bounds and estimates against exact answers ---


def theta_unequal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theta.exactly_equal(*_two(spark, sf_dir), by=[_BY])


def theta_jaccard_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the exact similarity is within twice the distance of the bounds."""
    orders = _table(spark, sf_dir, "orders")
    sides = orders.groupBy(_BY, "o_custkey").agg(F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("a"), F.max((F.col("o_orderpriority") == "2-HIGH").cast("int")).alias("b"))
    exact = sides.groupBy(_BY).agg((F.sum(F.col("a") * F.col("b")) / F.sum(F.greatest("a", "b"))).alias("exact"))
    found = theta.jaccard(*_two(spark, sf_dir), by=[_BY]).join(exact, _BY)
    near = F.abs(F.col("exact") - F.col("estimate")) <= F.greatest(F.col("upper") - F.col("estimate"), F.col("estimate") - F.col("lower")) * 2
    return found.select(_BY, near.alias("within"))


def _exact_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy(FLAG).agg(F.countDistinct("l_orderkey").alias("exact"))


def _within(found: DataFrame, exact: DataFrame) -> DataFrame:
    joined = found.join(exact, FLAG)
    return joined.select(FLAG, "exact", ((F.col("lower") <= F.col("exact")) & (F.col("exact") <= F.col("upper"))).alias("within"))


def theta_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _within(theta.bounds(_by_flag(spark, sf_dir), 3, [FLAG]), _exact_orders(spark, sf_dir))


def hll_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _within(hll.bounds(hll_registers(spark, sf_dir), 3, [FLAG]), _exact_orders(spark, sf_dir))


def hll_sketches_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of Spark's own, for both line statuses, merged."""
    fine = hll.sketches(_table(spark, sf_dir, "lineitem"), "l_orderkey", [FLAG, MODE])
    return _within(hll.read(hll.merge_sketches(fine, by=[FLAG]), 3, [FLAG]), _exact_orders(spark, sf_dir))


def cpc_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _within(cpc.bounds(cpc_state(spark, sf_dir), 3, [FLAG]), _exact_orders(spark, sf_dir))


def cpc_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coupons that as many keys as estimated leave on average, in SQL from the estimate, rounded: those seen."""
    found = cpc.bounds(cpc_state(spark, sf_dir), 2, [FLAG]).select(FLAG, "estimate")
    mean = sum(1024 * (1 - F.exp(F.col("estimate") * F.log1p(F.lit(-(2.0 ** -(c + 1)) / 1024)))) for c in range(64))
    return found.select(FLAG, F.round(mean).cast("long").alias("num_coupons"))


def hll_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimate from empty slots, with its bounds, however many keys there are."""
    return hll.linear_bounds(hll.build(_table(spark, sf_dir, "customer"), "c_custkey", ["c_mktsegment"], lg_k=15), 2, ["c_mktsegment"])


def hll_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's own summaries of few and many keys: how they are kept, and the estimates of those kept as coupons."""
    found = hll.read(hll.sketches(_table(spark, sf_dir, "nation"), "n_nationkey", ["n_regionkey"]), 2, ["n_regionkey"])
    more = hll.read(hll.sketches(_table(spark, sf_dir, "nation"), "n_nationkey"), 2).withColumn("n_regionkey", F.lit(None).cast("int"))
    return found.unionByName(more).select("n_regionkey", "mode", "lg_k", "is_empty", "lower", "estimate", "upper")


# --- hll and cpc ---


def hll_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hll.build(_table(spark, sf_dir, "lineitem"), "l_orderkey", [FLAG], lg_k=10)


def hll_classic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hll.classic_estimate(hll_registers(spark, sf_dir), [FLAG])


def hll_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hll.estimate(hll_registers(spark, sf_dir), [FLAG])


def hll_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hll.bounds(hll_registers(spark, sf_dir), 2, [FLAG])


def hll_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hll.ordered_estimate(_table(spark, sf_dir, "lineitem"), "l_orderkey", [FLAG], 12)


def hll_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _table(spark, sf_dir, "lineitem")
    parts = [hll.build(lineitem.where(F.col(MODE) == s), "l_orderkey", [FLAG], lg_k=k) for s, k in (("O", 11), ("F", 10))]
    return hll.union(*parts, by=[FLAG])


def hll_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hll.small_estimate(hll.coupons(_table(spark, sf_dir, "customer"), "c_custkey", ["c_mktsegment"]), ["c_mktsegment"])


def cpc_coupons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpc.num_coupons(cpc.build(_table(spark, sf_dir, "lineitem"), "l_orderkey", [FLAG], lg_k=10), [FLAG])


def cpc_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpc.build(_table(spark, sf_dir, "lineitem"), "l_orderkey", [FLAG], lg_k=10)


def cpc_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _table(spark, sf_dir, "lineitem")
    parts = [cpc.build(lineitem.where(F.col(MODE) == s), "l_orderkey", [FLAG], lg_k=k) for s, k in (("O", 11), ("F", 10))]
    return cpc.union(*parts, by=[FLAG])


def cpc_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpc.bounds(cpc_state(spark, sf_dir), 2, [FLAG])


def cpc_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpc.ordered_estimate(_table(spark, sf_dir, "events"), "user_id", "event_id", ["event_type"], lg_k=10)


def _lead_sql(limit: int) -> str:
    """Leading zeros of h2, at most limit."""
    return f"least({limit}, CASE WHEN h2 = 0 THEN 64 ELSE 64 - length(ltrim(bin(h2), '0')) END)"


_H_SQL = murmur3_sql("lineitem", "l_orderkey", f"{FLAG}, {MODE}", "m")
_REG_SQL = f"""WITH {_H_SQL},
g AS (SELECT {FLAG}, CAST(h1 & 1023 AS INTEGER) AS slot, CAST(max({_lead_sql(62)} + 1) AS INTEGER) AS value FROM m GROUP BY 1, 2)
"""
_BITS_SQL = """CAST(CASE WHEN bits >= 9223372036854775808::UHUGEINT THEN bits::HUGEINT - 18446744073709551616::HUGEINT ELSE bits::HUGEINT END AS BIGINT)"""
_CPC_SQL = f"""WITH {_H_SQL},
c AS (SELECT DISTINCT {FLAG}, CAST(h1 & 1023 AS INTEGER) AS row, CAST({_lead_sql(63)} AS INTEGER) AS col FROM m),
p AS (SELECT {FLAG}, row, sum(CAST(1 AS HUGEINT) << col)::UHUGEINT AS bits FROM c GROUP BY 1, 2)
"""


# --- count-min, bloom, frequent items, t-digest ---

CM = countmin.Config(5, 272)
BLOOM = bloom.Config(8192, 5)


def countmin_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    return countmin.estimate(countmin.build(rows, "l_suppkey", CM), rows, "l_suppkey", CM)


def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").withColumn("qty", F.col("l_quantity").cast("long"))
    return countmin.build(rows, "l_partkey", CM, [FLAG], "qty")


def countmin_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countmin.counters(_quantities(spark, sf_dir), [FLAG])


def countmin_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countmin.counters(countmin.merge(_quantities(spark, sf_dir)))


def countmin_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, a table for each of their numbers in the order, rolled up to all: bounds of every supplier."""
    rows = _table(spark, sf_dir, "lineitem").withColumn("half", F.pmod("l_orderkey", F.lit(2)))
    fine = SketchTable(countmin.build(rows, "l_suppkey", CM, [FLAG, "half"]), [FLAG, "half"], countmin.merge)
    return countmin.estimate(fine.rollup([FLAG]), rows.select(FLAG, "l_suppkey"), "l_suppkey", CM, [FLAG])


def countmin_equal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups of the same weight, rolled up: their totals must add although they are equal."""
    rows = spark.range(210).select((F.col("id") % 3).alias("part"), (F.col("id") % 7).alias("item"))
    fine = SketchTable(countmin.build(rows, "item", CM, ["part"]), ["part"], countmin.merge)
    return countmin.total_weight(fine.rollup())


def countmin_halve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countmin.counters(countmin.halve(_quantities(spark, sf_dir)), [FLAG])


def countmin_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countmin.counters(countmin.decay(_quantities(spark, sf_dir), 0.25), [FLAG])


def _cm_sql(source: str, key: str, columns: str) -> str:
    """CTEs ending in cells: columns, item, row, bucket."""
    ctes, unions = [], []
    for i, seed in enumerate(CM.row_seeds):
        ctes.append(murmur3_sql(source, key, f"{columns}, {key} AS item", f"q{i}_", seed))
        own = ", ".join(c.split(" AS ")[-1].strip() for c in columns.split(","))
        unions.append(f"SELECT {own}, item, {i} AS row, CAST(h1 % {CM.num_buckets} AS INTEGER) AS bucket FROM q{i}_")
    return ",\n".join([*ctes, f"cells AS ({' UNION ALL '.join(unions)})"])


_CM_TABLE_SQL = f"""WITH pre AS (SELECT {FLAG}, l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2),
{_cm_sql("pre", "l_partkey", f"{FLAG}, w")},
tab AS (SELECT {FLAG}, row, bucket, CAST(sum(w) AS BIGINT) AS cnt FROM cells GROUP BY 1, 2, 3),
tot AS (SELECT {FLAG}, CAST(sum(w) AS BIGINT) AS total FROM pre GROUP BY 1),
state AS (SELECT * FROM tab JOIN tot USING ({FLAG}))
"""


def _urls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = _table(spark, sf_dir, "orders")
    return orders.where("o_totalprice > 250000"), _table(spark, sf_dir, "customer")


def bloom_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.build(_urls(spark, sf_dir)[0], "o_custkey", BLOOM)


def bloom_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = _urls(spark, sf_dir)
    return bloom.contains(bloom.build(orders, "o_custkey", BLOOM), customers, "c_custkey", BLOOM)


def bloom_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.statistics(bloom_words(spark, sf_dir), BLOOM)


def _bloom_sides(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    orders = _table(spark, sf_dir, "orders")
    return [bloom.build(orders.where(F.col("o_orderpriority") == p), "o_custkey", BLOOM) for p in ("1-URGENT", "2-HIGH")]


def bloom_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.union(*_bloom_sides(spark, sf_dir))


def bloom_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.intersect(*_bloom_sides(spark, sf_dir))


def bloom_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.invert(bloom_words(spark, sf_dir), BLOOM)


def bloom_contains_and_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "user_id")
    return bloom.contains_and_insert(events, "user_id", BLOOM, "event_id")


def _bloom_sql(source: str, key: str, name: str) -> str:
    """CTEs ending in `name`: item, word, bit."""
    places = ", ".join(f"(((h0 + {i}::UHUGEINT * h1) & 18446744073709551615::UHUGEINT) >> 1) % {BLOOM.num_bits}" for i in range(1, BLOOM.num_hashes + 1))
    return f"""{name}i AS (SELECT DISTINCT {key} AS item FROM {source}),
{xxh64_sql(f"{name}i", "item", "item", "h0", f"{name}x")},
{xxh64_sql(f"{name}x", "item", "item, h0", "h1", f"{name}y", "h0")},
{name} AS (SELECT item, CAST(p // 64 AS INTEGER) AS word, CAST(p % 64 AS INTEGER) AS bit FROM (SELECT item, unnest([{places}]) AS p FROM {name}y))"""


def _words_sql(name: str, out: str) -> str:
    return f"{out} AS (SELECT word, sum(CAST(1 AS HUGEINT) << bit)::UHUGEINT AS bits FROM (SELECT DISTINCT word, bit FROM {name}) GROUP BY word)"


_BLOOM_SQL = f"""WITH src AS (SELECT o_custkey FROM orders WHERE o_totalprice > 250000),
{_bloom_sql("src", "o_custkey", "f")},
{_words_sql("f", "w")}
"""
_BLOOM_TWO_SQL = f"""WITH oa AS (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), ob AS (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH'),
{_bloom_sql("oa", "o_custkey", "fa")},
{_bloom_sql("ob", "o_custkey", "fb")}"""

HITTERS = 64


def _hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.build(_table(spark, sf_dir, "lineitem"), "l_suppkey", HITTERS, [FLAG])


def frequent_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight that is tracked, the offset and the total of each group."""
    return _hitters(spark, sf_dir).groupBy(FLAG).agg(F.coalesce(F.sum("lb"), F.lit(0)).alias("tracked"), F.max("offset").alias("offset"), F.max("weight").alias("weight"))


def frequent_no_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = frequent.build(_table(spark, sf_dir, "events"), "event_type", 8)
    return frequent.frequent_items(state, True)


def frequent_no_false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.frequent_items(_hitters(spark, sf_dir), False)


def frequent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = frequent.build(_table(spark, sf_dir, "lineitem"), "l_linenumber", 64, [FLAG])
    return frequent.rows_of(frequent.merge(state, max_map_size=64)).drop("offset")


def frequent_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purged states of both line statuses and two halves, rolled up by return flag: bounds, offset and weight of what stays."""
    rows = _table(spark, sf_dir, "lineitem").withColumn("half", F.pmod("l_orderkey", F.lit(2)))
    state = frequent.build(rows, "l_suppkey", 16, [FLAG, "half"])
    fine = SketchTable(state, [FLAG, "half"], frequent.merge, {"max_map_size": 16}).rollup([FLAG])
    return frequent.rows_of(fine).join(frequent.facts(fine, [FLAG]).select(FLAG, "weight"), FLAG)


def frequent_equal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups of the same weight and offset, rolled up."""
    rows = spark.range(210).select((F.col("id") % 3).alias("part"), (F.col("id") % 7).alias("item"))
    fine = SketchTable(frequent.build(rows, "item", 8, ["part"]), ["part"], frequent.merge, {"max_map_size": 8})
    return frequent.statistics(fine.rollup())


def frequent_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    state = frequent.build(rows, "l_suppkey", HITTERS)
    return frequent.estimates(state, rows, "l_suppkey")


_FREQ_SQL = f"""WITH c AS (SELECT {FLAG}, l_suppkey AS item, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY {FLAG} ORDER BY n DESC) AS r FROM c),
k AS (SELECT {FLAG}, coalesce(max(CASE WHEN r = {frequent.capacity(HITTERS) + 1} THEN n END), 0) AS cut, CAST(sum(n) AS BIGINT) AS weight FROM r GROUP BY 1)
"""

RANKS = [0.01, 0.25, 0.5, 0.75, 0.99]


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tdigest.build(_table(spark, sf_dir, "lineitem"), "l_extendedprice", [FLAG])


def tdigest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prices(spark, sf_dir).select(FLAG, "min", "max", "weight")


def tdigest_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tdigest.quantiles(_prices(spark, sf_dir), RANKS, [FLAG])


def tdigest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each quantile's exact rank is within 1 % of the one asked for."""
    found = tdigest.quantiles(_prices(spark, sf_dir), RANKS, [FLAG]).select(FLAG, F.posexplode("quantiles").alias("i", "q"))
    rows = _table(spark, sf_dir, "lineitem").join(F.broadcast(found), FLAG)  # five rows a group
    exact = rows.groupBy(FLAG, "i").agg((F.sum(F.when(F.col("l_extendedprice") < F.col("q"), 1.0).when(F.col("l_extendedprice") == F.col("q"), 0.5).otherwise(0.0)) / F.count("*")).alias("rank"))
    wanted = F.element_at(F.array(*map(F.lit, RANKS)), F.col("i") + 1)
    return exact.select(FLAG, F.col("i").cast("int").alias("i"), (F.abs(F.col("rank") - wanted) <= 0.01).alias("within"))


def _ranks_within(spark: SparkSession, sf_dir: str, points: list[float], found: DataFrame, name: str) -> DataFrame:
    """Whether each of the first len(points) values of the array is within 1 % of the share of rows at or below its point (equal ones half)."""
    exact = [(F.avg((F.col("l_extendedprice") < p).cast("double")) + F.avg((F.col("l_extendedprice") == p).cast("double")) / 2) for p in points]
    rows = _table(spark, sf_dir, "lineitem").groupBy(FLAG).agg(F.array(*exact).alias("exact")).join(found, FLAG)
    return rows.select(FLAG, *[(F.abs(F.get(name, i) - F.get("exact", i)) <= 0.01).alias(f"within_{i}") for i in range(len(points))])


def tdigest_rank_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks_within(spark, sf_dir, [20_000.0, 50_000.0], tdigest_rank(spark, sf_dir), "ranks")


def tdigest_cdf_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks_within(spark, sf_dir, [20_000.0, 50_000.0], tdigest_cdf(spark, sf_dir), "cdf")


def tdigest_pmf_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares, added up, against the exact ranks."""
    sums = F.transform(F.array(F.lit(1), F.lit(2)), lambda n: F.aggregate(F.slice("pmf", 1, n), F.lit(0.0), lambda a, x: a + x))
    return _ranks_within(spark, sf_dir, [20_000.0, 50_000.0], tdigest_pmf(spark, sf_dir).select(FLAG, sums.alias("sums")), "sums")


def tdigest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tdigest.ranks(_prices(spark, sf_dir), [20_000.0, 50_000.0], [FLAG])


def tdigest_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tdigest.cdf(_prices(spark, sf_dir), [20_000.0, 50_000.0], [FLAG])


def tdigest_pmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tdigest.pmf(_prices(spark, sf_dir), [20_000.0, 50_000.0], [FLAG])


def tdigest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tdigest.merge(_prices(spark, sf_dir).drop(FLAG)).select("min", "max", "weight")


# --- streams ---


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers of each hour and event type, from a stream over the events that runs until all are read."""
    schema = _table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    found = rollups.windowed_registers(stream, "ts", "user_id", "1 hour", "1 day", ["event_type"], lg_k=6)
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = folder or tempfile.gettempdir()  # where one machine does all
    path = f"{folder}/stream-{uuid.uuid4().hex}"
    query = found.writeStream.outputMode("complete").foreachBatch(rollups.replacing(path)).trigger(availableNow=True).start()
    query.awaitTermination()
    table = rollups.latest(spark, path, query.lastProgress["batchId"])
    return table.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def queries() -> dict[str, Query]:
    own = [f for n, f in globals().items() if callable(f) and n.split("_")[0] in ("theta", "tuple", "hll", "cpc", "countmin", "bloom", "frequent", "tdigest", "stream")]
    return {f.__name__: f for f in own if getattr(f, "__module__", "") == __name__}


#: A CTE e from c (n coupons): the keys that leave n coupons on average, for few against 2^26 slots: two keys leave one with a probability of 2^-26 / 3.
_COUPON_SQL = "e AS (SELECT *, n + n * (n - 1) / 2 / 3 / 67108864 AS e FROM c)"


def oracle_sql() -> dict[str, str]:
    flag_rows = f"SELECT {FLAG}, hash, theta FROM s"
    z = 2.0
    return {
        "theta_distinct": f"WITH {_FLAG_SQL} {_summary_sql('s', FLAG, LG)}",
        "theta_retained": f"WITH {_FLAG_SQL} {flag_rows}",
        "theta_sampled": f"WITH {_theta_sql('lineitem', 'l_orderkey', FLAG, 14, 's', 0.25)} {_summary_sql('s', FLAG, 14)}",
        "theta_exact": f"WITH {_theta_sql('customer', 'c_custkey', 'c_mktsegment', 16, 's')} {_summary_sql('s', 'c_mktsegment', 16)}",
        "theta_bytes": f"WITH {_FLAG_SQL} {flag_rows}",
        "theta_bytes_compressed": f"WITH {_FLAG_SQL} {flag_rows}",
        "theta_text": f"WITH {_TEXTS_SQL}, {_theta_sql('w', 'k', FLAG, LG, 's')} {flag_rows}",
        "theta_text_columns": f"WITH {_TEXTS_SQL}, {_theta_sql('w', 'k', FLAG, LG, 's')} {flag_rows}",
        "theta_unequal": f"""WITH {_SIDES_SQL}, x AS (SELECT {_BY}, hash, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
SELECT x.{_BY}, min(n) = 2 AND min(ta.theta = tb.theta) AS is_equal FROM x JOIN ta USING ({_BY}) JOIN tb USING ({_BY}) GROUP BY 1""",
        "theta_jaccard_within": f"SELECT DISTINCT {_BY}, TRUE AS within FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
        **{n: f"SELECT {FLAG}, count(DISTINCT l_orderkey) AS exact, TRUE AS within FROM lineitem GROUP BY 1" for n in ("theta_within", "hll_within", "hll_sketches_within", "cpc_within")},
        "tuple_bytes": f"{_keyed_sql('sum')} SELECT s.{FLAG}, s.hash, summary FROM s JOIN w ON s.{FLAG} = w.{FLAG} AND s.hash = w.hash",
        "tuple_text": f"""WITH {_TEXTS_SQL}, {_theta_sql('w', 'k', FLAG, LG, 's')}, {murmur3_sql("w", "k", f"{FLAG}, qty", "v")},
x AS (SELECT {FLAG}, CAST(h1 >> 1 AS BIGINT) AS hash, CAST(sum(qty) AS BIGINT) AS summary FROM v GROUP BY 1, 2)
SELECT s.{FLAG}, s.hash, summary FROM s JOIN x ON s.{FLAG} = x.{FLAG} AND s.hash = x.hash""",
        **{n: f"{_REG_SQL} SELECT {FLAG}, slot, value, 10 AS lg_k FROM g" for n in ("hll_bytes", "hll_bytes_6", "hll_bytes_4")},
        "hll_text": f"WITH {_TEXTS_SQL}, {murmur3_sql('w', 'k', FLAG, 'm')} SELECT {FLAG}, CAST(h1 & 1023 AS INTEGER) AS slot, CAST(max({_lead_sql(62)} + 1) AS INTEGER) AS value, 10 AS lg_k FROM m GROUP BY 1, 2",
        "hll_coupon_bytes": f"WITH {murmur3_sql('customer', 'c_custkey', 'c_mktsegment', 'm')} SELECT DISTINCT c_mktsegment, CAST(h1 & 67108863 AS INTEGER) AS slot26, CAST({_lead_sql(62)} + 1 AS INTEGER) AS value FROM m",
        "hll_small": f"""WITH {murmur3_sql('customer', 'c_custkey', 'c_mktsegment', 'm')},
c AS (SELECT c_mktsegment, count(DISTINCT (h1 & 67108863) * 64 + {_lead_sql(62)})::DOUBLE AS n FROM m GROUP BY 1), {_COUPON_SQL} SELECT c_mktsegment, greatest(n, e / (1 + 2 * {hll.COUPON_RSE!r}::DOUBLE)) AS lower, e AS estimate, e / (1 - 2 * {hll.COUPON_RSE!r}::DOUBLE) AS upper FROM e""",
        "hll_modes": f"""WITH {murmur3_sql('nation', 'n_nationkey', 'n_regionkey', 'm')}, p AS (SELECT n_regionkey, (h1 & 67108863) * 64 + {_lead_sql(62)} AS x FROM m),
c AS (SELECT n_regionkey, count(DISTINCT x)::DOUBLE AS n FROM p GROUP BY 1 UNION ALL SELECT NULL, count(DISTINCT x)::DOUBLE FROM p), {_COUPON_SQL}
SELECT n_regionkey, CASE WHEN n < 8 THEN 'list' ELSE 'set' END AS mode, 12 AS lg_k, FALSE AS is_empty, greatest(n, e / (1 + 2 * {hll.COUPON_RSE!r}::DOUBLE)) AS lower, e AS estimate, e / (1 - 2 * {hll.COUPON_RSE!r}::DOUBLE) AS upper FROM e""",
        "hll_linear": f"""WITH {murmur3_sql('customer', 'c_custkey', 'c_mktsegment', 'm')},
c AS (SELECT c_mktsegment, count(DISTINCT h1 & 32767) AS hit FROM m GROUP BY 1),
e AS (SELECT c_mktsegment, any_value(hit) AS hit, 32768 * sum(1::DOUBLE / i) AS e FROM c JOIN range(1, 32769) r(i) ON i > 32768 - hit GROUP BY 1)
SELECT c_mktsegment, greatest(e / (1 + {hll_error(15, 2, False)!r}::DOUBLE), hit) AS lower, e AS estimate, e / (1 + ({hll_error(15, 2, True)!r})::DOUBLE) AS upper FROM e""",
        "cpc_text": f"""WITH {_TEXTS_SQL}, {murmur3_sql('w', 'k', FLAG, 'm')}, c AS (SELECT DISTINCT {FLAG}, CAST(h1 & 1023 AS INTEGER) AS row, CAST({_lead_sql(63)} AS INTEGER) AS col FROM m),
p AS (SELECT {FLAG}, row, sum(CAST(1 AS HUGEINT) << col)::UHUGEINT AS bits FROM c GROUP BY 1, 2) SELECT {FLAG}, row, {_BITS_SQL} AS bits, 10 AS lg_k FROM p""",
        "cpc_inverse": f"{_CPC_SQL} SELECT {FLAG}, count(*) AS num_coupons FROM c GROUP BY 1",
        "cpc_ordered": f"""WITH {murmur3_sql('events', 'user_id', 'event_type, event_id', 'm')},
c AS (SELECT event_type, CAST(h1 & 1023 AS INTEGER) AS row, CAST({_lead_sql(63)} AS INTEGER) AS col, min(event_id) AS since FROM m GROUP BY 1, 2, 3),
b AS (SELECT event_type, coalesce(sum(pow(2::DOUBLE, -(col + 1))) OVER (PARTITION BY event_type ORDER BY since, row, col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM c)
SELECT event_type, sum(1024 / (1024 - gone)) AS estimate FROM b GROUP BY 1""",
        "bloom_bytes": f"{_BLOOM_SQL} SELECT word, {_BITS_SQL} AS bits FROM w",
        "bloom_text": f"WITH src AS (SELECT k FROM (SELECT {_TEXTS_SQL.split('SELECT', 1)[1].rsplit(' FROM', 1)[0]} FROM lineitem WHERE l_quantity > 45)), {_bloom_sql('src', 'k', 'f')}, {_words_sql('f', 'w')} SELECT word, {_BITS_SQL} AS bits FROM w",
        "countmin_bytes": f"{_CM_TABLE_SQL} SELECT * FROM state",
        "countmin_text": f"""WITH {_TEXTS_SQL}, pre AS (SELECT {FLAG}, k, count(*) AS n FROM w GROUP BY 1, 2),
{_cm_sql("pre", "k", f"{FLAG}, n")}
SELECT {FLAG}, row, bucket, CAST(sum(n) AS BIGINT) AS cnt, any_value(total) AS total FROM cells JOIN (SELECT {FLAG}, count(*) AS total FROM lineitem GROUP BY 1) USING ({FLAG}) GROUP BY 1, 2, 3""",
        "frequent_bytes": f"{_FREQ_SQL} SELECT {FLAG}, item, n AS estimate, n - cut AS lower_bound, n AS upper_bound FROM c JOIN k USING ({FLAG}) WHERE n > cut",
        "frequent_text": f"{_FREQ_SQL} SELECT {FLAG}, lpad(CAST(item AS VARCHAR), 8, '0') AS item, n AS estimate, n - cut AS lower_bound, n AS upper_bound FROM c JOIN k USING ({FLAG}) WHERE n > cut",
        "tdigest_bytes": f"SELECT {FLAG}, min(l_extendedprice) AS min, max(l_extendedprice) AS max, count(*) AS weight FROM lineitem GROUP BY 1",
        **{n: f"SELECT DISTINCT {FLAG}, TRUE AS within_0, TRUE AS within_1 FROM lineitem" for n in ("tdigest_rank_within", "tdigest_cdf_within", "tdigest_pmf_within")},
        "theta_rollup": f"WITH {_FLAG_SQL} {_summary_sql('s', FLAG, LG)}",
        "theta_compact": f"WITH {_FLAG_SQL} {_summary_sql('s', FLAG, LG)}",
        "theta_bounds": f"""WITH {_FLAG_SQL},
g AS (SELECT {FLAG}, count(*)::DOUBLE AS n, min(theta)::DOUBLE / {MAX}::DOUBLE AS t FROM s GROUP BY 1),
b AS (SELECT *, {z} * sqrt((1 - t) / t) AS b, (n - 0.5) / t AS lo, (n + 0.5) / t AS hi FROM g)
SELECT {FLAG}, CASE WHEN t >= 1 THEN n ELSE least(greatest(lo + b * b / 2 - b / 2 * sqrt(b * b + 4 * lo), n), n / t) END AS lower, n / t AS estimate,
  CASE WHEN t >= 1 THEN n ELSE greatest(hi + b * b / 2 + b / 2 * sqrt(b * b + 4 * hi), n / t) END AS upper FROM b""",
        "theta_union": f"WITH {_UNION_SQL} {_summary_sql('u', _BY, 7)}",
        "theta_intersection": f"WITH {_SIDES_SQL}, k AS (SELECT a.{_BY}, a.hash FROM a JOIN b ON a.{_BY} = b.{_BY} AND a.hash = b.hash) {_kept_sql('k')}",
        "theta_a_not_b": f"WITH {_SIDES_SQL}, k AS (SELECT a.{_BY}, a.hash FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.{_BY} = b.{_BY} AND a.hash = b.hash)) {_kept_sql('k')}",
        "theta_jaccard": f"""WITH {_SIDES_SQL}, x AS (SELECT {_BY}, hash, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
SELECT t.{_BY}, count(*) FILTER (n = 2) / count(*)::DOUBLE AS estimate FROM t JOIN x ON t.{_BY} = x.{_BY} AND x.hash < t.theta GROUP BY 1""",
        "theta_exactly_equal": f"SELECT DISTINCT {_BY}, TRUE AS is_equal FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
        "tuple_retained": f"{_keyed_sql('sum')} SELECT s.{FLAG}, s.hash, summary FROM s JOIN w ON s.{FLAG} = w.{FLAG} AND s.hash = w.hash",
        "tuple_max": f"{_keyed_sql('max')} SELECT s.{FLAG}, s.hash, summary FROM s JOIN w ON s.{FLAG} = w.{FLAG} AND s.hash = w.hash",
        "tuple_subset_sum": f"{_keyed_sql('sum')} SELECT s.{FLAG}, sum(summary)::DOUBLE / (min(s.theta)::DOUBLE / {MAX}::DOUBLE) AS sum_estimate FROM s JOIN w ON s.{FLAG} = w.{FLAG} AND s.hash = w.hash GROUP BY 1",
        "tuple_union": f"{_COUNTS_SQL} SELECT u.{_BY}, u.hash, CASE WHEN a.hash IS NULL THEN nab - na WHEN b.hash IS NULL THEN na ELSE nab END AS summary FROM u JOIN n ON u.{_BY} = n.{_BY} AND u.hash = n.hash LEFT JOIN a ON u.{_BY} = a.{_BY} AND u.hash = a.hash LEFT JOIN b ON u.{_BY} = b.{_BY} AND u.hash = b.hash",
        "tuple_intersection": f"{_COUNTS_SQL} SELECT a.{_BY}, a.hash, nab AS summary FROM a JOIN b ON a.{_BY} = b.{_BY} AND a.hash = b.hash JOIN t ON a.{_BY} = t.{_BY} AND a.hash < t.theta JOIN n ON a.{_BY} = n.{_BY} AND a.hash = n.hash",
        "tuple_a_not_b": f"{_COUNTS_SQL} SELECT a.{_BY}, a.hash, na AS summary FROM a JOIN t ON a.{_BY} = t.{_BY} AND a.hash < t.theta JOIN n ON a.{_BY} = n.{_BY} AND a.hash = n.hash WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.{_BY} = b.{_BY} AND a.hash = b.hash)",
        "hll_registers": f"{_REG_SQL} SELECT {FLAG}, slot, value, 10 AS lg_k FROM g",
        "hll_union": f"{_REG_SQL} SELECT {FLAG}, slot, value, 10 AS lg_k FROM g",
        "hll_classic": f"""{_REG_SQL}, f AS (SELECT {FLAG}, count(*) AS hit, sum(pow(2.0, -value)) + 1024 - count(*) AS z FROM g GROUP BY 1),
r AS (SELECT *, 0.7213::DOUBLE / (1 + 1.079::DOUBLE / 1024) * 1024 * 1024 / z AS raw FROM f)
SELECT {FLAG}, CASE WHEN raw <= 2560 AND hit < 1024 THEN 1024 * ln(1024.0 / (1024 - hit)) ELSE raw END AS estimate FROM r""",
        "cpc_state": f"{_CPC_SQL} SELECT {FLAG}, row, {_BITS_SQL} AS bits, 10 AS lg_k FROM p",
        "cpc_union": f"{_CPC_SQL} SELECT {FLAG}, row, {_BITS_SQL} AS bits, 10 AS lg_k FROM p",
        "cpc_coupons": f"{_CPC_SQL} SELECT {FLAG}, 10 AS lg_k, count(*) AS num_coupons, FALSE AS is_empty FROM c GROUP BY 1",
        "countmin_estimates": f"""WITH pre AS (SELECT l_suppkey, count(*) AS w FROM lineitem GROUP BY 1),
{_cm_sql("pre", "l_suppkey", "w")},
tab AS (SELECT row, bucket, CAST(sum(w) AS BIGINT) AS cnt FROM cells GROUP BY 1, 2)
SELECT item AS l_suppkey, min(cnt) AS estimate, min(cnt) AS lower_bound,
  min(cnt) + CAST(floor((SELECT sum(w) FROM pre) * ({CM.relative_error!r})::DOUBLE) AS BIGINT) AS upper_bound FROM cells JOIN tab USING (row, bucket) GROUP BY 1""",
        "countmin_table": f"{_CM_TABLE_SQL} SELECT * FROM state",
        "countmin_merge": f"{_CM_TABLE_SQL} SELECT row, bucket, CAST(sum(cnt) AS BIGINT) AS cnt, (SELECT CAST(sum(total) AS BIGINT) FROM tot) AS total FROM state GROUP BY 1, 2",
        "countmin_rollup": f"""WITH pre AS (SELECT {FLAG}, l_suppkey, count(*) AS w FROM lineitem GROUP BY 1, 2),
{_cm_sql("pre", "l_suppkey", f"{FLAG}, w")},
tab AS (SELECT {FLAG}, row, bucket, CAST(sum(w) AS BIGINT) AS cnt FROM cells GROUP BY 1, 2, 3), tot AS (SELECT {FLAG}, sum(w) AS total FROM pre GROUP BY 1)
SELECT {FLAG}, item AS l_suppkey, min(cnt) AS estimate, min(cnt) AS lower_bound, min(cnt) + CAST(floor(max(total) * ({CM.relative_error!r})::DOUBLE) AS BIGINT) AS upper_bound
FROM cells JOIN tab USING ({FLAG}, row, bucket) JOIN tot USING ({FLAG}) GROUP BY 1, 2""",
        "countmin_equal_groups": "SELECT 210::BIGINT AS total_weight, FALSE AS is_empty",
        "frequent_equal_groups": "SELECT count(*) FILTER (n > cut) AS num_active, 210::BIGINT AS total_weight, max(cut) AS maximum_error, count(*) FILTER (n > cut) = 0 AS is_empty FROM (SELECT item, sum(n) AS n, CAST(30 AS BIGINT) AS cut FROM (SELECT range % 7 AS item, 1 AS n FROM range(210)) GROUP BY 1)",
        "frequent_rollup": f"""WITH c AS (SELECT {FLAG}, l_orderkey % 2 AS half, l_suppkey AS item, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY {FLAG}, half ORDER BY n DESC) AS r FROM c),
k AS (SELECT {FLAG}, half, coalesce(max(CASE WHEN r = 13 THEN n END), 0) AS cut, sum(n) AS weight FROM r GROUP BY 1, 2),
m AS (SELECT {FLAG}, item, CAST(sum(n - cut) AS BIGINT) AS lb FROM c JOIN k USING ({FLAG}, half) WHERE n > cut GROUP BY 1, 2),
t AS (SELECT {FLAG}, sum(cut) AS offset_, CAST(sum(weight) AS BIGINT) AS weight FROM k GROUP BY 1),
s AS (SELECT *, row_number() OVER (PARTITION BY {FLAG} ORDER BY lb DESC) AS r FROM m),
f AS (SELECT {FLAG}, coalesce(max(CASE WHEN r = 13 THEN lb END), 0) AS cut FROM s GROUP BY 1)
SELECT {FLAG}, item, CAST(lb + offset_ AS BIGINT) AS estimate, lb - cut AS lower_bound, CAST(lb + offset_ AS BIGINT) AS upper_bound, CAST(offset_ + cut AS BIGINT) AS offset, weight
FROM m JOIN f USING ({FLAG}) JOIN t USING ({FLAG}) WHERE lb > cut""",
        "countmin_halve": f"{_CM_TABLE_SQL} SELECT {FLAG}, row, bucket, cnt // 2 AS cnt, total // 2 AS total FROM state",
        "countmin_decay": f"{_CM_TABLE_SQL} SELECT {FLAG}, row, bucket, CAST(floor(cnt * 0.25) AS BIGINT) AS cnt, CAST(floor(total * 0.25) AS BIGINT) AS total FROM state",
        "bloom_words": f"{_BLOOM_SQL} SELECT word, {_BITS_SQL} AS bits FROM w",
        "bloom_invert": f"{_BLOOM_SQL}, v AS (SELECT r.range AS word, 18446744073709551615::UHUGEINT - coalesce(bits, 0::UHUGEINT) AS bits FROM range({BLOOM.words}) r LEFT JOIN w ON r.range = w.word) SELECT CAST(word AS INTEGER) AS word, {_BITS_SQL} AS bits FROM v WHERE bits <> 0",
        "bloom_statistics": f"{_BLOOM_SQL}, n AS (SELECT count(*) AS b FROM (SELECT DISTINCT word, bit FROM f)) SELECT b AS bits_used, {BLOOM.num_bits}::BIGINT AS capacity, {BLOOM.num_hashes} AS num_hashes, b / {BLOOM.num_bits}::DOUBLE AS load_factor, pow(b / {BLOOM.num_bits}::DOUBLE, {BLOOM.num_hashes}) AS estimated_fpp, b = 0 AS is_empty FROM n",
        "bloom_contains": f"{_BLOOM_SQL}, {_bloom_sql('customer', 'c_custkey', 'q')}, h AS (SELECT DISTINCT word, bit FROM f) SELECT item AS c_custkey, bool_and(h.word IS NOT NULL) AS might_contain FROM q LEFT JOIN h ON q.word = h.word AND q.bit = h.bit GROUP BY 1",
        "bloom_union": f"{_BLOOM_TWO_SQL}, fu AS (SELECT * FROM fa UNION ALL SELECT * FROM fb), {_words_sql('fu', 'w')} SELECT word, {_BITS_SQL} AS bits FROM w",
        "bloom_intersect": f"{_BLOOM_TWO_SQL}, fu AS (SELECT DISTINCT fa.word, fa.bit FROM fa JOIN fb ON fa.word = fb.word AND fa.bit = fb.bit), {_words_sql('fu', 'w')} SELECT word, {_BITS_SQL} AS bits FROM w",
        "frequent_state": f"{_FREQ_SQL} SELECT {FLAG}, CAST(coalesce(sum(n - cut) FILTER (n > cut), 0) AS BIGINT) AS tracked, max(cut) AS offset, max(weight) AS weight FROM c JOIN k USING ({FLAG}) GROUP BY 1",
        "frequent_no_false_positives": "SELECT event_type AS item, count(*) AS estimate, count(*) AS lower_bound, count(*) AS upper_bound FROM events GROUP BY 1",
        "frequent_no_false_negatives": f"{_FREQ_SQL} SELECT {FLAG}, item, n AS estimate, n - cut AS lower_bound, n AS upper_bound FROM c JOIN k USING ({FLAG}) WHERE n > cut",
        "frequent_estimates": f"""WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1),
k AS (SELECT coalesce((SELECT n FROM c ORDER BY n DESC LIMIT 1 OFFSET {frequent.capacity(HITTERS)}), 0) AS cut)
SELECT l_suppkey, CASE WHEN n > cut THEN n ELSE 0 END AS estimate, CASE WHEN n > cut THEN n - cut ELSE 0 END AS lower_bound, CASE WHEN n > cut THEN n ELSE cut END AS upper_bound FROM c CROSS JOIN k""",
        "bloom_contains_and_insert": f"""WITH {_bloom_sql("events", "user_id", "f")},
s AS (SELECT user_id AS item, min(event_id) AS first FROM events GROUP BY 1),
b AS (SELECT word, bit, min(first) AS since FROM f JOIN s USING (item) GROUP BY 1, 2),
a AS (SELECT item, max(since) AS known FROM f JOIN b USING (word, bit) GROUP BY 1)
SELECT event_id, user_id, known < event_id AS was_there FROM events JOIN a ON events.user_id = a.item""",
        "frequent_merge": "SELECT l_linenumber AS item, count(*) AS estimate, count(*) AS lower_bound, count(*) AS upper_bound FROM lineitem GROUP BY 1",
        "stream_windows": f"""WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type, user_id FROM events),
{murmur3_sql("e", "user_id", "w, event_type", "m")}
SELECT w AS window_start, event_type, CAST(h1 & 63 AS INTEGER) AS slot, CAST(max({_lead_sql(62)} + 1) AS INTEGER) AS value, 6 AS lg_k FROM m GROUP BY 1, 2, 3""",
        "tdigest_facts": f"SELECT {FLAG}, min(l_extendedprice) AS min, max(l_extendedprice) AS max, count(*) AS weight FROM lineitem GROUP BY 1",
        "tdigest_rollup": "SELECT min(l_extendedprice) AS min, max(l_extendedprice) AS max, count(*) AS weight FROM lineitem",
        "tdigest_within": f"SELECT DISTINCT {FLAG}, CAST(i AS INTEGER) AS i, TRUE AS within FROM lineitem CROSS JOIN range({len(RANKS)}) r(i)",
    }
