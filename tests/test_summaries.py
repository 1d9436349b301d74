"""The summaries against exact answers, algebraic laws, and Spark's own functions."""

import math
import re
import struct
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchwright.errors import SketchArgumentError, SketchDataError
from sketchwright.functions import bounds, hashing
from sketchwright.functions.coupons import distinct_for, expected_coupons
from sketchwright.functions.relative_errors import hll_error
from sketchwright.operators import bloom, countmin, cpc, frequent, hll, tdigest, theta, tuples
from sketchwright.plans import queries
from sketchwright.plans.rollup import SketchTable
from sketchwright.sources import codecs, tables
from sketchwright.streaming import rollups


def one(df):
    return df.collect()[0]


def sketch(spark, a, b, **how):
    return theta.build(spark.range(a, b), "id", **how)


# --- hashing ---


def test_murmur3_columns_agree_with_bytes(spark):
    keys = [0, 1, -1, 7, 2**63 - 1, -(2**63), 123456789]
    df = hashing.with_murmur3(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    for r in df.collect():
        assert (r.h1, r.h2) == tuple(map(hashing.signed, hashing.murmur3_bytes(struct.pack("<q", r.k))))
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_murmur3_strings_and_seed_hash(spark):
    texts = ["", "a", "0123456789abcdef", "0123456789abcdefg", "é" * 40, None]
    rows = hashing.with_hash(spark.createDataFrame([(t,) for t in texts], "k string"), "k").collect()
    assert rows[0].h1 is None and rows[-1].h1 is None
    for r in rows[1:-1]:
        assert (r.h1, r.h2) == tuple(map(hashing.signed, hashing.murmur3_bytes(r.k.encode())))
    assert hashing.seed_hash(9001) == 0x93CC


def test_xxh64(spark):
    import xxhash

    df = hashing.with_xxh64(hashing.with_xxh64(spark.range(-3, 5), "id", "a"), "id", "b", "a")
    for r in df.collect():
        first = xxhash.xxh64_intdigest(struct.pack("<q", r.id), 9001)
        assert r.a == hashing.signed(first) and r.b == hashing.signed(xxhash.xxh64_intdigest(struct.pack("<q", r.id), first))


def test_canonical_values(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (1.5,), (None,)], "x double").select(hashing.canonical_bits(F.col("x")).alias("b"))
    assert [r.b for r in df.collect()] == [0, 0, 0x7FF8000000000000, struct.unpack("<q", struct.pack("<d", 1.5))[0], None]
    widened = spark.createDataFrame([(2**32 - 1,)], "x long").select(hashing.sign_extended(F.col("x"), 32).alias("s"), hashing.natural_extended(F.col("x")).alias("n"))
    assert one(widened) == (-1, 2**32 - 1)
    with pytest.raises(SketchArgumentError):
        hashing.with_hash(spark.range(1).select(F.current_date().alias("k")), "k")


# --- theta ---


@pytest.mark.parametrize("n", [0, 1, 10, 100, 5000, 100_000])
def test_theta_estimates(spark, n):
    r = one(theta.summary(sketch(spark, 0, n)))
    assert r.is_empty == (n == 0) and abs(r.estimate - n) <= 0.06 * n
    if n <= 4096:
        assert r.estimate == n and not r.is_estimation_mode


def test_theta_is_the_same_by_the_built_in_and_by_columns(spark):
    for n in (0, 100, 60_000):
        a, b = (sorted(map(str, sketch(spark, 0, n, lg_k=8, native=p).collect())) for p in (True, False))
        assert a == b
    df = spark.range(20_000).select(F.when(F.col("id") % 9 > 0, F.col("id").cast("string")).alias("k"), (F.col("id") % 3).alias("g"))
    df = df.unionByName(spark.createDataFrame([(None, 7), ("", 8), ("x", None)], "k string, g long"))
    a, b = (sorted(map(str, theta.build(df, "k", ["g"], lg_k=7, native=p).collect())) for p in (True, False))
    assert a == b


def test_tuples_are_the_same_by_both_ways(spark, monkeypatch):
    df = spark.range(20_000).select((F.col("id") % 7000).alias("k"), (F.col("id") % 3).alias("g"), F.lit(2).alias("v"))
    df = df.unionByName(spark.createDataFrame([(None, 7, 1), (5, None, 1)], "k long, g long, v int"))
    ways = [sorted(map(str, tuples.build(df, "k", "v", ["g"], lg_k=7).collect())), sorted(map(str, tuples.build(df, "k", "v", lg_k=7).collect()))]
    monkeypatch.setattr(theta, "NATIVE_TYPES", ())
    assert ways == [sorted(map(str, tuples.build(df, "k", "v", ["g"], lg_k=7).collect())), sorted(map(str, tuples.build(df, "k", "v", lg_k=7).collect()))]


def test_theta_agrees_with_the_built_in(spark):
    rows = spark.range(3000)
    stored = one(rows.agg(F.theta_sketch_agg("id", 12).alias("s"))).s
    ours = {r.hash for r in theta.build(rows, "id").collect()}
    assert set(codecs.decode_theta(bytes(stored)).hashes) == ours
    back = tables.theta_to_binary(theta.build(rows, "id"))
    assert one(back.select(F.theta_sketch_estimate("sketch"))) == (3000,)


def test_theta_set_operations(spark):
    a, b = sketch(spark, 0, 10_000), sketch(spark, 5_000, 15_000)
    assert one(theta.estimate(theta.union(a, b))).estimate == pytest.approx(15_000, rel=0.05)
    assert one(theta.estimate(theta.intersection(a, b))).estimate == pytest.approx(5_000, rel=0.06)
    assert one(theta.estimate(theta.a_not_b(a, b))).estimate == pytest.approx(5_000, rel=0.06)
    j = one(theta.jaccard(a, b))
    assert j.lower < j.estimate < j.upper and abs(j.estimate - 1 / 3) < 0.03
    assert sorted(theta.union(a, b).collect()) == sorted(theta.union(b, a, b).collect())
    assert one(theta.exactly_equal(theta.union(a, a), a)).is_equal and not one(theta.exactly_equal(a, b)).is_equal


def test_theta_corner_states(spark):
    empty, some, far = sketch(spark, 0, 0), sketch(spark, 0, 50), sketch(spark, 100, 150)
    sampled = theta.build(spark.range(1), "id", p=0.001)
    assert one(theta.summary(empty)).is_empty and one(theta.summary(empty)).theta == theta.MAX_THETA
    r = one(theta.summary(sampled))
    assert not r.is_empty and r.estimate == 0 and r.theta == pytest.approx(0.001 * theta.MAX_THETA)
    assert one(theta.summary(theta.intersection(some, far))).is_empty
    assert one(theta.summary(theta.intersection(some, empty))).is_empty
    assert one(theta.summary(theta.a_not_b(some, empty))).estimate == 50
    assert one(theta.summary(theta.a_not_b(some, some))).is_empty
    assert one(theta.summary(theta.union(empty, some))).estimate == 50
    assert tuple(one(theta.jaccard(empty, empty))) == (1, 1, 1)
    assert tuple(one(theta.jaccard(empty, some))) == (0, 0, 0)
    assert tuple(one(theta.jaccard(some, some))) == (1, 1, 1)
    with pytest.raises(SketchArgumentError):
        theta.build(spark.range(1), "id", lg_k=4)
    with pytest.raises(SketchArgumentError):
        theta.build(spark.range(1), "id", p=0)


def test_theta_groups_with_null_and_rollup(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") % 2).alias("h"))
    by_g = {r.g: r.estimate for r in theta.estimate(theta.build(df, "id", ["g"]), ["g"]).collect()}
    assert by_g == {None: 1000, 1: 1000, 2: 1000}
    table = SketchTable(theta.build(df, "id", ["g", "h"]), ["g", "h"], theta.union)
    assert {r.g: r.estimate for r in theta.estimate(table.rollup(["g"]), ["g"]).collect()} == by_g
    assert one(theta.estimate(table.rollup())).estimate == 3000
    cube = table.cube(["g", "h"], theta.estimate).collect()
    assert len(cube) == 6 + 3 + 2 + 1
    with pytest.raises(SketchArgumentError):
        table.rollup(["x"])


def test_theta_bounds(spark):
    exact = one(theta.bounds(sketch(spark, 0, 100), 3))
    assert tuple(exact) == (100, 100, 100)
    state = sketch(spark, 0, 50_000, lg_k=8)
    last = None
    for k in (1, 2, 3):
        r = one(theta.bounds(state, k))
        assert r.lower < r.estimate < r.upper
        if last:
            assert r.lower <= last.lower and r.upper >= last.upper
        last = r
    assert last.lower < 50_000 < last.upper


def test_small_sample_bounds_are_binomial():
    def at_most(n, x, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1))

    for n in (1, 2, 10, 50, 120):
        for t in (0.5, 0.1, 0.01):
            for k in (1, 2, 3):
                low, high, tail = bounds.sampled_lower(n, t, k), bounds.sampled_upper(n, t, k), bounds.TAILS[k]
                assert low <= n / t <= high
                if n > 1 and low > n:
                    assert 1 - at_most(int(low), n - 1, t) <= tail + 1e-9
                assert at_most(math.ceil(high), n, t) <= tail + 1e-9
                near = bounds._normal(n, t, k, 1)
                assert n < 100 or high == pytest.approx(near, rel=0.03)


# --- tuple ---


def test_tuple_sums(spark):
    df = spark.createDataFrame([("shared", 2), ("shared", 3), ("other", 7)], "k string, v long")
    assert sorted(r.summary for r in tuples.build(df, "k", "v").collect()) == [5, 7]
    text = tuples.build(df.withColumn("v", F.col("v").cast("string")), "k", "v", policy=tuples.TEXT)
    assert sorted(r.summary for r in text.collect()) == ["23", "7"]
    arrays = tuples.build(df.withColumn("v", F.array(F.col("v").cast("double"), F.lit(1.0))), "k", "v", policy=tuples.ARRAY_SUM)
    assert sorted(r.summary for r in arrays.collect()) == [[5.0, 2.0], [7.0, 1.0]]


def test_tuple_set_operations(spark):
    a = tuples.build(spark.range(0, 1000).withColumn("v", F.lit(1)), "id", "v")
    b = tuples.build(spark.range(500, 1500).withColumn("v", F.lit(10)), "id", "v")
    assert one(tuples.subset_sum(tuples.union(a, b))).sum_estimate == 11_000
    assert one(tuples.subset_sum(tuples.intersection(a, b, policy=tuples.SUM))).sum_estimate == 5_500
    assert one(tuples.subset_sum(tuples.a_not_b(a, b))).sum_estimate == 500
    assert one(tuples.estimate(tuples.a_not_b(a, sketch(spark, 0, 900)))).estimate == 100
    assert one(tuples.jaccard(a, b)).estimate == pytest.approx(1 / 3)
    assert one(tuples.exactly_equal(a, a)).is_equal
    with pytest.raises(SketchArgumentError):
        tuples.intersection(a, b)
    big = tuples.build(spark.range(50_000).withColumn("v", F.lit(2)), "id", "v", lg_k=9)
    assert one(tuples.subset_sum(big)).sum_estimate == pytest.approx(100_000, rel=0.15)
    assert one(tuples.summary(tuples.build(spark.range(0).withColumn("v", F.lit(2)), "id", "v"))).is_empty


# --- hll and cpc ---


def test_hll_registers_are_the_built_in_ones(spark):
    rows = spark.range(20_000)
    theirs = codecs.decode_hll(bytes(one(rows.agg(F.hll_sketch_agg("id", 12).alias("s"))).s))
    ours = np.zeros(4096, np.uint8)
    for r in hll.build(rows, "id").collect():
        ours[r.slot] = r.value
    assert (ours == theirs.registers).all()


@pytest.mark.parametrize("n", [0, 1, 100, 10_000, 200_000])
def test_hll_estimates(spark, n):
    state = hll.build(spark.range(n), "id")
    assert one(hll.estimate(state)).estimate == pytest.approx(n, rel=0.05)
    assert one(hll.classic_estimate(state)).estimate == pytest.approx(n, rel=0.06)
    assert one(hll.ordered_estimate(spark.range(n), "id")).estimate == pytest.approx(n, rel=0.05)
    b = one(hll.bounds(state, 3))
    assert b.lower <= n <= b.upper or n == 0


def test_hll_merging_laws(spark):
    parts = [hll.build(spark.range(a, a + 30_000), "id", lg_k=k) for a, k in ((0, 12), (20_000, 11), (40_000, 13))]
    whole = hll.build(spark.range(70_000), "id", lg_k=11)
    want = sorted(whole.collect())
    assert sorted(hll.union(*parts).select(whole.columns).collect()) == want
    assert sorted(hll.union(parts[2], hll.union(parts[1], parts[0])).select(whole.columns).collect()) == want
    assert sorted(hll.downsample(parts[2], 5).collect()) == sorted(hll.build(spark.range(40_000, 70_000), "id", lg_k=5).select("slot", "value", "lg_k").collect())
    small = one(hll.small_estimate(hll.coupons(spark.range(500), "id")))
    assert small.lower <= 500 <= small.upper and abs(small.estimate - 500) < 0.01


def test_hll_stored_forms(spark):
    state = hll.build(spark.range(5000), "id", lg_k=10)
    stored = hll.to_binary(state)
    assert sorted(tables.hll_from_binary(stored).select(state.columns).collect()) == sorted(state.collect())
    registers = np.random.default_rng(1).integers(0, 40, 1024).astype(np.uint8)
    for bits in (4, 6, 8):
        assert (codecs.decode_hll(codecs.encode_hll(registers, bits)).registers == registers).all()
    for n in (5, 50):
        few = codecs.decode_hll(bytes(one(spark.range(n).agg(F.hll_sketch_agg("id", 12).alias("s"))).s))
        assert set(few.coupons) == {(r.slot26, r.value) for r in hll.coupons(spark.range(n), "id").collect()}
    with pytest.raises(SketchDataError):
        codecs.decode_hll(b"\x0a\x01\x08")


def test_hll_small_summaries_keep_their_coupons(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 5, "few").when(F.col("id") < 300, "some").otherwise("many").alias("g"))
    found = {r.g: r for r in hll.read(hll.sketches(df, "id", ["g"]), 2, ["g"]).collect()}
    assert [found[g].mode for g in ("few", "some", "many")] == ["list", "set", "registers"]
    assert abs(found["few"].estimate - 5) < 1e-3 and abs(found["some"].estimate - 295) < 1e-3
    assert all(found[g].lower <= n <= found[g].upper for g, n in (("few", 5), ("some", 295), ("many", 2700)))
    whole = one(hll.read(hll.merge_sketches(hll.sketches(df, "id", ["g"]))))
    assert whole.is_merged and whole.estimate == pytest.approx(3000, rel=0.03)
    small = one(hll.read(hll.merge_sketches(hll.sketches(df, "id", ["g"]).where("g = 'few'"))))
    assert small.mode == "list" and abs(small.estimate - 5) < 1e-3
    assert one(hll.read(hll.sketches(spark.range(0), "id"))).is_empty
    state = hll.build(spark.range(100), "id")
    assert one(hll.estimate(state)).estimate == pytest.approx(100, abs=4) and one(hll.estimate(state)).estimate % 1 > 0


def test_hll_linear_counts_empty_slots_however_few(spark, tmp_path):
    keys = {"few": 1_000, "many": 200_000, "all": 600_000}  # of the last, no slot of 32768 stays empty
    rows = spark.range(600_000).select(F.col("id").alias("c_custkey"), F.explode(F.array(*map(F.lit, keys))).alias("c_mktsegment"))
    rows.where(F.col("c_custkey") < F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])[F.col("c_mktsegment")]).write.parquet(f"{tmp_path}/customer.parquet")
    found = {r.c_mktsegment: r for r in queries.hll_linear(spark, str(tmp_path)).collect()}
    hit = {r.c_mktsegment: r.hit for r in hll.facts(hll.build(spark.read.parquet(f"{tmp_path}/customer.parquet"), "c_custkey", ["c_mktsegment"], lg_k=15), ["c_mktsegment"]).collect()}
    assert hit["few"] < 1_000 and 32_000 < hit["many"] < hit["all"] == 32768
    for g, h in hit.items():
        want = 32768 * math.fsum(1 / i for i in range(32768 - h + 1, 32769))
        assert found[g].estimate == pytest.approx(want, rel=1e-12)
        assert found[g].lower == pytest.approx(max(h, want / (1 + hll_error(15, 2, False))), rel=1e-12)
        assert found[g].upper == pytest.approx(want / (1 + hll_error(15, 2, True)), rel=1e-12)
    assert tuple(one(hll.linear_bounds(hll.build(spark.range(0), "id")))) == (0, 0, 0)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 300])
def test_hll_coupon_bytes_are_read_by_the_built_in(spark, n):
    rows = hll.coupons(spark.range(n), "id")
    stored = tables.hll_coupons_to_binary(rows) if n else spark.createDataFrame([(bytearray(codecs.encode_hll_coupons([], 12)),)], "sketch binary")
    assert one(stored.select(F.hll_sketch_estimate("sketch")))[0] == n
    assert sorted(tables.hll_coupons_from_binary(stored).collect()) == sorted(rows.distinct().collect())


def test_hll_coupons_of_large_groups_stay_packed(spark, capsys):
    rows = hll.coupons(spark.range(50_000), "id")
    stored = tables.hll_coupons_to_binary(rows.unionByName(rows))
    data, want = bytes(one(stored).sketch), sorted(rows.distinct().collect())
    tracemalloc.start()
    found = codecs.decode_hll(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(data) == 12 + 4 * len(want) and peak < 20 * len(want)
    assert sorted(found.coupons) == want and codecs.encode_hll_coupons(found.coupons * 2, 12) == data
    back = tables.hll_coupons_from_binary(stored.unionByName(spark.createDataFrame([(None,)], "sketch binary")))
    assert sorted(back.collect()) == want
    tables.hll_coupons_from_binary(stored).explain()
    assert len(re.findall(r"\bpack\(", capsys.readouterr().out)) == 1  # the bytes are made once
    state = hll.build(spark.range(50_000), "id", lg_k=12)
    assert sorted(tables.hll_from_binary(stored).select(state.columns).collect()) == sorted(state.collect())
    for bad in ((1 << 26, 1), (1, 64), (None, 1)):
        with pytest.raises(Exception, match="out of range"):
            tables.hll_coupons_to_binary(spark.createDataFrame([bad], "slot26 int, value int")).collect()


def test_coupon_estimates():
    for n in (1, 10, 1000, 1e6):
        assert distinct_for(11, round(expected_coupons(11, n))) == pytest.approx(n, rel=0.05 if n < 100 else 0.01, abs=0.6)


def test_cpc(spark):
    a, b = cpc.build(spark.range(0, 10_000), "id"), cpc.build(spark.range(5_000, 15_000), "id", lg_k=12)
    assert one(cpc.estimate(a)).estimate == pytest.approx(9977.566375082883, rel=2e-3)
    assert one(cpc.estimate(cpc.union(a, b))).estimate == pytest.approx(15_000, rel=0.05)
    assert sorted(cpc.union(a, b).select(a.columns).collect()) == sorted(cpc.build(spark.range(15_000), "id").collect())
    r = one(cpc.bounds(a, 3))
    assert r.lower < 10_000 < r.upper
    assert one(cpc.ordered_estimate(spark.range(10_000), "id", "id")).estimate == pytest.approx(9913.67281767511, rel=1e-3)
    assert tuple(one(cpc.bounds(cpc.build(spark.range(0), "id")))) == (0, 0, 0)
    assert cpc.validate(a).count() == 0
    assert (cpc.max_serialized_bytes(11), cpc.max_serialized_bytes(12)) == (1332, 2580)


# --- membership, frequencies, quantiles ---


def test_bloom(spark):
    config = bloom.Config(65_536, 5, 123)
    left, right = (bloom.build(spark.createDataFrame([(x,) for x in v], "s string"), "s", config) for v in (("shared", "left"), ("shared", "right")))
    probes = spark.createDataFrame([("shared",), ("left",), ("right",), ("none",), (None,)], "s string")

    def asked(state):
        return {r.s: r.might_contain for r in bloom.contains(state, probes, "s", config).collect()}

    assert asked(bloom.union(left, right)) == {"shared": True, "left": True, "right": True, "none": False}
    assert asked(bloom.intersect(left, right))["shared"] and not asked(bloom.intersect(left, right))["left"]
    used = one(bloom.statistics(left, config)).bits_used
    assert one(bloom.statistics(bloom.invert(left, config), config)).bits_used == 65_536 - used
    numbers = bloom.Config.with_accuracy(1000, 0.01)
    assert (bloom.suggest_num_bits(1000, 0.01), numbers.num_hashes, numbers.num_bits % 64) == (9586, 7, 0)
    state = bloom.build(spark.range(1000), "id", numbers)
    hits = bloom.contains(state, spark.range(21_000), "id", numbers).collect()
    assert all(r.might_contain for r in hits if r.id < 1000) and sum(r.might_contain for r in hits) < 1000 + 500
    again = bloom.contains_and_insert(spark.createDataFrame([(1, 5), (2, 6), (3, 5)], "at long, x long"), "x", numbers, "at")
    assert {r.at: r.was_there for r in again.collect()} == {1: False, 2: False, 3: True}
    with pytest.raises(SketchArgumentError):
        bloom.suggest_num_bits(0, 0.1)


def test_countmin(spark):
    config = countmin.Config(countmin.suggest_num_hashes(0.9), countmin.suggest_num_buckets(0.01))
    df = spark.range(200).withColumn("w", F.col("id"))
    state = countmin.build(df, "id", config, weight="w")
    found = {r.id: r for r in countmin.estimate(state, spark.range(201), "id", config).collect()}
    assert all(r.estimate >= i and r.lower_bound == r.estimate <= r.upper_bound for i, r in found.items() if i < 200)
    doubled = {r.id: r.estimate for r in countmin.estimate(countmin.merge(state, state), df, "id", config).collect()}
    assert all(doubled[i] == 2 * found[i].estimate for i in range(200))
    halved = {r.id: r.estimate for r in countmin.estimate(countmin.halve(state), df, "id", config).collect()}
    assert all(halved[i] >= i // 2 for i in range(200))
    signed = countmin.build(spark.createDataFrame([("y", -1), ("x", 2)], "k string, w long"), "k", countmin.Config(2, 32, 123), weight="w")
    assert one(countmin.total_weight(signed)).total_weight == 3
    with pytest.raises(SketchArgumentError):
        countmin.Config(1, 2)


def test_rollups_add_equal_groups(spark):
    df = spark.createDataFrame([(g, i % 9, w) for g, n, w in (("a", 30, 1), ("b", 30, 1), ("c", 20, 1)) for i in range(n)], "g string, item long, w long")
    config = countmin.Config(3, 64)
    table = SketchTable(countmin.build(df, "item", config, ["g"]), ["g"], countmin.merge)
    assert one(countmin.total_weight(table.rollup())).total_weight == 80
    found = {r.item: r for r in countmin.estimate(table.rollup(), df, "item", config).collect()}
    whole = {r.item: r for r in countmin.estimate(countmin.build(df, "item", config), df, "item", config).collect()}
    assert found == whole
    state = SketchTable(frequent.build(df, "item", 8, ["g"]), ["g"], frequent.merge, {"max_map_size": 8}).rollup()
    facts, true = one(frequent.statistics(state)), {r.item: r["count"] for r in df.groupBy("item").count().collect()}
    assert facts.total_weight == 80
    for r in frequent.estimates(state, df, "item").collect():
        assert r.lower_bound <= true[r.item] <= r.upper_bound


def test_frequent_items(spark):
    rows = [(1, 10), *((i, 1) for i in range(2, 7)), (7, 15), *((i, 1) for i in range(8, 13))]
    state = frequent.build(spark.createDataFrame(rows, "item long, n long"), "item", 8, count="n")
    facts = one(frequent.statistics(state))
    assert facts.total_weight == 35
    assert [r.item for r in frequent.frequent_items(state, True).collect()] == [7, 1]
    true = dict(rows)
    for r in frequent.estimates(state, spark.range(1, 20), "id").collect():
        assert r.lower_bound <= true.get(r.id, 0) <= r.upper_bound
    merged = frequent.merge(state, state, max_map_size=8)
    assert one(frequent.statistics(merged)).total_weight == 70
    heavy = spark.range(50_000).select(F.when(F.col("id") % 4 == 0, -1).otherwise(F.col("id")).alias("item"))
    found = frequent.frequent_items(frequent.build(heavy, "item", 64), True).collect()
    assert [r.item for r in found][:1] == [-1]
    assert frequent.epsilon(64) == 3.5 / 64 and frequent.capacity(8) == 6
    with pytest.raises(SketchArgumentError):
        frequent.build(heavy, "item", 6)


def test_tdigest(spark):
    ramp = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    state = tdigest.build(ramp, "v").cache()
    r = one(state)
    assert (r.min, r.max, r.weight) == (0, 9999, 10_000)
    for q, rel in ((0.5, 0.03), (0.9, 0.01), (0.95, 0.01)):
        assert one(tdigest.quantiles(state, [q])).quantiles[0] == pytest.approx(q * 10_000, rel=rel)
    got = one(tdigest.ranks(state, [-1.0, 5000.0, 9000.0, 20_000.0])).ranks
    assert got[0] == 0 and got[3] == 1 and abs(got[1] - 0.5) < 1e-3 and abs(got[2] - 0.9) < 1e-3
    assert sum(one(tdigest.pmf(state, [100.0, 500.0])).pmf) == pytest.approx(1)
    assert one(tdigest.cdf(state, [100.0])).cdf[-1] == 1
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double")
    assert tdigest.build(odd, "v").count() == 0
    assert one(tdigest.ranks(tdigest.build(spark.createDataFrame([(1.0,)] * 4, "v double"), "v"), [1.0])).ranks == [0.5]
    two = tdigest.build(spark.createDataFrame([(1.0,), (2.0,)], "v double"), "v")
    assert one(tdigest.ranks(two, [1.0, 2.0])).ranks == [0.25, 0.75]
    wide = tdigest.build(spark.createDataFrame([(1.7e308 * s,) for s in (-1, 1)] * 50, "v double"), "v")
    assert all(map(math.isfinite, one(tdigest.quantiles(wide, [0.1, 0.5, 0.9])).quantiles))
    groups = ramp.withColumn("g", F.when(F.col("v") % 2 == 0, "even"))
    assert {x.g: x.weight for x in tdigest.build(groups, "v", ["g"]).collect()} == {None: 5000, "even": 5000}
    for bad in ([], [2.0, 1.0], [float("nan")]):
        with pytest.raises(SketchArgumentError):
            tdigest.cdf(state, bad)
    with pytest.raises(SketchArgumentError):
        tdigest.build(ramp, "v", k=9)


# --- stored forms ---


def test_theta_codecs_round_trip(spark):
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 9, 200):
        for limit in (2**62, codecs.MAX_THETA):
            hashes = sorted(int(x) for x in rng.integers(1, 2**61, n))
            for encode in (codecs.encode_theta, codecs.encode_theta_compressed):
                back = codecs.decode_theta(encode(hashes, limit, n == 0))
                assert back.hashes == hashes and back.empty == (n == 0)
                assert back.theta == (codecs.MAX_THETA if n == 0 else limit)
    for width in (1, 7, 8, 33, 63):
        values = [int(x) for x in rng.integers(0, 2**width, 17, dtype=np.uint64)]
        assert codecs.unpack_bits(codecs.pack_bits(values, width), width, 17) == values
    data = codecs.encode_theta([5, 6])
    for bad in (data[:10], b"\1\3\7" + data[3:], b"\1\7\3" + data[3:]):
        with pytest.raises(SketchDataError):
            codecs.decode_theta(bad)
    with pytest.raises(SketchDataError):
        codecs.decode_theta(data, seed=5)
    assert codecs.family_of(data) == "THETA"


def test_other_codecs_round_trip(spark):
    entries = [(5, 1.5), (9, -2.0)]
    assert codecs.decode_tuple(codecs.encode_tuple(entries, codecs.summary_codec("f64")), codecs.summary_codec("f64"))[1] == entries
    words = np.array([0, 5, 2**63], np.uint64)
    back = codecs.decode_bloom(codecs.encode_bloom(words, 4))
    assert (back[0] == words).all() and back[1:] == (4, 9001)
    counts = np.arange(12).reshape(2, 6)
    again, total = codecs.decode_countmin(codecs.encode_countmin(counts, 7))
    assert (again == counts).all() and total == 7
    with pytest.raises(SketchDataError):
        codecs.decode_countmin(codecs.encode_countmin(counts * 100, 7), kind="i8")
    for kind, items in (("i64", [(4, 2), (-1, 9)]), ("string", [("é", 3)])):
        assert codecs.decode_frequent(codecs.encode_frequent(items, 5, 20, 1, kind), kind) == (items, 5, 20, 1)
    assert codecs.decode_tdigest(codecs.encode_tdigest(200, 1.0, 3.0, [1.0, 2.0, 3.0], [1, 4, 1])) == (200, 1.0, 3.0, [1.0, 2.0, 3.0], [1, 4, 1])
    assert codecs.decode_tdigest(codecs.encode_tdigest(100, 2.0, 2.0, [2.0], [1]))[3:] == ([2.0], [1])
    with pytest.raises(SketchDataError):
        codecs.decode_tdigest(codecs.encode_tdigest(200, 1.0, float("nan"), [1.0, 2.0], [1, 4]))


def test_stored_tables_round_trip(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("item"), F.col("id").cast("double").alias("v"))
    states = [
        (tuples.build(df, "id", "item", ["g"]), lambda s: tables.tuple_to_binary(s, "i64", ["g"]), lambda b: tables.tuple_from_binary(b, "i64", by=["g"])),
        (bloom.build(df, "id", bloom.Config(1024, 3), ["g"]), lambda s: tables.bloom_to_binary(s, bloom.Config(1024, 3), ["g"]), lambda b: tables.bloom_from_binary(b, by=["g"])),
        (countmin.build(df, "item", countmin.Config(3, 20), ["g"]), lambda s: tables.countmin_to_binary(s, countmin.Config(3, 20), ["g"]), lambda b: tables.countmin_from_binary(b, by=["g"])),
        (frequent.build(df, "item", 8, ["g"]), lambda s: tables.frequent_to_binary(s, 3, ["g"]), lambda b: tables.frequent_from_binary(b, by=["g"])),
        (tdigest.build(df, "v", ["g"]), lambda s: tables.tdigest_to_binary(s, ["g"]), lambda b: tables.tdigest_from_binary(b, by=["g"])),
    ]
    for state, pack, unpack in states:
        assert sorted(map(str, unpack(pack(state)).select(state.columns).collect())) == sorted(map(str, state.collect()))


def test_stored_coupons_are_read(spark):
    n = one(cpc.num_coupons(cpc.build(spark.range(3000), "id"))).num_coupons
    short = hashing.seed_hash(9001)
    unmerged = codecs.Writer().put("B", 8, 1, 16, 11, 0, 2 | 4 | 16).put("H", short).put("I", n, 77).put("d", 1.0, 2992.5).raw(b"packed").done()
    merged = codecs.Writer().put("B", 4, 1, 16, 11, 0, 2 | 16).put("H", short).put("I", n, 77).raw(b"packed").done()
    empty = codecs.Writer().put("B", 2, 1, 16, 11, 0, 2).put("H", short).done()
    rows = spark.createDataFrame([(1, bytearray(unmerged)), (2, bytearray(merged)), (3, bytearray(empty)), (4, None)], "g int, sketch binary")
    found = {r.g: r for r in tables.cpc_from_binary(rows, by=["g"]).collect()}
    assert found[1].estimate == 2992.5 and found[1].num_coupons == n and found[1].lower < 2992.5 < found[1].upper
    assert found[2].estimate == pytest.approx(distinct_for(11, n)) and found[3].is_empty and set(found) == {1, 2, 3}
    with pytest.raises(SketchDataError):
        codecs.cpc_facts(unmerged, seed=1)
    for bad in (merged[:4] + bytes([64]) + merged[5:], merged[:5] + bytes([16]) + merged[6:]):  # first column, compression
        with pytest.raises(SketchDataError):
            codecs.cpc_facts(bad)


# --- streams and tables ---


def test_stream_windows_equal_the_batch(spark, tmp_path):
    rows = spark.range(600).select(F.timestamp_seconds(F.col("id") * 10).alias("ts"), (F.col("id") % 97).alias("k"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    found = rollups.windowed_registers(stream, "ts", "k", "20 minutes", "1 hour", lg_k=8)
    query = found.writeStream.outputMode("complete").format("memory").queryName("registers").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = hll.coupons(rows, "k", ["ts"]).groupBy(F.window("ts", "20 minutes")["start"].alias("window_start"), F.col("slot26").bitwiseAND(255).alias("slot")).agg(F.max("value").alias("value"))
    assert sorted(spark.table("registers").select("window_start", "slot", "value").collect()) == sorted(batch.collect())


def test_stream_windows_of_theta(spark, tmp_path):
    rows = spark.range(600).select(F.timestamp_seconds(F.col("id") * 10).alias("ts"), (F.col("id") % 97).alias("k"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    found = rollups.windowed_theta(stream, "ts", "k", "20 minutes", "1 hour")
    path = str(tmp_path / "out")
    query = found.writeStream.outputMode("complete").foreachBatch(rollups.replacing(path)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    exact = rows.groupBy(F.window("ts", "20 minutes")["start"].alias("w")).agg(F.countDistinct("k").alias("n"))
    assert sorted((r.window_start, int(r.estimate)) for r in rollups.latest(spark, path, 99).collect()) == sorted(map(tuple, exact.collect()))


def test_late_batches_merge(spark, tmp_path):
    path = str(tmp_path / "state")
    run = rollups.merging_into(path, lambda b: theta.build(b, "id"), lambda a, b: theta.union(a, b))
    for number, (a, b) in enumerate([(0, 500), (400, 900), (100, 300)]):
        run(spark.range(a, b), number)
    run(spark.range(100, 300), 2)  # the same batch again
    assert one(theta.estimate(rollups.latest(spark, path, 9))).estimate == 900
    tables.save(sketch(spark, 0, 10), str(tmp_path / "table"))
    assert one(theta.estimate(tables.load(spark, str(tmp_path / "table")))).estimate == 10
    stored = tables.theta_to_binary(sketch(spark, 0, 10), compressed=True)
    assert one(theta.estimate(tables.theta_from_binary(stored))).estimate == 10
