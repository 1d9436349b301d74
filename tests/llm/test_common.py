from pyspark.sql import functions as F

from sketchwright.llm import common


def test_ranges(spark):
    for cuts in ([], [5], [1, 3, 9], list(range(0, 500, 7))):
        df = spark.range(-3, 520).unionByName(spark.createDataFrame([(None,)], "id long"))
        for r in common.with_range(df, "id", cuts, "n").collect():
            assert r.n == (0 if r.id is None else sum(c <= r.id for c in cuts))


def test_splitters_grow_with_the_root_and_by_weight(spark):
    one = F.lit(1)
    assert common.splitters(spark.range(0), "id", one, 10, 10**6) == []
    assert 90 <= len(common.splitters(spark.range(10_000), "id", one, 10, 10**6)) <= 99
    assert 8 <= len(common.splitters(spark.range(10_000), "id", one, 1000, 10**6)) <= 9
    assert 180 <= len(common.splitters(spark.range(10_000), "id", one, 10, 50)) <= 199
    heavy = F.when(F.col("id") == 50, 900).otherwise(1)
    cuts = common.splitters(spark.range(100), "id", heavy, 100, 10**6)
    assert sum(45 <= c <= 55 for c in cuts) >= 1 and len(cuts) <= 10


def test_written_tables_are_read_again(spark):
    df = common.written(spark.range(5).select(F.col("id"), F.lit(None).cast("string").alias("s")), "t")
    assert df.count() == 5


def test_hot_keys_meet_their_row(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("is_hot"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("is_hot").alias("top")).where("k <> 11")
    found = common.met(rows, table, "k", "n", 6000, F.xxhash64("is_hot"))
    assert found.columns == ["k", "is_hot", "top"]
    best = {r.k: r.top for r in table.collect()}
    assert all(r.top == best.get(r.k) for r in found.collect()) and found.count() == 6000
