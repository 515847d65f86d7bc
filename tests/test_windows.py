import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from questloom.operators import windows
from questloom.operators.windows import rank_in_slices, tile
from tests.conftest import rows


def plain(df, keys, order, ties, total, beside):
    """The same columns by windows over whole keys."""
    w, same = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(*ties)
    return df.select(
        "*",
        F.row_number().over(w).alias("position"),
        F.count("*").over(Window.partitionBy(*keys)).alias("group_size"),
        F.rank().over(same).alias("rank"),
        F.dense_rank().over(same).alias("dense_rank"),
        F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running_total"),
        F.lag(beside).over(w).alias("previous"),
        F.lead(beside).over(w).alias("next"),
        F.first(beside).over(w).alias("first"),
        F.last(beside).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"),
    )


@pytest.mark.parametrize("by", ["cut", "splitters", "one slice"])
def test_sliced_ranking_equals_plain_windows(spark, by):
    rng = np.random.default_rng(5)
    data = [(int(k), int(v), i, int(x)) for i, (k, v, x) in enumerate(rng.integers(0, [3, 40, 9], size=(500, 3)))]
    data = [(None if k == 2 else k, None if v == 0 else v, i, None if v < 20 else x) for k, v, i, x in data]
    df = spark.createDataFrame(data, "k int, v int, i int, x int")
    cut = F.floor(F.col("v") / 7) if by == "cut" else None
    slice_rows = 10 if by == "splitters" else 10_000
    got = rank_in_slices(df, ["k"], ["v", "i"], cut, ties=["v"], total="x", beside="i", slice_rows=slice_rows)
    got = got.withColumn("tile", tile(F.col("position"), F.col("group_size"), 7))
    want = plain(df, ["k"], ["v", "i"], ["v"], "x", "i").withColumn("tile", F.ntile(7).over(Window.partitionBy("k").orderBy("v", "i")))
    assert rows(got.select(F.to_json(F.struct(*want.columns)))) == rows(want.select(F.to_json(F.struct(*want.columns))))


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_wide_rows_and_a_tie_of_a_third(spark, coalesce):
    """100,000 rows with a payload of 2 KB that ranking doesn't need; a third have one value, and one key half of all."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        i = F.col("id")
        df = spark.range(100_000).select(
            i.alias("i"),
            F.when(i % 2 == 0, F.lit("hot")).otherwise((i % 5).cast("string")).alias("k"),
            F.when(i % 3 == 0, 7).otherwise(F.pmod(F.xxhash64(i), F.lit(50))).alias("v"),
            F.pmod(F.hash(i), F.lit(9)).alias("x"),
            F.repeat(F.sha2(i.cast("string"), 256), 32).alias("payload"),
        )
        got = rank_in_slices(df, ["k"], ["v", "i"], ties=["v"], total="x", beside="i", slice_rows=2_000)
        want = plain(df, ["k"], ["v", "i"], ["v"], "x", "i")
        digest = F.sum(F.xxhash64(F.to_json(F.struct(*want.columns))).cast("decimal(38)"))
        assert got.select(F.count("*"), digest).first() == want.select(F.count("*"), digest).first()
        sizes = windows.in_slices(df, ["k"], ["v", "i"], 2_000).groupBy("k", "_slice").count()
        assert sizes.agg(F.max("count")).first()[0] < 6_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_rows_alike_in_all_columns_share_a_rank_and_lie_in_many_slices(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 4 > 0, 1).otherwise(F.col("id")).alias("v"), F.lit("k").alias("k"))
    got = rank_in_slices(df, ["k"], ["v"], slice_rows=500)
    of_one = got.where("v = 1").agg(F.count("*"), F.countDistinct("position"), F.max("rank"), F.min("rank"), F.max("dense_rank")).first()
    assert tuple(of_one) == (15_000, 15_000, 2, 2, 2)
    last = got.where("v = 19996").first()
    assert (last["position"], last["rank"], last["dense_rank"], last["group_size"]) == (20_000, 20_000, 5_001, 20_000)
    assert windows.in_slices(df, ["k"], ["v"], 500).groupBy("_slice").count().agg(F.max("count")).first()[0] < 2_500


def test_empty_table(spark):
    assert rank_in_slices(spark.range(0).withColumn("k", F.lit(1)), ["k"], ["id"]).collect() == []


def test_tiles_of_small_groups(spark):
    df = spark.range(1, 4).select(tile(F.col("id"), F.lit(3), 7).alias("t"))
    assert rows(df) == [(1,), (2,), (3,)]
