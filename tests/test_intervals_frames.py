import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from questloom.operators import intervals, reuse
from questloom.operators.cuts import latest, value_at
from questloom.operators.frames import moving_range, moving_rows
from questloom.operators.intervals import interval_join, interval_nodes
from questloom.operators.reuse import retain_recent
from tests.conftest import rows

EDGES = [(0, 1), (-1, 1), (0, 16), (1, 16), (-17, 4097), (5, 5), (7, 3), (-(2**60), 2**60), (2**60 - 3, 2**60), (-5, -4)]


def test_nodes_make_up_the_interval_without_overlap(spark):
    rng = np.random.default_rng(3)
    ends = EDGES + [(int(a), int(a + 10 ** rng.integers(0, 5))) for a in rng.integers(-9000, 9000, 60)]
    df = spark.createDataFrame(ends, "low long, high long").select("low", "high", interval_nodes("low", "high").alias("nodes"))
    for r in df.collect():
        runs = sorted((n["node"] << 4 * n["level"], (n["node"] + 1) << 4 * n["level"]) for n in r["nodes"])
        assert len(runs) <= 30 * 16
        if r["low"] >= r["high"]:
            assert runs == []
            continue
        assert runs[0][0] == r["low"] and runs[-1][1] == r["high"]
        assert all(a[1] == b[0] for a, b in zip(runs, runs[1:], strict=False))


@pytest.mark.parametrize("node_rows", [20, 1 << 18])
def test_interval_join_gives_all_pairs_and_no_other(spark, node_rows):
    rng = np.random.default_rng(4)
    at = [int(x) for x in rng.integers(-2000, 2000, 300)] + [7] * 150 + [None, 0, -(2**60), 2**60 - 1]
    ends = EDGES + [(None, 4), (4, None), (7, 8), (7, 8)] + [(int(a), int(a + 10 ** rng.integers(0, 4))) for a in rng.integers(-2500, 2500, 30)]
    points = spark.createDataFrame(list(enumerate(at)), "p int, `at it` long")
    intervals = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "i int, low long, high long")
    got = interval_join(points, intervals, "at it", "low", "high", node_rows)
    want = [(p, i) for p, x in enumerate(at) for i, (a, b) in enumerate(ends) if None not in (x, a, b) and a <= x < b]
    assert rows(got, "p", "i") == sorted(want)
    assert got.columns == ["p", "at it", "i", "low", "high"]
    with pytest.raises(ValueError, match="both sides"):
        interval_join(points, points, "at it", "p", "p")


def test_interval_join_makes_no_nodes_beyond_the_points(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(intervals, "stage", lambda df, name: seen.append((name, df.count())) or df)
    points = spark.createDataFrame([(x,) for x in (None, 100, 105, 299)], "at long")
    far = [(i * 1000 + 3, i * 1000 + 999) for i in range(1, 50)] + [(-5, 0), (-(10**12), 10**12), (104, 300), (0, None), (None, 500)]
    got = interval_join(points, spark.createDataFrame(far, "low long, high long"), "at", "low", "high")
    assert rows(got.select("at", "low")) == [(100, -(10**12)), (105, -(10**12)), (105, 104), (299, -(10**12)), (299, 104)]
    assert dict(seen)["nodes"] < 100


def test_interval_join_of_empty_sides(spark):
    points, intervals = spark.range(5).withColumnRenamed("id", "at"), spark.createDataFrame([], "low long, high long")
    assert interval_join(points, intervals, "at", "low", "high").collect() == []
    one = spark.createDataFrame([(0, 9)], "low long, high long")
    assert interval_join(points.limit(0), one, "at", "low", "high").collect() == []


def numbers(spark):
    rng = np.random.default_rng(6)
    data = [(int(k), int(v), i, int(x)) for i, (k, v, x) in enumerate(rng.integers(0, [3, 300, 9], size=(900, 3)))]
    data = [(None if k == 2 else k, None if v < 9 else 50 if v < 90 else v - 99, i, None if 100 < v < 130 else x) for k, v, i, x in data]
    return spark.createDataFrame(data, "k int, v int, i int, x int")


@pytest.mark.parametrize(("before", "after", "block"), [(3, 0, 10), (0, 4, 7), (5, 6, 5), (40, 2, 10), (0, 0, 8), (9, 9, 10_000)])
def test_moving_rows_equal_a_plain_window(spark, before, after, block):
    df = numbers(spark)
    frame = Window.partitionBy("k").orderBy("v", "i").rowsBetween(-before, after)
    sums = {"s": F.sum("x"), "n": F.count("x"), "top": F.max("x")}
    got = moving_rows(df, ["k"], ["v", "i"], before, after, sums, block)
    assert rows(got.select(F.to_json(F.struct("*")))) == rows(df.select("*", *[c.over(frame).alias(n) for n, c in sums.items()]).select(F.to_json(F.struct("*"))))


@pytest.mark.parametrize(("before", "after"), [(3, 0), (0, 4), (11, 7), (0, 0), (400, 0)])
def test_moving_range_equals_a_plain_window(spark, before, after):
    df = numbers(spark)
    frame = Window.partitionBy("k").orderBy("v").rangeBetween(-before, after)
    got = moving_range(df, ["k"], "v", before, after, {"s": F.col("x"), "n": F.lit(1)})
    want = df.select("*", F.sum("x").over(frame).alias("s"), F.count("*").over(frame).alias("n"))
    assert rows(got.select(F.to_json(F.struct("*")))) == rows(want.select(F.to_json(F.struct("*"))))
    assert moving_range(df.limit(0), ["k"], "v", 1, 1, {"s": F.col("x")}).collect() == []


def test_value_at_a_place(spark):
    df = spark.createDataFrame([(v,) for v in [None, 3, 3, 5, 5, 5, 9, None]], "v int")
    got = [value_at(df, F.col("v"), n, 2) for n in (1, 2, 3, 5, 8, 9)]
    assert got == [(None, 0), (None, 0), (3, 2), (5, 4), (9, 7), None]


@pytest.mark.parametrize("many", [0, 1, 9, 150, 299, 300, 301])
def test_latest_rows(spark, many):
    rng = np.random.default_rng(8)
    data = [(i, None if t == 0 else 7 if t < 9 else int(t)) for i, t in enumerate(rng.integers(0, 25, 300))]
    df = spark.createDataFrame(data, "i int, t int")
    want = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[:many]
    assert rows(latest(df, "t", "i", many, 20), "i") == sorted((i,) for i, _ in want)


def test_retained_entries_are_the_same_by_sort_and_by_cut(spark, monkeypatch):
    df = spark.range(500).select(
        F.col("id").alias("entry_id"),
        F.concat(F.lit("q"), (F.col("id") % 400).cast("string")).alias("question"),
        F.timestamp_seconds(F.col("id") % 7).alias("last_accessed"),
    )
    by_sort = rows(retain_recent(df, None, 123))
    monkeypatch.setattr(reuse, "SORTED_CAPACITY", 0)
    cut = retain_recent(df, None, 123)
    assert rows(cut) == by_sort and len(by_sort) == 123
    assert "TakeOrdered" not in cut._jdf.queryExecution().toString() and "Sort [" not in cut._jdf.queryExecution().toString()
