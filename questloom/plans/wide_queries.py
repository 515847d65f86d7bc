"""Registered queries over whole, unaggregated tables: joins with uneven intervals, moving frames, large caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questloom.operators.frames import moving_range, moving_rows
from questloom.operators.intervals import interval_join
from questloom.operators.reuse import retain_recent
from questloom.plans.registry import query
from questloom.sources.tables import table


@query(
    "q14_interval_join",
    """
    WITH p AS (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem),
         s AS (SELECT s_suppkey, CASE WHEN s_suppkey = 1 THEN -1 ELSE s_suppkey * 7919 END AS low,
                      CASE WHEN s_suppkey = 1 THEN 1000000000000
                           ELSE s_suppkey * 7919 + CAST(power(10, s_suppkey % 7) AS BIGINT) END AS high FROM supplier)
    SELECT s_suppkey, count(*) AS n_lines, CAST(sum(quantity) AS BIGINT) AS quantity, min(cents) AS cheapest
    FROM s JOIN p ON cents >= low AND cents < high GROUP BY s_suppkey
    """,
)
def price_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by price ranges of 1 to 1,000,000 cents, and one range that covers all."""
    key, first = F.col("s_suppkey"), F.col("s_suppkey") == 1
    lines = table(spark, folder, "lineitem").select(
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), F.col("l_quantity").cast("bigint").alias("quantity")
    )
    low = F.when(first, -1).otherwise(key * 7919)
    wide = F.round(F.pow(F.lit(10.0), key % 7)).cast("bigint")
    ranges = table(spark, folder, "supplier").select(
        "s_suppkey", low.alias("low"), F.when(first, F.lit(1_000_000_000_000)).otherwise(low + wide).alias("high")
    )
    joined = interval_join(lines, ranges, "cents", "low", "high")
    return joined.groupBy("s_suppkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").alias("quantity"), F.min("cents").alias("cheapest")
    )


@query(
    "q19_moving_rows",
    """
    SELECT o_orderkey, o_orderpriority, CAST(count(*) OVER w AS BIGINT) AS n_near,
           CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS BIGINT) AS cents_near,
           max(o_custkey) OVER w AS last_customer
    FROM orders
    WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 99 PRECEDING AND 20 FOLLOWING)
    """,
)
def orders_near(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderpriority", "o_orderdate", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents")
    )
    results = {"n_near": F.count(F.lit(1)), "cents_near": F.sum("cents"), "last_customer": F.max("o_custkey")}
    moved = moving_rows(orders, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], 99, 20, results)
    return moved.select("o_orderkey", "o_orderpriority", *results)


@query(
    "q19_moving_range",
    """
    SELECT l_orderkey, l_linenumber, CAST(count(*) OVER w AS BIGINT) AS n_week,
           CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS quantity_week
    FROM (SELECT *, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS day FROM lineitem)
    WINDOW w AS (PARTITION BY l_returnflag ORDER BY day RANGE BETWEEN 6 PRECEDING AND 1 FOLLOWING)
    """,
)
def lines_of_a_week(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("day"),
    )
    sums = {"n_week": F.lit(1), "quantity_week": F.col("quantity")}
    return moving_range(lines, ["l_returnflag"], "day", 6, 1, sums).select("l_orderkey", "l_linenumber", *sums)


@query(
    "a13_retain_most",
    """
    WITH e AS (SELECT min(o_orderkey) AS entry_id, max(CAST(o_orderdate AS TIMESTAMP)) AS last
               FROM orders GROUP BY o_custkey, o_orderdate)
    SELECT entry_id, epoch_us(last) AS last_used FROM e
    QUALIFY row_number() OVER (ORDER BY last DESC, entry_id) <= 12000
    """,
)
def retain_most(spark: SparkSession, folder: str) -> DataFrame:
    """A cache too large for a top-k: orders by customer and day, of which the latest 12,000 stay."""
    entries = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("entry_id"),
        F.concat_ws(" ", "o_custkey", "o_orderdate").alias("question"),
        F.col("o_orderdate").cast("timestamp").alias("last_accessed"),
    )
    return retain_recent(entries, None, 12_000).select("entry_id", F.unix_micros("last_accessed").alias("last_used"))
