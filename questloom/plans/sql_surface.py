"""The relational surface: one registered query per SQL feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questloom.operators.gate import run_sql
from questloom.operators.windows import rank_in_slices, tile
from questloom.plans.registry import plain_sql, query, views
from questloom.sources.tables import table

plain_sql(
    "q1_scan_projection",
    "customer",
    "SELECT c_custkey, c_name, c_mktsegment FROM customer",
)

plain_sql(
    "q2_filter_equality",
    "orders",
    "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'",
)

plain_sql(
    "q3_is_not_null",
    "orders customer",
    """
    SELECT c.c_custkey, c.c_name
    FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY o_custkey) o
      ON c.c_custkey = o.o_custkey
    WHERE o.last_order IS NOT NULL
    """,
)

plain_sql(
    "q4_group_having",
    "lineitem",
    """
    SELECT l_suppkey, count(*) AS n_lines,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)
             AS revenue
    FROM lineitem GROUP BY l_suppkey HAVING count(*) > 500
    """,
)

plain_sql(
    "q5_top_offset",
    "orders",
    """
    SELECT o_orderkey, o_totalprice FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10
    """,
)

plain_sql(
    "q6_cte",
    "customer nation",
    """
    WITH per_nation AS (
      SELECT c_nationkey, count(*) AS n, max(c_acctbal) AS best FROM customer GROUP BY c_nationkey
    )
    SELECT n_name, n, best FROM per_nation JOIN nation ON n_nationkey = c_nationkey WHERE n > 10
    """,
)


@query(
    "q7_row_number",
    """
    SELECT o_orderkey, o_orderstatus,
           row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS position
    FROM orders
    """,
)
def row_number(spark: SparkSession, folder: str) -> DataFrame:
    """Three statuses hold all orders: each is ranked range by range, not in one task."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    ranked = rank_in_slices(orders, ["o_orderstatus"], ["o_orderdate", "o_orderkey"])
    return ranked.select("o_orderkey", "o_orderstatus", "position")


@query(
    "q7_row_number_wide",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority,
           row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS position,
           rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS rank,
           count(*) OVER (PARTITION BY o_orderstatus) AS group_size
    FROM orders
    """,
)
def row_number_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Every column of the orders with their places; small slices, so that each status is cut at every size of the table."""
    orders = table(spark, folder, "orders")
    ranked = rank_in_slices(orders, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], ties=["o_orderdate"], slice_rows=4096)
    return ranked.withColumn("o_orderdate", F.col("o_orderdate").cast("string")).select(*orders.columns, "position", "rank", "group_size")


@query(
    "q8_self_join_residual",
    """
    SELECT a.l_orderkey, a.l_suppkey, count(*) AS n_pairs, CAST(sum(b.l_quantity) AS DOUBLE) AS other_quantity
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey
    GROUP BY a.l_orderkey, a.l_suppkey
    """,
)
def self_join_residual(spark: SparkSession, folder: str) -> DataFrame:
    return other_suppliers(table(spark, folder, "lineitem"))


def other_suppliers(lines: DataFrame) -> DataFrame:
    """Lines of an order against those of its other suppliers, without forming the pairs.

    What a != partner adds up to is the order's total less the supplier's own.
    An unknown supplier is not "another" one, so those lines take no part.
    """
    per_supplier = (
        lines.filter("l_orderkey IS NOT NULL AND l_suppkey IS NOT NULL")
        .groupBy("l_orderkey", "l_suppkey")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("l_quantity").alias("known"),
            F.coalesce(F.sum("l_quantity"), F.lit(0)).alias("q"),
        )
    )
    per_order = per_supplier.groupBy("l_orderkey").agg(
        F.sum("n").alias("all_n"), F.sum("known").alias("all_known"), F.sum("q").alias("all_q")
    )
    others = F.col("all_n") - F.col("n")
    quantity = F.when(F.col("all_known") > F.col("known"), F.col("n") * (F.col("all_q") - F.col("q")))
    return (
        per_supplier.join(per_order, "l_orderkey")
        .filter(others > 0)
        .select(
            "l_orderkey",
            "l_suppkey",
            (F.col("n") * others).alias("n_pairs"),
            quantity.alias("other_quantity"),
        )
    )


plain_sql(
    "q9_coalesce_cast_length",
    "customer nation",
    """
    SELECT c_custkey, coalesce(n_name, 'UNKNOWN') AS nation, CAST(length(c_name) AS INT) AS name_length,
           CAST(c_acctbal AS BIGINT) AS whole_balance
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3
    WHERE c_mktsegment IS NOT NULL
    """,
    """
    SELECT c_custkey, coalesce(n_name, 'UNKNOWN') AS nation, CAST(length(c_name) AS INT) AS name_length,
           CAST(trunc(c_acctbal) AS BIGINT) AS whole_balance
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3
    WHERE c_mktsegment IS NOT NULL
    """,
)

plain_sql(
    "q10_values_table",
    "orders",
    """
    SELECT label, count(*) AS n
    FROM orders JOIN (VALUES ('F', 'finished'), ('O', 'open'), ('P', 'partial')) AS s(code, label)
      ON o_orderstatus = s.code
    GROUP BY label
    """,
)

plain_sql(
    "q11_literal_select",
    "orders",
    "SELECT o_orderkey, 42 AS val, 'fixed' AS word FROM orders",
)


@query(
    "q12_outer_joins",
    """
    SELECT 'left' AS kind, count(*) AS n, count(o.o_custkey) AS matched
    FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
    UNION ALL
    SELECT 'right', count(*), count(c.c_custkey)
    FROM customer c RIGHT JOIN orders o ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0
    UNION ALL
    SELECT 'full', count(*), count(CASE WHEN e.user_id IS NOT NULL AND c.c_custkey IS NOT NULL THEN 1 END)
    FROM customer c FULL JOIN events e ON c.c_custkey = e.user_id
    """,
)
def outer_joins(spark: SparkSession, folder: str) -> DataFrame:
    views(spark, folder, "customer", "orders", "events")
    # The many side is counted per key before it is joined: a busy customer is one row.
    return run_sql(
        spark,
        """
        WITH per_customer AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
             per_user AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
        SELECT 'left' AS kind, sum(coalesce(o.n, 1)) AS n, sum(coalesce(o.n, 0)) AS matched
        FROM customer c LEFT JOIN per_customer o ON c.c_custkey = o.o_custkey
        UNION ALL
        SELECT 'right', sum(o.n), sum(CASE WHEN c.c_custkey IS NOT NULL THEN o.n ELSE 0 END)
        FROM customer c RIGHT JOIN per_customer o ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0
        UNION ALL
        SELECT 'full', sum(coalesce(e.n, 1)),
               sum(CASE WHEN e.user_id IS NOT NULL AND c.c_custkey IS NOT NULL THEN e.n ELSE 0 END)
        FROM customer c FULL JOIN per_user e ON c.c_custkey = e.user_id
        """,
        max_rows=None,
    )


plain_sql(
    "q12_left_join_rows",
    "customer nation",
    """
    SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation
      ON c_nationkey = n_nationkey AND n_regionkey = 1
    """,
)

# Every row paired with a one-row aggregate: a scalar subquery says it without a cross join.
plain_sql(
    "q12_cross_join_one_row",
    "customer",
    """
    SELECT c_custkey, c_acctbal, (SELECT max(c_acctbal) FROM customer) AS top_balance FROM customer
    """,
    """
    SELECT c_custkey, c_acctbal, top_balance
    FROM customer CROSS JOIN (SELECT max(c_acctbal) AS top_balance FROM customer) t
    """,
)

plain_sql(
    "q13_semi_anti",
    "customer orders part lineitem",
    """
    SELECT 'exists' AS kind, c_custkey AS key FROM customer c
    WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')
    UNION ALL
    SELECT 'not exists', c_custkey FROM customer c
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')
    UNION ALL
    SELECT 'in', p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
    """,
)


@query(
    "q14_theta_join",
    """
    SELECT s_suppkey, count(c_custkey) AS n_poorer
    FROM supplier LEFT JOIN customer ON c_acctbal < s_acctbal GROUP BY s_suppkey
    """,
)
def theta_join(spark: SparkSession, folder: str) -> DataFrame:
    return poorer_customers(table(spark, folder, "supplier"), table(spark, folder, "customer"))


def poorer_customers(suppliers: DataFrame, customers: DataFrame) -> DataFrame:
    """For each supplier, how many customers have a smaller balance (0 where its own is unknown).

    Both sides' distinct balances are put in one order and the counts summed up
    along it, slice by slice; no pair is formed and no task sees all rows.
    """
    supplier = suppliers.select("s_suppkey", F.col("s_acctbal").alias("balance"))
    known = customers.filter("c_acctbal IS NOT NULL AND c_custkey IS NOT NULL")
    counts = known.groupBy(F.col("c_acctbal").alias("balance")).count()
    points = (
        counts.unionByName(supplier.filter("balance IS NOT NULL").select("balance", F.lit(0).cast("bigint").alias("count")))
        .groupBy("balance")
        .agg(F.sum("count").alias("n"))
        .withColumn("all", F.lit(1))
    )
    summed = rank_in_slices(points, ["all"], ["balance"], total="n")
    return supplier.join(summed, "balance", "left").select(
        "s_suppkey", F.coalesce(F.col("running_total") - F.col("n"), F.lit(0)).alias("n_poorer")
    )


# The same joins over tables in which every seventh key or balance is unknown.
@query(
    "q8_self_join_nulls",
    """
    WITH l AS (SELECT l_orderkey, nullif(l_suppkey, l_suppkey // 7 * 7) AS l_suppkey,
                      CASE WHEN l_linenumber <> 3 THEN l_quantity END AS l_quantity FROM lineitem)
    SELECT a.l_orderkey, a.l_suppkey, count(*) AS n_pairs, CAST(sum(b.l_quantity) AS DOUBLE) AS other_quantity
    FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey
    GROUP BY a.l_orderkey, a.l_suppkey
    """,
)
def self_join_nulls(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("l_suppkey")
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", F.when(key % 7 != 0, key).alias("l_suppkey"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity")
    )
    return other_suppliers(lines)


@query(
    "q14_theta_join_nulls",
    """
    WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS s_acctbal FROM supplier),
         c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal FROM customer)
    SELECT s_suppkey, count(c_custkey) AS n_poorer FROM s LEFT JOIN c ON c_acctbal < s_acctbal GROUP BY s_suppkey
    """,
)
def theta_join_nulls(spark: SparkSession, folder: str) -> DataFrame:
    supplier = table(spark, folder, "supplier").withColumn("s_acctbal", F.expr("CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END"))
    customer = table(spark, folder, "customer").withColumn("c_acctbal", F.expr("CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END"))
    return poorer_customers(supplier, customer)


@query(
    "q14_range_join",
    """
    SELECT n_name AS band, count(*) AS n_lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity
    FROM lineitem JOIN nation ON l_quantity >= n_nationkey * 2 AND l_quantity < n_nationkey * 2 + 2
    GROUP BY n_name
    """,
)
def range_join(spark: SparkSession, folder: str) -> DataFrame:
    """Bands of width 2 as an equi-join on the band number, with the range as residual."""
    lines = (
        table(spark, folder, "lineitem")
        .groupBy("l_quantity")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("band_no", F.floor(F.col("l_quantity") / 2))
    )
    bands = table(spark, folder, "nation").select(
        F.col("n_name").alias("band"), (F.col("n_nationkey") * 2).alias("low")
    ).withColumn("band_no", F.floor(F.col("low") / 2))
    inside = (F.col("l_quantity") >= F.col("low")) & (F.col("l_quantity") < F.col("low") + 2)
    return (
        lines.join(bands, "band_no")
        .filter(inside)
        .groupBy("band")
        .agg(F.sum("n").alias("n_lines"), F.sum(F.col("n") * F.col("l_quantity")).alias("quantity"))
    )


plain_sql(
    "q15_distinct",
    "lineitem",
    "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
)
plain_sql(
    "q15_count_distinct",
    "lineitem",
    """
    SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers
    FROM lineitem GROUP BY l_returnflag
    """,
)


@query("q15_approx_distinct", "SELECT DISTINCT l_returnflag, true AS within_6_percent FROM lineitem")
def approx_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """A sketch of 2% standard error against the exact count."""
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_returnflag")
        .agg(F.approx_count_distinct("l_partkey", 0.02).alias("near"), F.countDistinct("l_partkey").alias("exact"))
        .select(
            "l_returnflag",
            (F.abs(F.col("near") - F.col("exact")) <= F.col("exact") * 0.06).alias("within_6_percent"),
        )
    )


GROUPINGS = """
    SELECT {flag} AS flag, {status} AS status, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity
    FROM lineitem GROUP BY {clause}
"""
NAMES = {"flag": "coalesce(l_returnflag, 'all')", "status": "coalesce(l_linestatus, 'all')"}
plain_sql(
    "q16_grouping_sets",
    "lineitem",
    GROUPINGS.format(**NAMES, clause="GROUPING SETS ((l_returnflag), (l_linestatus), ())"),
)
plain_sql("q16_rollup", "lineitem", GROUPINGS.format(**NAMES, clause="ROLLUP (l_returnflag, l_linestatus)"))
plain_sql("q16_cube", "lineitem", GROUPINGS.format(**NAMES, clause="CUBE (l_returnflag, l_linestatus)"))


@query(
    "q17_statistics",
    """
    SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean_price, min(l_extendedprice) AS low,
           max(l_extendedprice) AS high, round(stddev_samp(l_quantity), 6) AS spread,
           CAST(median(l_quantity) AS DOUBLE) AS middle
    FROM lineitem GROUP BY l_returnflag
    """,
)
def statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The median works on counts per distinct quantity, not on the rows of a group."""
    lines = table(spark, folder, "lineitem")
    simple = lines.groupBy("l_returnflag").agg(
        F.round(F.avg("l_extendedprice"), 4).alias("mean_price"),
        F.min("l_extendedprice").alias("low"),
        F.max("l_extendedprice").alias("high"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("spread"),
    )
    middle = (
        lines.groupBy("l_returnflag", "l_quantity")
        .count()
        .groupBy("l_returnflag")
        .agg(F.percentile("l_quantity", 0.5, F.col("count")).alias("middle"))
    )
    return simple.join(middle, "l_returnflag")


@query(
    "q18_rank_functions",
    """
    SELECT o_orderkey, o_orderpriority,
           rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS rank,
           dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS dense_rank,
           ntile(4) OVER w AS quarter, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next,
           first_value(o_orderkey) OVER w AS first_order,
           last_value(o_orderkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_order
    FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)
    """,
)
def rank_functions(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    ranked = rank_in_slices(
        orders, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], ties=["o_orderdate"], beside="o_orderkey"
    )
    return ranked.select(
        "o_orderkey",
        "o_orderpriority",
        "rank",
        "dense_rank",
        tile(F.col("position"), F.col("group_size"), 4).alias("quarter"),
        "previous",
        "next",
        F.col("first").alias("first_order"),
        F.col("last").alias("last_order"),
    )


# One row per priority and day is left before the frames are laid over it.
plain_sql(
    "q19_frames",
    "orders",
    """
    WITH daily AS (
      SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day,
             sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total
      FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)
    )
    SELECT o_orderpriority, CAST(day AS STRING) AS day,
           CAST(sum(total) OVER (PARTITION BY o_orderpriority ORDER BY day
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running,
           CAST(sum(total) OVER (PARTITION BY o_orderpriority ORDER BY day
             ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS DOUBLE) AS moving,
           CAST(sum(total) OVER (PARTITION BY o_orderpriority ORDER BY day
             RANGE BETWEEN INTERVAL '7' DAY PRECEDING AND CURRENT ROW) AS DOUBLE) AS last_week
    FROM daily
    """,
)

plain_sql(
    "q20_set_operations",
    "customer supplier orders",
    """
    SELECT 'union all' AS kind, c_nationkey AS key, count(*) AS n FROM
      (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) u GROUP BY c_nationkey
    UNION ALL
    SELECT 'union', CAST(k AS INT), 1 FROM
      (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) u
    UNION ALL
    SELECT 'intersect', CAST(k AS INT), 1 FROM
      (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) i
    UNION ALL
    SELECT 'except', CAST(k AS INT), 1 FROM
      (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) e
    """,
)

plain_sql(
    "q21_subqueries",
    "orders customer",
    """
    SELECT c_custkey,
           (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders,
           c_acctbal > (SELECT avg(c_acctbal) FROM customer) AS above_mean
    FROM customer c
    WHERE c_acctbal >= (SELECT min(k.c_acctbal) FROM customer k WHERE k.c_nationkey = c.c_nationkey) + 100
    """,
)

plain_sql(
    "q22_string_functions",
    "part",
    """
    SELECT p_partkey, upper(p_name) AS loud, substr(p_brand, 7) AS brand_no,
           replace(p_name, ' ', '_') AS joined, regexp_replace(p_name, '[aeiou]', '*') AS masked,
           p_name LIKE '%bolt%' AS is_bolt
    FROM part
    """,
    """
    SELECT p_partkey, upper(p_name) AS loud, substr(p_brand, 7) AS brand_no,
           replace(p_name, ' ', '_') AS joined, regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked,
           p_name LIKE '%bolt%' AS is_bolt
    FROM part
    """,
)

plain_sql(
    "q23_date_functions",
    "orders",
    """
    SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS month,
           CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS year,
           CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS day,
           CAST(datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days_left
    FROM orders
    """,
    """
    SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month,
           CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS year,
           CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS day,
           CAST(datediff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS BIGINT) AS days_left
    FROM orders
    """,
)

plain_sql(
    "q24_math_case",
    "lineitem",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 40 THEN 'medium' ELSE 'large' END AS size,
           round(sqrt(l_extendedprice), 6) AS root, CAST(abs(l_partkey - l_suppkey) AS BIGINT) AS gap,
           CAST(floor(l_quantity / 7) AS BIGINT) AS sevens
    FROM lineitem
    """,
)


@query(
    "q25_array_functions",
    r"""
    WITH w AS (
      SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS word FROM documents
    )
    SELECT length(word) AS size, count(*) AS n, count(DISTINCT word) AS n_words
    FROM w WHERE word <> '' GROUP BY length(word)
    """,
)
def array_functions(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents").select(F.explode(F.split("text", r"\s+")).alias("word"))
    per_word = words.filter("word <> ''").groupBy("word").count()
    return per_word.groupBy(F.length("word").cast("bigint").alias("size")).agg(
        F.sum("count").alias("n"), F.count(F.lit(1)).alias("n_words")
    )


plain_sql(
    "q26_json_access",
    "events",
    """
    SELECT event_type, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, count(*) AS n
    FROM events GROUP BY event_type, CAST(get_json_object(props, '$.k') AS BIGINT)
    """,
    """
    SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n
    FROM events GROUP BY event_type, CAST(json_extract_string(props, '$.k') AS BIGINT)
    """,
)
