import pytest
from pyspark.sql import functions as F

from questloom.operators.gate import RefusedSql, audit_statements, check_sql, run_sql, was_cut
from questloom.sources.tables import to_json_lines

# Table trips: trip_id, driver, town, km.
ACCEPTED = [
    "SELECT trip_id FROM trips",
    "select town, avg(km) as mean_km from trips where driver is not null group by town having max(km) > 3",
    "WITH far AS (SELECT * FROM trips WHERE km >= 5) SELECT driver, count(DISTINCT town) AS towns FROM far GROUP BY driver",
    "SELECT t.trip_id, sum(u.km) OVER (ORDER BY u.trip_id) AS so_far FROM trips t, trips u WHERE t.trip_id = u.trip_id + 1",
    "SELECT 'delete from trips; --' AS note FROM trips LIMIT 2;",
    "SELECT km /* ; */ FROM trips; -- ; the end",
    "-- don't stop here\nSELECT 2 * km FROM trips",
    "(SELECT town FROM trips) UNION (SELECT driver FROM trips)",
    "VALUES ('x', 1), ('y', 2)",
    "TABLE trips",
    "FROM trips SELECT max(km)",
    "SELECT a.town FROM trips a LEFT JOIN trips b USING (trip_id)",
    "SELECT /*+ REPARTITION(2) */ town FROM trips",
    "SELECT 'java_method' AS name, filter(array(1, 2), k -> k > 1) AS big",
]
REFUSED = [
    ("DROP VIEW trips", "refused"),
    ("VALUES (1); VALUES (2)", "more than one"),
    ("INSERT INTO trips SELECT * FROM trips", "more than read"),
    ("INSERT OVERWRITE trips TABLE trips", "refused"),
    ("REFRESH TABLE trips", "refused"),
    ("CREATE TABLE t AS SELECT 1 AS one", "refused"),
    ("ALTER VIEW trips RENAME TO routes", "refused"),
    ("TABLE trips; -- now\nDROP VIEW trips", "more than one"),
    ("   ", "no statement"),
    (";;", "no statement"),
    ("-- only a remark", "no statement"),
    ("WITH a AS (TABLE trips) INSERT INTO trips TABLE a", "more than read"),
    ("FROM trips INSERT INTO routes SELECT town", "more than read"),
    ("SELECT 3) AND EXISTS (SELECT 4", "refused"),
    ("DESCRIBE trips", "refused"),
    ("SET spark.sql.ansi.enabled = false", "refused"),
    ("UNCACHE TABLE trips", "refused"),
    ("EXPLAIN TABLE trips", "refused"),
    ("EXECUTE IMMEDIATE 'TABLE trips'", "refused"),
    ("BEGIN VALUES (1); END", "refused"),
    ("SELECT java_method('java.lang.Math', 'random')", "refused"),
    ("SELECT `try_reflect` -- \n ('java.lang.Math', 'random')", "refused"),
    ("SELECT IDENTIFIER('java_' || 'method')('java.lang.Math', 'random')", "refused"),
    ("SELECT TRANSFORM(town) USING 'wc' FROM trips", "refused"),
    ("SELECT * FROM nowhere", "nowhere"),
    ("SELEKT 1", "refused"),
]


@pytest.fixture(autouse=True)
def trips(spark):
    spark.createDataFrame(
        [(i, f"d{i % 3}", "Ulm" if i % 2 else "Jena", i * 1.5) for i in range(8)],
        "trip_id int, driver string, town string, km double",
    ).createOrReplaceTempView("trips")


@pytest.mark.parametrize("sql", ACCEPTED)
def test_queries_pass(spark, sql):
    assert run_sql(spark, sql).collect() is not None


@pytest.mark.parametrize("sql, reason", REFUSED)
def test_everything_else_is_refused(spark, sql, reason):
    with pytest.raises(RefusedSql, match=reason):
        check_sql(spark, sql)
    assert spark.table("trips").count() == 8


def test_path_is_no_table(spark, path):
    target = path()
    spark.range(3).write.parquet(target)
    with pytest.raises(RefusedSql):
        run_sql(spark, f"SELECT * FROM parquet.`{target}`")
    assert spark.sql(f"SELECT * FROM parquet.`{target}`").count() == 3


def test_cap_keeps_order(spark):
    far_first = "SELECT trip_id FROM trips ORDER BY km DESC"
    assert [r["trip_id"] for r in run_sql(spark, far_first, max_rows=3).collect()] == [7, 6, 5]
    assert was_cut(spark, far_first, 3) and not was_cut(spark, far_first, 8)


def test_no_cap_unless_asked(spark):
    assert run_sql(spark, "SELECT id FROM range(30000)").count() == 30_000


def test_json_lines(spark):
    df = spark.createDataFrame([("Ulm", 1.5, None), ("Jena", 0.0, True)], "town string, km double, far boolean")
    want = ['{"town":"Ulm","km":1.5}', '{"town":"Jena","km":0.0,"far":true}']
    assert [r["line"] for r in to_json_lines(df).collect()] == want
    assert to_json_lines(df.filter("km < 0")).count() == 0
    assert to_json_lines(run_sql(spark, "SELECT min(trip_id) AS first FROM trips")).first()["line"] == '{"first":0}'


def test_audit_agrees_with_the_gate_on_text_alone(spark):
    cases = [(sql, "OK") for sql in ACCEPTED]
    cases += [(sql, "MULTIPLE") for sql, why in REFUSED if "more than one" in why]
    cases += [(sql, "EMPTY") for sql, why in REFUSED if "no statement" in why]
    cases += [(sql, "NOT_QUERY") for sql, why in REFUSED if "more than read" in why]
    cases.append((None, "EMPTY"))
    df = spark.createDataFrame(cases, "sql string, want string")
    assert audit_statements(df).filter(F.col("verdict") != F.col("want")).collect() == []
