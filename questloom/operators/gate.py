"""Read-only SQL: the gate, the row cap, and an audit of whole tables of statements."""

from __future__ import annotations

import re
import threading

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How a query may begin, and what may not follow WITH or FROM.
QUERY_WORDS = ["SELECT", "WITH", "VALUES", "TABLE", "FROM"]
WRITE_WORDS = r"(?i)\b(INSERT\s+(INTO|OVERWRITE)|DELETE\s+FROM|UPDATE\s+\S+\s+SET|MERGE\s+INTO)\b"
QUOTED = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|`[^`]*+`"""
COMMENT = r"--[^\n]*+|/\*[\s\S]*?\*/"
PLAIN_COMMENT = r"--[^\n]*+|/\*(?!\+)[\s\S]*?\*/"

# What a SELECT must not reach: functions that call into the JVM, names built
# at run time (which could spell one of those), and scripts on the executors.
_GAP = r"(?:\s|--[^\n]*\n|/\*[\s\S]*?\*/)*"
UNSAFE_CALL = re.compile(rf"\b(?:reflect|java_method|try_reflect|identifier)`?{_GAP}\(", re.IGNORECASE)
SCRIPT = re.compile(rf"\busing\b{_GAP}r?['\"]", re.IGNORECASE)

REFUSALS = {
    "EMPTY": "the text holds no statement",
    "MULTIPLE": "the text holds more than one statement",
    "NOT_QUERY": "the statement does more than read",
}

_files_setting = threading.Lock()


class RefusedSql(ValueError):
    """The text is not one plain read-only query."""


def statement_verdict(sql: Column) -> Column:
    """``OK``, ``EMPTY``, ``MULTIPLE`` or ``NOT_QUERY`` for a SQL text.

    Looks at the text only: comments are dropped, quoted text blanked, and the
    rest cut at semicolons.  For a whole table of statements; what is to be run
    must still pass ``check_sql``.
    """
    bare = F.regexp_replace(F.regexp_replace(sql, f"({QUOTED})|{COMMENT}", "$1"), QUOTED, "''")
    statements = F.filter(F.split(bare, ";"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")
    only = F.element_at(statements, 1)
    word = F.upper(F.regexp_extract(only, r"\A[\s(]*([A-Za-z]+)", 1))
    return (
        F.when(sql.isNull() | (F.size(statements) == 0), "EMPTY")
        .when(F.size(statements) > 1, "MULTIPLE")
        .when(~word.isin(QUERY_WORDS), "NOT_QUERY")
        .when(word.isin("WITH", "FROM") & only.rlike(WRITE_WORDS), "NOT_QUERY")
        .otherwise("OK")
    )


def audit_statements(statements: DataFrame, col: str = "sql") -> DataFrame:
    """Add ``verdict`` to a table of SQL texts."""
    return statements.withColumn("verdict", statement_verdict(F.col(col)))


def check_sql(spark: SparkSession, sql: str) -> DataFrame:
    """The DataFrame of ``sql``, or ``RefusedSql`` if it is not one read-only query.

    Spark's own parser has the last word: inside ``EXISTS ( )`` its grammar
    takes a query and nothing else, so a command, a write hidden behind WITH or
    FROM, or a script block cannot even be parsed there.  Nothing runs: a query
    is only analysed until someone acts on the DataFrame.
    """
    verdict = spark.sql("SELECT :sql AS sql", {"sql": sql}).select(statement_verdict(F.col("sql")))
    found = verdict.first()[0]
    if found != "OK":
        raise RefusedSql(f"refused: {REFUSALS[found]}")
    # Comments out (hints stay), then the closing semicolon.
    body = re.sub(f"({QUOTED})|{PLAIN_COMMENT}", lambda m: m[1] or " ", sql)
    body = re.sub(r"[;\s]+\Z", "", body)
    if any(rule.search(text) for rule in (UNSAFE_CALL, SCRIPT) for text in (sql, body)):
        raise RefusedSql("refused: the query calls outside of SQL")
    with _files_setting:
        # A path must not be readable as a table; names resolve during this call.
        before = spark.conf.get("spark.sql.runSQLOnFiles", "true")
        spark.conf.set("spark.sql.runSQLOnFiles", "false")
        try:
            spark.sql(f"SELECT EXISTS (\n{body}\n)")
            return spark.sql(body)
        except ParseException as error:
            raise RefusedSql(f"refused: {REFUSALS['NOT_QUERY']}: {error}") from error
        except AnalysisException as error:
            raise RefusedSql(str(error)) from error
        finally:
            spark.conf.set("spark.sql.runSQLOnFiles", before)


def run_sql(spark: SparkSession, sql: str, max_rows: int | None = None) -> DataFrame:
    """Gate, then query: all rows, or the first ``max_rows`` in the query's own order if a cap is asked for."""
    result = check_sql(spark, sql)
    return result if max_rows is None else result.limit(max_rows)


def was_cut(spark: SparkSession, sql: str, max_rows: int) -> bool:
    """Whether ``run_sql`` with that cap leaves rows out (runs the query up to one row more)."""
    return check_sql(spark, sql).limit(max_rows + 1).count() > max_rows
