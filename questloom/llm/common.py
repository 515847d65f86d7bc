"""Column helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from questloom.session import stage

#: What parts words: the space and the ASCII control white space.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """The maximal runs of characters that are not white space, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def stage_numbers(df: DataFrame, name: str) -> DataFrame:
    """``stage`` for narrow tables made from narrow tables: four tasks a core at most write them, so that small files and
    tasks stay few.  (Where text comes in, the width must follow the data: use ``stage``.)"""
    return stage(df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism), name)


def keep_rows(docs: DataFrame, chosen: DataFrame, on: dict[str, Column], how: str = "left_semi") -> DataFrame:
    """The rows of ``docs``, whole, that ``chosen`` has (or, with ``left_anti``, has not).

    ``on`` gives for each column of ``chosen`` the expression over ``docs`` it must equal (nulls are equal).
    The columns of ``chosen`` get names of their own, so that none can clash.
    """
    renamed = chosen.select(*[F.col(c).alias(f"chosen::{c}") for c in on])
    condition = F.lit(True)
    for c, expression in on.items():
        condition = condition & expression.eqNullSafe(F.col(f"`chosen::{c}`"))
    return docs.join(renamed, condition, how)


def one_of_each(rows: DataFrame, keys: list[Column], known: tuple[str, ...]) -> DataFrame:
    """Of the rows that agree in ``keys`` the first by the JSON form of all columns but ``known``."""
    others = [F.col(f"`{c}`") for c in rows.columns if c not in known]
    order = F.to_json(F.struct(*others)) if others else F.lit(1)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("each::place", place).where("`each::place` = 1").drop("each::place")
