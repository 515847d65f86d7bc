"""The smallest so many rows of a table of any size, without putting the table in order in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questloom.operators.windows import SLICE_ROWS, rank_in_slices
from questloom.session import stage


def value_at(df: DataFrame, value: Column, place: int, slice_rows: int = SLICE_ROWS) -> tuple[object, int] | None:
    """The ``place``-th smallest ``value`` (from 1, nulls first) and how many rows lie below it; None if there are fewer.

    A histogram of the values, added up slice by slice; two numbers come to the driver.
    """
    counts = stage(df.groupBy(value.alias("_value")).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_all", F.lit(1)), "histogram")
    summed = rank_in_slices(counts, ["_all"], ["_value"], total="_rows", slice_rows=slice_rows)
    above = F.col("running_total")
    found = summed.where((above >= place) & (above - F.col("_rows") < place)).select("_value", (above - F.col("_rows")).alias("below")).first()
    return None if found is None else (found["_value"], found["below"])


def latest(df: DataFrame, at: str, key: str, many: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The ``many`` rows with the largest ``at`` (nulls last), among equals those with the smallest ``key`` (unique, not null).

    ``df`` is read several times.
    """
    extra = df.count() - many
    if many <= 0:
        return df.limit(0)
    if extra <= 0:
        return df
    # The largest value that does not fit in whole, and the rows of it that still do.
    edge, below = value_at(df, F.col(at), extra + 1, slice_rows)
    tied = df.where(F.col(at).eqNullSafe(F.lit(edge)))
    newer = F.col(at).isNotNull() if edge is None else F.col(at) > F.lit(edge)
    room = tied.count() - (extra - below)
    last_key, _ = value_at(tied, F.col(key), room, slice_rows)
    return df.where(newer | (F.col(at).eqNullSafe(F.lit(edge)) & (F.col(key) <= F.lit(last_key))))
