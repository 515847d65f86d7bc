"""Moving frames over groups that may be too large for one task.

A frame of some rows, or some distance, around each row needs its neighbours only.  A group is cut into blocks, and rows
near the edge of a block are copied to the block beside it (the halo): there they are looked at, but give no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questloom.operators.windows import SLICE_ROWS, _null_safe, rank_in_slices

#: A block of a frame by distance is so many times as wide as the frame.
WIDE = 8


def moving_rows(df: DataFrame, keys: list[str], order: list[str], before: int, after: int, results: dict[str, Column],
                block_rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with ``results`` (name: aggregate) over the ``before`` rows in front of each row, itself, and ``after`` behind it.

    The same as ROWS BETWEEN over ``keys`` ordered by ``order``, which should tell rows apart; rows that tie have some
    order.  Null keys are a group.  A block has ``block_rows`` rows, or as many as the frame where that is more.
    """
    block_rows = max(block_rows, before, after, 1)
    ranked = rank_in_slices(df, keys, order, slice_rows=block_rows).withColumn("_at", F.col("position") - 1)
    own, inside = F.floor(F.col("_at") / block_rows), F.pmod("_at", F.lit(block_rows))
    blocks = [own, F.when(inside >= block_rows - before, own + 1), F.when(inside < after, own - 1)]
    copied = ranked.select(*df.columns, "_at", own.alias("_own"), F.explode(F.array_compact(F.array(*blocks))).alias("_block"))
    frame = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(-before, after)
    added = copied.select(*df.columns, "_own", "_block", *[c.over(frame).alias(name) for name, c in results.items()])
    return added.where("_own = _block").select(*df.columns, *results)


def moving_range(df: DataFrame, keys: list[str], at: str, before: int, after: int, sums: dict[str, Column]) -> DataFrame:
    """``df`` with ``sums`` (name: what is summed) over the rows whose ``at``, a whole number, is from ``before`` below to ``after`` above.

    The same as sums over RANGE BETWEEN over ``keys`` ordered by ``at``; rows without ``at`` have each other as
    frame, and a sum of nulls alone is null.  Rows of equal ``at`` are summed first, so that a tie of any size is one
    row, and frames are laid over the values there are.
    """
    width = WIDE * (before + after + 1)
    each = df.groupBy(*keys, F.col(at).cast("bigint").alias("_at")).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    own, inside = F.floor(F.col("_at") / width), F.pmod("_at", F.lit(width))
    blocks = [own, F.when(inside >= width - before, own + 1), F.when(inside < after, own - 1)]
    copied = each.withColumn("_own", own).withColumn("_block", F.explode_outer(F.array_compact(F.array(*blocks))))
    frame = Window.partitionBy(*keys, "_block").orderBy("_at").rangeBetween(-before, after)
    added = copied.select(*keys, "_at", "_own", "_block", *[F.sum(name).over(frame).alias(name) for name in sums])
    table = added.where(F.col("_own").eqNullSafe(F.col("_block"))).select(*keys, "_at", *sums)
    right, condition = _null_safe(table, [*keys, "_at"])
    return df.withColumn("_at", F.col(at).cast("bigint")).join(right, condition).select(*df.columns, *sums)
