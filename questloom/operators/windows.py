"""Ranking over groups that may be too large for one task.

A window over a key puts each key in one task.  Where a key holds many rows, they are cut into slices along the sort
order.  The cuts (splitters) are quantiles of a sample and stored as a table, so that a row finds its slice from its own
values and the table alone: however often and in whatever partitions the rows are read, they fall into the same slices.
Rows are ranked inside their slice and lifted by what lies in the slices before and after: a table of one row per key
and slice.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from questloom.session import stage

#: About so many rows of a key make a slice, and so many of them are sampled.
SLICE_ROWS = 1 << 18
SAMPLED = 48
#: A table of splitters up to this many bytes travels with the tasks.
SENT_BYTES = 32 << 20


def _null_safe(other: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """``other`` and the condition to join it on ``keys``; null keys are a group like any other."""
    renamed = other.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    return renamed, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys])


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind)
    return _hashable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def _not_above(points: Column, point: Column) -> Column:
    """How many of the ascending ``points`` (2^20 at most) are not above ``point``, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(20))])

    def halve(at: Column, step: Column) -> Column:
        inside = at + step <= F.size(points)
        return F.when(inside & (F.get(points, at + step - 1) <= point), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), halve)


def splitters(df: DataFrame, keys: list[str], point: Column, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The stored table (keys, cell, points, roots): for every key of over about ``slice_rows`` rows its cuts, ascending.

    About ``SAMPLED`` rows a slice are looked at, whatever the size of ``df``.  The cuts of a key lie in cells of about
    the root of their number; ``roots`` are the first cuts of all cells and the same in each row of a key.
    """
    share = min(1.0, SAMPLED / slice_rows)
    sample = stage(df.select(*keys, point.alias("_point")).where(F.rand() < share), "splitter-sample")
    of_key = Window.partitionBy(*keys)
    each = sample.withColumn("_at", F.row_number().over(of_key.orderBy("_point")))
    cuts = each.where(F.col("_at") % max(1, round(slice_rows * share)) == 0)
    cuts = cuts.withColumn("_n", F.count(F.lit(1)).over(of_key)).withColumn("_i", F.row_number().over(of_key.orderBy("_at")) - 1)
    cuts = cuts.withColumn("_width", F.ceil(F.sqrt("_n"))).withColumn("_cell", F.floor(F.col("_i") / F.col("_width")))
    cells = cuts.groupBy(*keys, "_cell", "_width").agg(F.array_sort(F.collect_list("_point")).alias("_points"))
    heads = F.collect_list(F.struct("_cell", F.get("_points", F.lit(0)).alias("p"))).over(of_key)
    roots = F.transform(F.array_sort(heads), lambda x: x["p"])
    return stage(cells.select(*keys, "_cell", "_width", "_points", roots.alias("_roots")), "splitters")


def slice_of(df: DataFrame, keys: list[str], point: Column, table: DataFrame) -> DataFrame:
    """``df`` with _slice (bigint): how many of its key's cuts are not above the row's ``point``; 0 without cuts."""
    size = table.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("_points", "_roots")))), F.lit(0))).first()[0]
    send = F.broadcast if size <= SENT_BYTES else (lambda small: small)
    first, on_key = _null_safe(table.where("_cell = 0").select(*keys, "_roots", "_width"), keys)
    rows = df.withColumn("_point", point)
    found = rows.join(send(first), on_key, "left").withColumn("_in", (_not_above(F.col("_roots"), F.col("_point")) - 1).cast("bigint"))
    found = found.select(*df.columns, "_point", "_in", "_width")
    cells, on_cell = _null_safe(table.select(*keys, F.col("_cell").alias("_of"), "_points"), keys)
    found = found.join(send(cells), on_cell & (F.col("_in") == F.col("_of")), "left")
    place = F.col("_in") * F.col("_width") + _not_above(F.col("_points"), F.col("_point"))
    return found.select(*df.columns, F.coalesce(place, F.lit(0)).cast("bigint").alias("_slice"))


def in_slices(df: DataFrame, keys: list[str], order: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with a column _slice that does not decrease along ``order`` within a key; large keys have many slices.

    Rows that tie in ``order`` are told apart by a hash of all their columns.  Where many are alike in every column, the
    table is stored with a random number a row, and that decides.
    """
    whole = [F.col(f"`{f.name}`") for f in df.schema if _hashable(f.dataType)]
    point = F.struct(*[F.col(c) for c in order], F.xxhash64(*whole).alias("_hash"))
    table = splitters(df, keys, point, slice_rows)
    if table.isEmpty():
        return df.withColumn("_slice", F.lit(0).cast("bigint"))
    if not table.where(F.size("_points") > F.size(F.array_distinct("_points"))).isEmpty():
        stored = stage(df.withColumn("_random", F.rand()), "tied-rows")
        point = F.struct(*[F.col(c) for c in order], F.col("_random"))
        return slice_of(stored, keys, point, splitters(stored, keys, point, slice_rows)).drop("_random")
    return slice_of(df, keys, point, table)


def rank_in_slices(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    cut: Column | None = None,
    *,
    ties: list[str] | None = None,
    total: str | None = None,
    beside: str | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add position, group_size, rank, dense_rank and, if asked for, running_total and neighbours.

    The same as row_number, count, rank, dense_rank, a running sum of ``total``, and lag, lead, first and last value of
    ``beside`` (previous, next, first, last) over ``keys`` ordered by ``order``.  ``ties`` are the columns rank looks
    at, the first ones of ``order``, by default all; rows that tie may lie in several slices.  Slices are those of
    ``in_slices``, or ``cut``, which must not decrease along ``order`` and depend on the row alone.
    """
    ties = ties or order
    sliced = in_slices(df, keys, order, slice_rows) if cut is None else df.withColumn("_slice", cut)
    whole = Window.partitionBy(*keys, "_slice")
    in_order, in_ties = whole.orderBy(*order), whole.orderBy(*ties)
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.col(total) if total else F.lit(0)
    near = F.col(beside) if beside else F.lit(None).cast("int")
    added = [
        F.row_number().over(in_order).cast("bigint").alias("_position"),
        F.rank().over(in_ties).cast("bigint").alias("_rank"),
        F.dense_rank().over(in_ties).cast("bigint").alias("_dense"),
        F.struct(*ties).alias("_tie"),
    ]
    if total:
        added.append(F.sum(value).over(running).alias("_running"))
    if beside:
        added += [F.lag(near).over(in_order).alias("_previous"), F.lead(near).over(in_order).alias("_next"), near.alias("_near")]
    local = sliced.select("*", *added)
    per_slice = local.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("_dense").alias("_d"),
        F.max("_rank").alias("_tail_rank"),
        F.min("_tie").alias("_head_tie"),
        F.max("_tie").alias("_tail_tie"),
        F.sum(value).alias("_s"),
        (F.min_by("_near", "_position") if beside else F.lit(None)).alias("_head"),
        (F.max_by("_near", "_position") if beside else F.lit(None)).alias("_tail"),
    )
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    group = by_slice.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A slice may go on with the tie that the one before ended with.
    lifts = per_slice.select(
        "*",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        (F.lag(F.lit(1), 1, 0).over(by_slice) == 1) & F.col("_head_tie").eqNullSafe(F.lag("_tail_tie").over(by_slice)),
    )
    lifts = lifts.withColumnRenamed(lifts.columns[-1], "_goes_on")
    starts_here = ~F.col("_goes_on") | (F.col("_d") > 1)
    lifts = lifts.withColumn("_run", F.when(starts_here, F.col("_n0") + F.col("_tail_rank")))
    goes_on = F.col("_goes_on").cast("bigint")
    lifts = lifts.select(
        *keys,
        "_slice",
        "_n",
        "_n0",
        "_goes_on",
        F.last("_run", ignorenulls=True).over(before).alias("_run"),
        (F.coalesce(F.sum(F.col("_d") - goes_on).over(before), F.lit(0)) - goes_on).alias("_d0"),
        F.sum("_s").over(before).alias("_s0"),
        F.sum("_n").over(group).alias("group_size"),
        F.lag("_tail").over(by_slice).alias("_before"),
        F.lead("_head").over(by_slice).alias("_after"),
        F.first("_head").over(group).alias("_first"),
        F.last("_tail").over(group).alias("_last"),
    )
    right, condition = _null_safe(lifts, [*keys, "_slice"])
    lifted = local.join(right, condition)
    in_run = F.col("_goes_on") & (F.col("_rank") == 1)
    results = [
        (F.col("_position") + F.col("_n0")).alias("position"),
        F.col("group_size"),
        F.when(in_run, F.col("_run")).otherwise(F.col("_rank") + F.col("_n0")).alias("rank"),
        (F.col("_dense") + F.col("_d0")).alias("dense_rank"),
    ]
    if total:
        known = F.col("_running").isNotNull() | F.col("_s0").isNotNull()
        both = F.coalesce("_running", F.lit(0)) + F.coalesce("_s0", F.lit(0))
        results.append(F.when(known, both).alias("running_total"))
    if beside:
        results += [
            F.when(F.col("_position") == 1, F.col("_before")).otherwise(F.col("_previous")).alias("previous"),
            F.when(F.col("_position") == F.col("_n"), F.col("_after")).otherwise(F.col("_next")).alias("next"),
            F.col("_first").alias("first"),
            F.col("_last").alias("last"),
        ]
    return lifted.select(*df.columns, *results)


def tile(position: Column, size: Column, tiles: int) -> Column:
    """ntile from a position: the first ``size % tiles`` tiles hold one row more."""
    small = F.floor(size / tiles)
    extra = size % tiles
    edge = extra * (small + 1)
    return (
        F.when(position <= edge, F.floor((position - 1) / (small + 1)))
        .otherwise(extra + F.floor((position - 1 - edge) / F.greatest(small, F.lit(1))))
        .cast("bigint")
        + 1
    )
