"""Scan a large table against a small one, whichever way the small one's size allows.

All ways run the same kernel.  ``kernel(small)`` prepares the small side (a
matrix, an automaton) and returns a function over Arrow batches of the large
side that yields a bounded reduction (at least one batch, perhaps empty), never
one row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questloom.session import stage

Batches = Iterator[pa.RecordBatch]
Kernel = Callable[[pa.Table], Callable[[Batches], Batches]]

# The small side is shipped to the tasks only up to this many bytes, those of the results that a task keeps included.
SMALL_SIDE_BYTES = 48 << 20
# Bytes of the large side per block when both sides are cut into blocks.
LARGE_BLOCK_BYTES = 128 << 20
# Groups with less than this part of a block on both sides share blocks with others.
SHARED_PART = 4
# Rows of a block that a kernel is given at once.
BATCH_ROWS = 8192
# About so many bytes of rows are packed at once when they go to blocks in streams.
PACK_BYTES = 32 << 20
# A byte of the small side or of results, which are rows, costs about as much as so many packed bytes.
RESULT_COST = 8
# Partial results grow with the number of tasks, so several input splits share a
# task once there are this many times more of them than the cluster can run.
TASK_WAVES = 4


def measure(df: DataFrame, row_bytes: Column) -> tuple[int, int]:
    """Rows and bytes of ``df``: one aggregate, nothing collected but two numbers."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes).alias("b")).first()
    return row["n"], int(row["b"] or 0)


def merge_splits(df: DataFrame) -> DataFrame:
    """Let a task read several splits of a very large table one after another (no shuffle)."""
    spark = df.sparkSession
    slots = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    return df.coalesce(TASK_WAVES * slots)


def scan_against(
    large: DataFrame,
    small: DataFrame,
    kernel: Kernel,
    schema: str,
    *,
    row_bytes: Column,
    large_bytes: Column,
    small_key: str,
    large_key: str,
    match: str | None = None,
    limit_bytes: int | None = None,
    fold: Callable[[pa.Table], pa.Table] | None = None,
) -> DataFrame:
    """Run ``kernel`` over ``large`` with every row of ``small``.

    Up to ``limit_bytes`` (measured) the small side travels with the tasks and
    the large side is not shuffled at all.  Beyond it the small side is cut into
    hash blocks, and the large side streams past each of them (``_stream_past``); ``fold`` may leave out
    rows of a piece of the large side that can't be in any result.  With ``match``, a column of
    both sides, both are cut into hash blocks and each pair of blocks meets in one task; blocks hold rows of one value or of several small ones, and the
    kernel tells the values apart.  A task holds one block of a side, however large either table is.  ``row_bytes`` counts what a task keeps for a
    row of the small side: the row itself and its share of the results.
    """
    limit_bytes = limit_bytes or SMALL_SIDE_BYTES
    count, size = measure(small, row_bytes)
    if size <= limit_bytes:
        table = small.toArrow()

        def run(batches: Batches) -> Batches:
            yield from kernel(table)(batches)

        return merge_splits(large).mapInArrow(run, schema)

    if match is None:
        slots = int(small.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        _, passing = measure(large, large_bytes)
        # Every block costs the large side once more, every cut of the large side the results.
        even = min(slots, max(1, round(math.sqrt(slots * RESULT_COST * size / max(1, passing)))))
        cuts = min(count, max(-(-size // limit_bytes), -(-slots // -(-slots // even))))
        return _stream_past(large, small, kernel, schema, cuts, -(-slots // cuts), small_key, large_key, fold)
    columns_large, columns_small = large.columns, small.columns
    large = large.withColumn("_value", F.col(match))
    small = small.withColumn("_value", F.col(match))
    # How many blocks each side of a value is cut into, of at least a row each: one row per value.
    small_cuts = F.least(F.ceil(F.sum(row_bytes) / limit_bytes), F.count(F.lit(1))).alias("_small_cuts")
    large_cuts = F.least(F.ceil(F.sum(large_bytes) / LARGE_BLOCK_BYTES), F.count(F.lit(1))).alias("_large_cuts")
    sizes = small.groupBy("_value").agg(F.sum(row_bytes).alias("_small_bytes"), small_cuts).join(
        large.groupBy("_value").agg(F.sum(large_bytes).alias("_large_bytes"), large_cuts), "_value"
    )
    sizes = stage(sizes.withColumn("_group", F.monotonically_increasing_id()), "sizes")
    fills = F.greatest(F.col("_small_bytes") / limit_bytes, F.col("_large_bytes") / LARGE_BLOCK_BYTES)
    shared = fills < 1 / SHARED_PART
    filled = sizes.where(shared).agg(F.sum("_small_bytes") / limit_bytes, F.sum("_large_bytes") / LARGE_BLOCK_BYTES).first()
    slots = int(small.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins = max(slots, *[math.ceil(x or 0) for x in filled])
    # At most SHARED_PART values per block of all the rows, so they can be sent to the tasks.
    cuts = F.broadcast(sizes.where(~shared).select("_value", "_group", "_small_cuts", "_large_cuts"))

    def cut(side: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Number the block a row belongs to and repeat it for each block of the other side."""
        rows = side.join(cuts, "_value", "left").withColumn(
            own, F.coalesce(F.pmod(F.xxhash64(key), F.col(f"{own}_cuts")), F.lit(0).cast("bigint"))
        )
        bin_of = -1 - F.pmod(F.xxhash64("_value"), F.lit(bins).cast("bigint"))
        rows = rows.withColumn("_group", F.coalesce("_group", bin_of))
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(f"{other}_cuts", F.lit(1).cast("bigint")) - 1))
        rows = rows.withColumn(other, each).drop("_value", "_small_cuts", "_large_cuts")
        return rows.groupBy("_group", "_large", "_small")

    left = cut(large, large_key, "_large", "_small")
    right = cut(small, small_key, "_small", "_large")

    def meet(left_block: pa.Table, right_block: pa.Table) -> pa.Table:
        kept = left_block.select(columns_large)
        # A side without rows still tells the types.
        batches = kept.to_batches(max_chunksize=BATCH_ROWS) or [pa.RecordBatch.from_pylist([], schema=kept.schema)]
        return pa.Table.from_batches(list(kernel(right_block.select(columns_small))(iter(batches))))

    return left.cogroup(right).applyInArrow(meet, schema)


def _packed(side: DataFrame, key: str, cuts: int, fold: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """(cut, rows): the rows of a side by hash of ``key``, many of one cut as one record (an Arrow stream)."""
    numbered = side.withColumn("_cut", F.pmod(F.xxhash64(key), F.lit(cuts)))

    def emit(waiting: list[pa.RecordBatch]) -> Batches:
        table = pa.Table.from_batches(waiting)
        of = table["_cut"].to_numpy()
        table = table.drop_columns("_cut")
        order = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0])
        for lo, hi in zip(edges, np.r_[edges[1:], len(order)]):
            part = table if len(edges) == 1 else table.take(pa.array(order[lo:hi]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_table(fold(part) if fold else part, max_chunksize=BATCH_ROWS)
            yield pa.RecordBatch.from_pydict({"cut": pa.array([of[order[lo]]], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def pack(batches: Batches) -> Batches:
        waiting, size = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.nbytes
            if size >= PACK_BYTES:
                yield from emit(waiting)
                waiting, size = [], 0
        if waiting:
            yield from emit(waiting)

    return numbered.mapInArrow(pack, "cut bigint, rows binary")


def _stream_past(
    large: DataFrame,
    small: DataFrame,
    kernel: Kernel,
    schema: str,
    small_cuts: int,
    large_cuts: int,
    small_key: str,
    large_key: str,
    fold: Callable[[pa.Table], pa.Table] | None,
) -> DataFrame:
    """Run ``kernel`` for each of ``small_cuts`` blocks of ``small``, in a task that reads ``large`` as a stream.

    With as many blocks as tasks can run, a task reads the whole large side, so that it keeps final results; with fewer
    blocks the large side is cut as well.  Rows travel packed, as the large side goes to every block.
    """
    blocks = _packed(small, small_key, small_cuts)
    every = _packed(large, large_key, large_cuts, fold)

    def each(own: str, other_cuts: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(other_cuts - 1).cast("bigint"))).alias(own)

    left = blocks.select(F.col("cut").alias("_small"), each("_large", large_cuts), F.lit(0).alias("_side"), "rows")
    right = every.select(each("_small", small_cuts), F.col("cut").alias("_large"), F.lit(1).alias("_side"), "rows")
    both = left.unionByName(right)
    both = both.select((F.col("_small") * large_cuts + F.col("_large")).cast("int").alias("_part"), "_side", "rows")
    # A partition each, whatever its bytes: the work is in the pairs.
    both = both.repartitionById(small_cuts * large_cuts, F.col("_part")).sortWithinPartitions("_part", "_side")

    def unpacked(record: pa.BinaryScalar) -> pa.Table:
        return pa.ipc.open_stream(record.as_buffer()).read_all()

    def pieces(record: pa.BinaryScalar) -> list[pa.RecordBatch]:
        table = unpacked(record)
        # A side without rows still tells the types.
        return table.to_batches() or [pa.RecordBatch.from_pylist([], schema=table.schema)]

    def run(batches: Batches) -> Batches:
        records = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
        for _, rows in groupby(records, key=lambda r: r[0]):
            block, first = [], None
            for _, side, record in rows:
                if side:
                    first = record
                    break
                block.append(unpacked(record))
            if block and first is not None:
                passing = (b for r in chain([first], (r for _, _, r in rows)) for b in pieces(r))
                yield from kernel(pa.concat_tables(block).combine_chunks())(passing)

    return both.mapInArrow(run, schema)
