"""Join of points with the intervals that hold them, for intervals of any and very uneven lengths.

The whole numbers are a tree whose nodes at level l are runs of 16^l numbers.  An interval is cut into the fewest nodes
that make it up, at most 30 a level however long it is; a point lies in one node a level.  So a point and an interval
meet in exactly one node if the interval holds the point, and in none otherwise: an equi-join on (level, node) gives
exactly the pairs asked for, without a residual condition and without a pair that is thrown away.

All points of a node meet all its intervals, so a node with many points is salted: its points are dealt out over as
many tasks as they need, and its intervals are copied to each.  The copies are fewer than the pairs that come of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questloom.session import stage

#: A node at level l holds 16^l numbers.  Ends and points lie below 2^61 in size.
BITS = 4
LEVELS = 16
#: A node of more points is dealt out in parts of about so many.
NODE_ROWS = 1 << 18
#: Up to so many nodes of intervals (12 bytes each) are sent to the tasks that count points.
SENT_NODES = 1 << 20


def interval_nodes(low: str, high: str) -> Column:
    """The nodes, structs of level and node, that make up the whole numbers from ``low`` up to below ``high``.

    Empty where the interval is, or an end is null.
    """
    first = lambda level: f"shiftright({low} + shiftleft(1L, {level} * {BITS}) - 1L, {level} * {BITS})"
    after = lambda level: f"shiftright({high}, {level} * {BITS})"
    run = lambda a, b: f"CASE WHEN {a} < {b} THEN transform(sequence({a}, {b} - 1L), n -> struct(l AS level, n AS node)) ELSE array() END"
    # What the level above makes up is left out; the highest level is taken as it is.
    inner_from, inner_to = first("(l + 1)"), after("(l + 1)")
    whole = run(first("l"), after("l"))
    sides = f"concat({run(first('l'), f'({inner_from}) * {1 << BITS}')}, {run(f'({inner_to}) * {1 << BITS}', after('l'))})"
    at_level = f"CASE WHEN l + 1 < {LEVELS} AND {inner_from} < {inner_to} THEN {sides} ELSE {whole} END"
    usable = f"{low} IS NOT NULL AND {high} IS NOT NULL AND {low} < {high}"
    # Above the lowest level at which nothing is left in the middle, nothing is left either.
    nodes = f"flatten(transform(sequence(0, {LEVELS - 1}), l -> CASE WHEN l = 0 OR {first('l')} < {after('l')} THEN {at_level} ELSE array() END))"
    return F.expr(f"CASE WHEN {usable} THEN {nodes} ELSE array() END")


def interval_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, node_rows: int = NODE_ROWS) -> DataFrame:
    """Every row of ``points`` with every row of ``intervals`` for which ``low`` <= ``at`` < ``high``; whole numbers.

    All columns of both sides, which must not share a name.  Null points and ends, and empty intervals, meet nothing;
    repeated rows count each.  Intervals are cut to the extent of the points, so that nodes beyond it are no work, and there are
    few enough to be sent where the points are looked up.  The sides are read several times: store them if they are costly.
    """
    if shared := {c.lower() for c in points.columns} & {c.lower() for c in intervals.columns}:
        raise ValueError(f"columns on both sides: {sorted(shared)}")
    place = _quoted(at).cast("bigint")
    least, most = points.agg(F.min(place), F.max(place)).first()
    if least is None:
        return points.join(intervals, F.lit(False))
    # What of an interval lies beyond all points is made up by no node (greatest and least would pass over a null).
    from_, to = (_quoted(c).cast("bigint") for c in (low, high))
    ends = intervals.withColumn("_low", F.when(from_.isNotNull(), F.greatest(from_, F.lit(least).cast("bigint"))))
    ends = ends.withColumn("_high", F.when(to.isNotNull(), F.least(to, F.lit(most + 1).cast("bigint"))))
    pieces = ends.select(*intervals.columns, F.explode(interval_nodes("_low", "_high")).alias("_place"))
    pieces = pieces.select(*intervals.columns, F.col("_place.level").alias("_level"), F.col("_place.node").alias("_node"))
    # Sixteen levels at most: the points are looked up at those that occur.
    levels = sorted(r[0] for r in pieces.select("_level").distinct().collect())
    if not levels:
        return points.join(intervals, F.lit(False))

    def places(rows: DataFrame) -> DataFrame:
        of_level = [F.struct(F.lit(n).alias("level"), F.shiftright("_at", n * BITS).alias("node")) for n in levels]
        placed = rows.withColumn("_at", F.col(f"`{at}`").cast("bigint")).where("_at IS NOT NULL")
        placed = placed.withColumn("_place", F.explode(F.array(*of_level)))
        return placed.select(*map(_quoted, rows.columns), F.col("_place.level").alias("_level"), F.col("_place.node").alias("_node"))

    all_columns = list(map(_quoted, [*points.columns, *intervals.columns]))
    used = stage(pieces.select("_level", "_node").distinct(), "nodes")
    few = used.count() <= SENT_NODES

    def met(rows: DataFrame) -> DataFrame:
        # Nodes that no interval has need no count and no shuffle.  Beyond what can be sent, a join on them would be
        # skewed by a crowded node: then all are counted.
        placed = places(rows)
        return placed.join(F.broadcast(used), ["_level", "_node"], "left_semi") if few else placed

    crowded = met(points.select(_quoted(at))).groupBy("_level", "_node").count().where(F.col("count") > node_rows)
    crowded = crowded if few else crowded.join(used, ["_level", "_node"], "left_semi")
    # At most (levels x points / node_rows) nodes.
    crowded = stage(crowded.select("_level", "_node", F.ceil(F.col("count") / node_rows).cast("bigint").alias("_parts")), "crowded-nodes")
    if crowded.isEmpty():
        return met(points).join(pieces, ["_level", "_node"]).select(*all_columns)
    # Stored with the number that deals them out, so that a task that is run again deals alike.
    points = stage(points.withColumn("_of", F.floor(F.rand() * (1 << 52))), "points")
    part = F.coalesce(F.pmod("_of", "_parts"), F.lit(0)).alias("_part")
    dealt = met(points).join(crowded, ["_level", "_node"], "left").select("*", part).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part")
    copied = pieces.join(crowded, ["_level", "_node"], "left").select(*map(_quoted, intervals.columns), "_level", "_node", copies)
    return dealt.join(copied, ["_level", "_node", "_part"]).select(*all_columns)


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")
