"""Mixing sources to target weights by Pareto order sampling.

The mix has as many words as the documents have.  Each source gets its share of them by weight, at most
``most`` times what it holds; what a capped source cannot take is shared out again by weight.  A document of a
source whose target is r times its size is expected r times: ``floor(r)`` whole copies are certain, and the rest of
the target is filled with one further copy of some documents.  These are chosen by order sampling: every document gets
the random odds u / (1 - u) divided by its inclusion odds p / (1 - p), and the lowest go in until the words are full.
The inclusion chance p is that part of the source's words that is still wanted; if documents have weights, it is proportional
to these, scaled so that the chances add up to the wanted words, and those whose chance would reach 1 are certain.

The cut in a source of any size is found without ordering the source: two histograms of 1,024 cells, the second within
the cell of the first where the words fill up, leave a millionth of the source to be put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questloom.llm.common import let, stage_numbers, whole_text, words
from questloom.session import stage

#: A document is taken so many times at most, and a source up to so many times its size.
MOST = 3
WEIGHTS = (5, 2, 1)
#: Draws are integers below 2**48; the cells of the two histograms are their first and next 10 bits.
BITS, CELL = 48, 10
#: Up to so many sources, their table is sent to the tasks; beyond, it is joined.
SMALL = 10_000


def repeating_weights(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """``sources`` with a weight: those given, over and over, by the sources' order by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, weight) with the target of each.

    Sources are filled in order of the level of words per weight at which they are full.  The level that the others
    reach is what is left over, per weight left over; a source is full if its own level is not above the one reached
    without it.
    """
    cap = F.col("source_size") * most
    by_level = Window.orderBy(F.try_divide(cap.cast("double"), F.col("weight").cast("double")), F.col("source").asc_nulls_last())
    upto, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(upto), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    level = left.cast("double") / weight_left.cast("double")
    full = cap.cast("double") <= F.col("weight") * level
    found = sources.select("source", "source_size", "weight", level.alias("level"), full.alias("full"))
    # Levels rise up to the first source that is not full and fall from there on.
    reached = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return found.select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("full"), cap.cast("double")).otherwise(F.col("weight") * reached).alias("target"),
    )


def uniform(key: Column, seed: int) -> Column:
    """A random integer below 2**48 that depends on ``key`` and ``seed`` alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, BITS // 4), 16, 10).cast("long")


def draw(u: Column, chance: Column) -> Column:
    """An integer below 2**48 in the order of q = (u / (1 - u)) / (p / (1 - p)), as q / (1 + q); 0 for a certain document.

    The cut is to be expected near q = 1, where neighbours in u stay apart whatever the chance.
    """
    share = (u.cast("double") + 0.5) / (1 << BITS)
    random, included = share * (1 - chance), chance * (1 - share)
    place = F.least(F.floor(random / (random + included) * (1 << BITS)).cast("long"), F.lit((1 << BITS) - 1))
    return F.when(chance >= 1, F.lit(0).cast("long")).when(chance > 0, place).otherwise(u)


def rates(weighed: DataFrame, goal: DataFrame) -> DataFrame:
    """(of, rate): per source the factor that makes chances min(1, rate * weight) add up to the wanted words.

    ``weighed`` has source, weight and the words of that weight.  Weights whose chance reaches 1 leave with all their
    words and the rest is scaled again, until none leaves: the rate only rises, and each round but the last takes out a weight.
    """
    held = weighed.join(goal.select("of", "wanted"), F.col("source").eqNullSafe(F.col("of"))).where("wanted > 0")
    held = stage_numbers(held.select("of", "wanted", "weight", "words"), "mix-weights")
    found, before = None, None
    while True:
        if found is None:
            rest = held.withColumn("certain", F.lit(False))
        else:
            known = found.select(F.col("of").alias("rated"), "rate")
            rest = held.join(known, F.col("of").eqNullSafe(F.col("rated"))).withColumn("certain", F.col("rate") * F.col("weight") >= 1)
        out = F.coalesce(F.sum(F.when(F.col("certain"), F.col("words"))), F.lit(0))
        left = F.sum(F.when(~F.col("certain"), F.col("weight") * F.col("words")))
        rate = F.coalesce(F.try_divide(F.first("wanted") - out, left), F.lit(0.0))
        if found is not None:  # rounding must not let it fall
            rate = F.greatest(rate, F.max("rate"))
        found = stage_numbers(
            rest.groupBy("of").agg(rate.alias("rate"), F.count_if("certain").alias("n_certain")), "mix-rates"
        )
        certain = found.agg(F.coalesce(F.sum("n_certain"), F.lit(0))).first()[0]
        if certain == before:
            return found.select("of", "rate")
        before = certain


def _cells(rows: DataFrame, shift: int, sources: DataFrame) -> DataFrame:
    """Per source: the histogram cell where its words fill up, and the words before it; nothing if they never do."""
    cells = rows.groupBy("source", F.shiftright("draw", shift).alias("cell")).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("cell")
    cells = cells.withColumn("through", F.sum("words").over(upto))
    sources = sources.select("of", "wanted", "before")
    joined = cells.join(sources, cells["source"].eqNullSafe(sources["of"]))
    last = joined.where(F.col("before") + F.col("through") >= F.col("wanted"))
    return last.groupBy("of", "wanted").agg(
        F.min("cell").alias("cell"),
        F.min_by(F.col("before") + F.col("through") - F.col("words"), "cell").alias("before"),
    )


def mix(docs: DataFrame, *, weights=None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weight_col: str | None = None, most: int = MOST, seed: int = 1, keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source, source_size, target, copies, taken (size * copies).

    ``weights`` maps a table (source, source_size) to one with a positive whole ``weight`` too; by default 5, 2, 1 in
    turn.  ``weight_col`` names a positive weight of documents within their source (null or not positive: 1).
    A null source is a source.  Null and empty texts have size 0 and are copied like the others of their draw; they
    take nothing.  Draws depend on the id and ``seed`` alone, so that reruns agree and rows that repeat an id are taken
    together; null ids share one draw.  Where a cut falls between two documents, the side nearer to the target is taken.
    A mix of no documents or no words is empty of words.  ``keep`` names further columns to carry along.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        let(words(whole_text(text_col)), lambda w: F.size(w).cast("long")).alias("size"),
        uniform(F.coalesce(F.col(id_col).cast("string"), F.lit("")), seed).alias("u"),
        *([_positive(weight_col).alias("weight")] if weight_col else []),
        *[c.alias(name) for name, c in (keep or {}).items()],
    )
    sized = stage(sized, "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets((weights or repeating_weights)(stage_numbers(sources, "mix-sources")), most)
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0)).cast("long")
    goal = stage_numbers(
        goal.select(
            F.col("source").alias("of"),
            "source_size",
            "target",
            whole.alias("whole"),
            (F.col("target") - whole * F.col("source_size")).alias("wanted"),
            F.lit(0).cast("long").alias("before"),
        ),
        "mix-targets",
    )
    if weight_col:
        rated = rates(sized.groupBy("source", "weight").agg(F.sum("size").alias("words")), goal).withColumnRenamed("of", "rated")
        goal = stage_numbers(goal.join(rated, F.col("of").eqNullSafe(F.col("rated")), "left").drop("rated"), "mix-targets")
    else:
        goal = goal.withColumn("rate", F.try_divide(F.col("wanted"), F.col("source_size").cast("double")))
    place = draw(F.col("u"), F.coalesce(F.col("rate"), F.lit(0.0)) * (F.col("weight") if weight_col else 1.0))
    small = goal.count() <= SMALL

    def with_source(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
        return rows.join(F.broadcast(table) if small else table, rows["source"].eqNullSafe(table["of"]), how)

    open_goal = goal.where("wanted > 0").select("of", "wanted", "before")
    opened = goal.where("wanted > 0").select("of", "rate")
    light = with_source(sized, opened).select("source", "doc_id", place.alias("draw"), "size")
    first = stage_numbers(_cells(light, BITS - CELL, open_goal), "mix-cells")
    inside = with_source(light, first).where(F.shiftright("draw", BITS - CELL) == F.col("cell")).select(*light.columns)
    second = stage_numbers(_cells(inside, BITS - 2 * CELL, first), "mix-cells")
    last = with_source(light, second).where(F.shiftright("draw", BITS - 2 * CELL) == F.col("cell"))
    # The few that are left, in order; equal draws go in together.
    by_draw = last.groupBy("of", "wanted", "before", "draw").agg(F.sum("size").alias("size"))
    through = F.col("before") + F.sum("size").over(Window.partitionBy("of").orderBy("draw"))
    ends = by_draw.select("of", "wanted", "draw", through.alias("through")).unionByName(
        second.select("of", "wanted", (F.shiftleft("cell", BITS - 2 * CELL) - 1).alias("draw"), F.col("before").alias("through"))
    )
    nearest = F.min_by("draw", F.struct(F.abs(F.col("through") - F.col("wanted")), F.col("draw")))
    cut = stage_numbers(ends.groupBy("of").agg(nearest.alias("cut")), "mix-cuts")
    joined_goal = goal.join(cut.withColumnRenamed("of", "cut_of"), F.col("of").eqNullSafe(F.col("cut_of")), "left")
    plan = joined_goal.select("of", "source_size", "target", "whole", "rate", F.coalesce("cut", F.lit(-1)).alias("cut"))
    plan = stage_numbers(plan, "mix-plan")
    copies = F.col("whole") + F.when(place <= F.col("cut"), 1).otherwise(0)
    return with_source(sized, plan).select(
        "doc_id",
        *(keep or {}),
        "source",
        "size",
        "source_size",
        "target",
        copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def _positive(weight_col: str) -> Column:
    weight = F.col(weight_col).cast("double")
    return F.when(weight > 0, weight).otherwise(1.0)


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it (not at all where it does not)."""
    mark = F.xxhash64(whole_text(text_col))
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, keep={"mark": mark}, **options)
    plan = plan.where("copies > 0").select("doc_id", "source", "mark", "copies").distinct()
    plan = plan.select(*[F.col(c).alias(f"mix::{c}") for c in plan.columns])
    same = (
        F.col(id_col).eqNullSafe(F.col("`mix::doc_id`"))
        & F.col(source_col).eqNullSafe(F.col("`mix::source`"))
        & (mark == F.col("`mix::mark`"))
    )
    found = docs.join(plan, same)
    repeats = F.explode(F.sequence(F.lit(1).cast("long"), F.col("`mix::copies`")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], repeats.alias("mix::copy")).drop("mix::copy")
