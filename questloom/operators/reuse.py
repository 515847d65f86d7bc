"""Reuse of earlier answers: equal questions, similar questions, and upkeep.

An answer table has ``entry_id`` (insertion order), ``question``, ``vector``,
the answer columns and ``last_accessed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questloom.functions.text import fold_ascii
from questloom.operators.cuts import latest
from questloom.operators.knn import knn
from questloom.session import stage

# Fixed value: how similar a question must be.
SIMILAR_THRESHOLD = 0.95
#: Up to so many entries are kept by a top-k of each task; for more, the place of the cut is counted out.
SORTED_CAPACITY = 10_000

ANSWER_FIELDS = ["entry_id", "answer", "exact_quote", "source_chunk_id"]


def reuse_exact(questions: DataFrame, answered: DataFrame) -> DataFrame:
    """Questions that equal an answered one after trimming and ASCII case folding.

    The earliest entry answers.  The answer side is one row per question text
    before it is joined, so a text asked over and over stays a plain lookup.
    """
    firsts = (
        answered.select(fold_ascii(F.col("question")).alias("_key"), *ANSWER_FIELDS)
        .groupBy("_key")
        .agg(F.min(F.struct(*ANSWER_FIELDS)).alias("_first"))
    )
    return (
        questions.withColumn("_key", fold_ascii(F.col("question")))
        .join(firsts, "_key")
        .select(*questions.columns, "_first.*")
    )


def reuse_similar(
    questions: DataFrame, answered: DataFrame, threshold: float = SIMILAR_THRESHOLD
) -> DataFrame:
    """Questions whose vector is at least ``threshold`` close to an answered one.

    The closest entry answers, the earliest among equals; vectors of another
    length never match.
    """
    best = knn(questions, answered, 1, id_col="entry_id").filter(F.col("score") >= threshold)
    return (
        best.select("question_id", F.col("id").alias("entry_id"), "score")
        .join(answered.select(*ANSWER_FIELDS), "entry_id")
        .join(questions, "question_id")
        .select(*questions.columns, *ANSWER_FIELDS, "score")
    )


def retain_recent(answered: DataFrame, uses: DataFrame | None = None, capacity: int | None = None) -> DataFrame:
    """The ``capacity`` most recently used entries (by default all), one per question text.

    ``uses`` (entry_id, used_at) are hits since; each refreshes its entry.  Of entries last used at the same time, the
    earlier ones stay.  No task sees more than ``SORTED_CAPACITY`` entries in order, whatever the capacity.
    """
    entries = answered
    if uses is not None:
        last_use = uses.groupBy("entry_id").agg(F.max("used_at").alias("_used"))
        entries = answered.join(last_use, "entry_id", "left").withColumn(
            "last_accessed", F.greatest("last_accessed", "_used")
        ).drop("_used")
    rest = [c for c in entries.columns if c not in ("entry_id", "last_accessed")]
    merged = (
        entries.groupBy(fold_ascii(F.col("question")).alias("_key"))
        .agg(
            F.min_by(F.struct("entry_id", *rest), "entry_id").alias("_first"),
            F.max("last_accessed").alias("last_accessed"),
        )
        .select("_first.*", "last_accessed")
        .select(*entries.columns)
    )
    if capacity is None:
        return merged
    if capacity > SORTED_CAPACITY:
        return latest(stage(merged, "entries"), "last_accessed", "entry_id", capacity)
    return merged.orderBy(F.col("last_accessed").desc(), F.col("entry_id").asc()).limit(capacity)
