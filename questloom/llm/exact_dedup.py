"""Exact deduplication by skew-safe combining.

Rows meet in three steps, each of which compares the full text and not its digest alone:

1. every task combines the equal texts it has read (the partial aggregate below the first exchange),
2. what is left of a digest is merged by salt, so that a text that every task has met still arrives at
   ``salts`` reducers and not at one,
3. the winners of the salts, at most ``salts`` rows for a text, are combined for good.

A text held by a third of all rows therefore costs one row a task, then ``salts`` rows.  The documents find
their winner by digest, without their text, in a join that Spark may split where a digest is crowded; texts
that share a digest without being equal, should there ever be any, are told apart by comparing them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questloom.llm.common import keep_rows, one_of_each, whole_text
from questloom.session import stage

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def winners(texts: DataFrame, salts: int = SALTS) -> DataFrame:
    """Of rows (id, text, digest): one row per different text with its largest id and its number of rows."""
    salted = texts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = salted.groupBy("digest", "salt", "text").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    return (
        merged.repartition("digest")
        .groupBy("digest", "text")
        .agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    )


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, salts: int = SALTS,
                  digest=sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; a null text counts as empty.  ``keep_id`` is the largest id among
    the rows of equal text, ``kept`` marks the row that has it.  Null ids lose against all others; where all ids
    of a class are null, ``keep_id`` is null and its rows are kept.  Rows repeated whole, id included, are one
    document: all of them are marked alike (``drop_copies`` keeps one).  Texts of any length are compared whole.
    Other columns of ``docs`` are not looked at.  An empty table gives an empty result.

    ``digest`` maps the text to the digest that rows meet by; it decides where rows meet, never what is equal.
    """
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    texts = texts.withColumn("digest", digest(F.col("text")))
    best, shared = _best(texts, salts)

    def finished(found: DataFrame) -> DataFrame:
        return found.select(
            F.col("id").alias("doc_id"),
            "keep_id",
            "group_size",
            F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
            "text_sha256",
        )

    light = texts.select("id", "digest", sha256(F.col("text")).alias("text_sha256"))
    if shared.isEmpty():
        return finished(light.join(best, "digest"))
    # Different texts under one digest: those rows meet by the text itself.
    heavy = texts.join(shared, "digest", "left_semi").withColumn("text_sha256", sha256(F.col("text")))
    again = winners(heavy.select("id", "text", "digest"), salts)
    return finished(light.join(shared, "digest", "left_anti").join(best, "digest")).unionByName(
        finished(heavy.join(again, ["digest", "text"]))
    )


def _best(texts: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """(digest, keep_id, group_size) of all different texts, stored; and the digests that several of them have."""
    best = stage(winners(texts, salts).select("digest", "keep_id", "group_size"), "exact-classes")
    return best, best.groupBy("digest").count().where("count > 1").select("digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, salts: int = SALTS) -> DataFrame:
    """The documents that stay, one for each different text, with all their columns.

    That is the row with the largest id; of several rows with that id and that text, the first by the JSON form
    of all other columns.
    """
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    best, shared = _best(texts.withColumn("digest", sha256(F.col("text"))), salts)
    if not shared.isEmpty():
        raise ValueError("two texts have one SHA-256")
    kept = best.select(F.col("keep_id").alias("doc_id"), F.col("digest").alias("text_sha256"))
    on = {"doc_id": F.col(id_col), "text_sha256": sha256(whole_text(text_col))}
    return one_of_each(keep_rows(docs, kept, on), list(on.values()), (id_col, text_col))
