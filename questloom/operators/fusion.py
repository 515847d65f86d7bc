"""Rank fusion and reranking."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questloom.session import stage

# The fusion constant and the number of chunks kept by a rerank.
FUSION_K = 60
RERANK_TOP = 3
# Sums of reciprocal ranks are compared at this many decimals: the order in
# which a shuffle adds them up must not decide a tie.
FUSION_DIGITS = 12


def reciprocal_score(k: int = FUSION_K) -> Column:
    """The fused score of the grouped rows: sum of 1 / (k + rank)."""
    return F.round(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))), FUSION_DIGITS)


def rrf(*rankings: DataFrame, k: int = FUSION_K) -> DataFrame:
    """Fuse ranked lists (question_id, id, rank) into question_id, id, score, rank.

    score = sum of 1 / (k + rank); an id listed twice counts twice; ties by id.
    """
    union = rankings[0].select("question_id", "id", "rank")
    for other in rankings[1:]:
        union = union.unionByName(other.select("question_id", "id", "rank"))
    fused = union.groupBy("question_id", "id").agg(reciprocal_score(k).alias("score"))
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), F.col("id").asc())
    return fused.withColumn("rank", F.row_number().over(order))


def rerank_by_scores(candidates: DataFrame, k: int = RERANK_TOP) -> DataFrame:
    """The ``k`` best of each question by ``score`` desc; equal scores keep their rank order.

    NaN counts as the highest score.  ``rank`` is renumbered from 1.
    """
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), F.col("rank").asc())
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


Scorer = Callable[[list[tuple[str, str]]], list[float]]


def rerank(
    candidates: DataFrame,
    scorer: Scorer,
    k: int = RERANK_TOP,
    *,
    question_col: str = "question",
    text_col: str = "chunk_text",
    batch_size: int = 256,
) -> DataFrame:
    """Score (question, chunk) pairs with a model, then keep the ``k`` best per question.

    Pairs are shared out by question to as many tasks as there are shuffle partitions; the scorer sees at most
    ``batch_size`` of them at once, and its scores are stored before they are ranked.
    """
    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @F.pandas_udf("double")
    def score(questions: pd.Series, chunks: pd.Series) -> pd.Series:
        pairs = list(zip(questions, chunks))
        scores = np.empty(len(pairs), dtype=np.float64)
        for start in range(0, len(pairs), batch_size):
            part = pairs[start : start + batch_size]
            found = np.asarray(scorer(part), dtype=np.float64)
            if len(found) != len(part):
                raise ValueError(f"scorer returned {len(found)} scores for {len(part)} pairs")
            scores[start : start + len(part)] = found
        return pd.Series(scores)

    spread = candidates.repartition(tasks, "question_id")
    return rerank_by_scores(stage(spread.withColumn("score", score(question_col, text_col)), "scores"), k)

