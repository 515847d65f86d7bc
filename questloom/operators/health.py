"""Corpus health in one aggregate job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questloom.functions.vectors import vector_verdict
from questloom.operators.ann import read_index_keys


def corpus_health(
    corpus: DataFrame | None,
    dim: int,
    *,
    spark=None,
    model_ok: bool = True,
    index_path: str | None = None,
    answered: DataFrame | None = None,
) -> DataFrame:
    """One row: status, flags and counts.

    ``healthy`` with model and corpus, ``degraded`` with the corpus alone,
    ``unhealthy`` without a corpus.  ``indexed`` tells whether there is an index at
    ``index_path`` that holds every record, ``cached_answers`` counts ``answered``.
    """
    spark = corpus.sparkSession if corpus is not None else spark
    index = read_index_keys(spark, index_path) if index_path else None
    indexed = index is not None and corpus is not None and corpus.join(index, "kunnr", "left_anti").isEmpty()
    cached_answers = answered.count() if answered is not None else 0
    if corpus is None:
        counts = spark.range(1).select(
            *[F.lit(0).cast("bigint").alias(c) for c in ("records", "keys", "null_keys", "bad_vectors")]
        )
    else:
        counts = corpus.agg(
            F.count(F.lit(1)).alias("records"),
            F.countDistinct("kunnr").alias("keys"),
            F.count_if(F.col("kunnr").isNull()).alias("null_keys"),
            F.count_if(vector_verdict(F.col("vector"), dim) != "OK").alias("bad_vectors"),
        )
    status = "unhealthy" if corpus is None else "healthy" if model_ok else "degraded"
    return counts.select(
        F.lit(status).alias("status"),
        F.lit(model_ok).alias("model_ok"),
        F.lit(corpus is not None).alias("corpus_ok"),
        F.lit(indexed).alias("indexed"),
        F.lit(cached_answers).cast("bigint").alias("cached_answers"),
        "*",
    )
