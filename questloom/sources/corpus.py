"""The corpus table: one row per record, with its sentence and vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from questloom.session import path_exists
from questloom.sources.keyed import is_keyed, merge_keyed, open_keyed

# The columns of the corpus.
CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("kunnr", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("city", T.StringType(), False),
        T.StructField("sentence", T.StringType(), False),
        T.StructField("vector", T.ArrayType(T.FloatType(), False), False),
    ]
)


def corpus_exists(spark: SparkSession, path: str) -> bool:
    """Whether a corpus was written at ``path``."""
    return path_exists(spark, path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame | None:
    """The corpus, or nothing if none was written yet."""
    if is_keyed(spark, path):
        table = open_keyed(spark, path)
        return table.rows() if table else None
    return spark.read.schema(CORPUS_SCHEMA).parquet(path) if corpus_exists(spark, path) else None


def create_corpus(spark: SparkSession, path: str) -> None:
    """Write an empty corpus unless there is one."""
    if not corpus_exists(spark, path):
        spark.createDataFrame([], CORPUS_SCHEMA).write.parquet(path)


def write_corpus(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Append to the corpus (made if missing) or replace it (``overwrite``).

    Appends to plain Parquet have no transactions between writers: keep one writer per corpus, or make
    it in buckets (``ingest(buckets=...)``).  There, keys that are known are not appended again.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"mode must be append or overwrite, not {mode}")
    if is_keyed(rows.sparkSession, path):
        merge_keyed(rows, path, replace=mode == "overwrite")
        return
    rows.write.mode(mode).parquet(path)
