"""Questions as a stream: validation, reuse of earlier answers, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questloom.functions.prompts import build_prompt
from questloom.functions.text import fold_ascii
from questloom.operators.answers import validate_questions
from questloom.operators.reuse import ANSWER_FIELDS
from questloom.sources.tables import question_lines


def read_question_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """One question per line of every file that arrives in ``path``."""
    return question_lines(spark.readStream.options(**options).text(path, lineSep="\n"))


def stream_questions(stream: DataFrame, answered: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Add verdict, the reused answer if there is one, and the prompt if there is none.

    Row by row against a static table: no streaming state, no watermark.  Questions are only refused for their length
    if ``max_bytes`` is given.
    """
    firsts = (
        answered.select(fold_ascii(F.col("question")).alias("_key"), *ANSWER_FIELDS)
        .groupBy("_key")
        .agg(F.min(F.struct(*ANSWER_FIELDS)).alias("_first"))
        .select("_key", "_first.entry_id", "_first.answer")
    )
    checked = validate_questions(stream, max_bytes).withColumn("_key", fold_ascii(F.col("question")))
    return (
        checked.join(firsts, "_key", "left")
        .withColumn(
            "prompt",
            F.when(
                (F.col("verdict") == "OK") & F.col("entry_id").isNull(),
                build_prompt("intent", F.col("question")),
            ),
        )
        .drop("_key")
    )
