"""Model calls that are made once: a stored table of replies by prompt.

A reply belongs to the digest of its prompt and to the version of the model that gave it.  Prompts that have one are
never sent again, whichever run, retry or question they come from.  New prompts go out in waves, and the replies of a
wave are added to the table before the next one starts: a run that dies loses the wave it was in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questloom.session import new_path, path_exists, stage

#: About so many prompts make a wave.
WAVE_PROMPTS = 100_000

LEDGER_SCHEMA = "prompt_key string, model_version string, raw string"


def prompt_key(prompt: str, version: str):
    """The digest that a reply is kept under."""
    return F.sha2(F.concat(F.lit(f"{len(version)}:{version}:"), F.col(prompt)), 256)


def read_ledger(spark: SparkSession, path: str, version: str) -> DataFrame:
    """prompt_key and raw of one version of the model, one row a key.

    Two runs at the same time may both have asked a prompt; then the smaller reply counts, in every later run.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], "prompt_key string, raw string")
    stored = spark.read.schema(LEDGER_SCHEMA).parquet(path).where(F.col("model_version") == version)
    return stored.groupBy("prompt_key").agg(F.min("raw").alias("raw"))


def ask_once(
    df: DataFrame,
    ask: Callable[[DataFrame], DataFrame],
    path: str,
    version: str,
    prompt_col: str = "prompt",
    wave_prompts: int = WAVE_PROMPTS,
) -> DataFrame:
    """Add ``raw`` and ``model_error`` as ``ask`` does, which is only given the distinct prompts without a reply in ``path``.

    ``ask`` takes (prompt_key, prompt) and adds ``raw`` and ``model_error`` (``apply_model``).  Failures are values
    of this run and not kept, so that the next run asks again; a call that returns null without an error counts as
    one.  A null prompt is never sent and gets nulls.  Rows with the same prompt share a reply.  ``df`` is read several
    times: store it if it is costly.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_key", prompt_key(f"`{prompt_col}`", version))
    prompts = keyed.where("_key IS NOT NULL").groupBy(F.col("_key").alias("prompt_key")).agg(F.first(prompt_col).alias(prompt_col))
    unseen = stage(prompts.join(read_ledger(spark, path, version), "prompt_key", "left_anti"), "unseen-prompts")
    waves = -(-unseen.count() // wave_prompts)
    errors = new_path(spark, "failed-prompts")
    spark.createDataFrame([], "prompt_key string, model_error string").write.parquet(errors)
    for wave in range(waves):
        part = unseen.where(F.pmod(F.xxhash64("prompt_key"), F.lit(waves)) == wave)
        # Written before it is parted, so that no prompt of the wave is sent twice.
        replies = stage(ask(part).select("prompt_key", "raw", "model_error"), "wave")
        kept = replies.where("model_error IS NULL AND raw IS NOT NULL")
        kept.select("prompt_key", F.lit(version).alias("model_version"), "raw").write.mode("append").parquet(path)
        failed = replies.where("model_error IS NOT NULL OR raw IS NULL")
        failed.select("prompt_key", F.coalesce("model_error", F.lit("no reply")).alias("model_error")).write.mode("append").parquet(errors)
    known = read_ledger(spark, path, version).withColumn("model_error", F.lit(None).cast("string"))
    failures = spark.read.schema("prompt_key string, model_error string").parquet(errors)
    replies = known.unionByName(failures.withColumn("raw", F.lit(None).cast("string")))
    found = keyed.join(replies.withColumnRenamed("prompt_key", "_key"), "_key", "left")
    return found.select(*[F.col(f"`{c}`") for c in df.columns], "raw", "model_error")
