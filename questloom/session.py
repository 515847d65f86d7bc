"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Settings this library is tuned for.  Sizes are per task or per batch, so they
# hold on a cluster as they do on one machine; the number of shuffle partitions
# belongs to the deployment and is left to the caller.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Long documents: bound an Arrow batch by bytes as well as by rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "8192",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def build_session(app_name: str = "questloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    A temporary folder is made only where the setting is absent *and* the
    session runs on one machine, as in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="questloom-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside this block are deleted at its end; use what depends on them before, or store it."""
    paths: list[str] = []
    token = _staged.set(paths)
    try:
        yield
    finally:
        _staged.reset(token)
        for path in paths:
            place, files = _place(spark, path)
            files.delete(place, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage so that costly or non-repeatable work upstream (model calls,
    scans of a large corpus) runs once, and survives the loss of executors.
    The table stays until the folder is cleaned, or to the end of a ``staging`` block.
    """
    path = new_path(df.sparkSession, name)
    if (paths := _staged.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at ``path``, asked of its file system."""
    place, files = _place(spark, path)
    return files.exists(place)


def _place(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def ship_package() -> None:
    """Send this package's functions to the executors along with the jobs that use them.

    So a job runs from any working folder and without ``--py-files``.
    """
    import questloom

    cloudpickle.register_pickle_by_value(questloom)
