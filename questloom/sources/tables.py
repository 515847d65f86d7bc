"""CSV, text and JSON-lines sources and sinks, and the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from questloom.functions.text import trim_space

# The record columns of a customer file.
RECORD_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("kunnr", "name1", "ort01", "land1")]
)
DEFAULT_TABLE = "kna1"


def _csv_reader(spark: SparkSession, multi_line: bool):
    return (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
    )


def files_by_header(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The CSV files at ``path`` by their first line, in the order of the files' names.

    Only the beginning of each file is looked at for it; the lists are as long as the file listing that the driver
    holds for any read.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    lines = lines.filter("file_block_start = 0").withColumn("at", F.monotonically_increasing_id())
    first = lines.groupBy("file_path").agg(F.min_by("value", "at").alias("header"))
    groups: dict[str, list[str]] = {}
    for row in first.orderBy("file_path").collect():
        groups.setdefault(row["header"], []).append(row["file_path"])
    return groups


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    *,
    multi_line: bool = False,
    columns: list[str] | None = None,
    extra: list[Column] | None = None,
) -> DataFrame:
    """CSV files with headers.  Without ``schema`` every column is a string.

    Columns are told by their header, in every file: files may order them differently.  With ``schema`` its columns are
    read and cast; ``columns`` names the ones to read as strings; with neither, all files must have the same columns.
    A column that a file lacks fails the read.  Types are never guessed: a key like 00001042 keeps its zeros.
    ``multi_line`` allows line breaks inside quotes, at the price that a file can no longer be split between tasks.
    ``extra`` adds columns computed at the read, such as those of ``_metadata``.
    """
    wanted = [F.col(f"`{f.name}`").cast(f.dataType) for f in schema] if schema else [F.col(f"`{c}`") for c in columns or []]
    result: DataFrame | None = None
    for files in files_by_header(spark, path).values() or [[path]]:
        part = _csv_reader(spark, multi_line).option("enforceSchema", False).csv(files)
        names = wanted or [F.col(f"`{c}`") for c in part.columns]
        part = part.select(*names, *(extra or []))
        result = part if result is None else result.unionByName(part)
    return result


def register_csv(
    spark: SparkSession,
    path: str,
    name: str = DEFAULT_TABLE,
    schema: T.StructType | None = None,
    *,
    multi_line: bool = False,
) -> DataFrame:
    """Make a CSV file queryable as table ``name``."""
    table = read_csv(spark, path, schema, multi_line=multi_line)
    table.createOrReplaceTempView(name)
    return table


def read_records(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """The four record columns by header name, with their place in the source.

    Extra columns are ignored, empty fields are null, a malformed row fails the
    job.  ``source_file, source_block, source_row`` order the rows as they
    stand in the files.
    """
    place = [
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_block"),
        F.monotonically_increasing_id().alias("source_row"),
    ]
    return read_csv(spark, path, multi_line=multi_line, columns=RECORD_SCHEMA.names, extra=place)


SOURCE_ORDER = ["source_file", "source_block", "source_row"]


def question_lines(lines: DataFrame) -> DataFrame:
    """Trim each line and drop the blank ones (for batch and stream alike)."""
    return lines.select(trim_space(F.col("value")).alias("question")).filter(F.col("question") != "")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One question per line."""
    return question_lines(spark.read.text(path, lineSep="\n"))


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row, as column ``line``; null fields are left out."""
    return df.select(F.to_json(F.struct("*")).alias("line"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given Parquet table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
