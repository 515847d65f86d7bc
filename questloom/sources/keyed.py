"""A table kept in hash buckets of its key, with a log of commits.

Rows lie in Parquet files by bucket and, within a bucket, in key order, a bounded number to a file.  Parquet itself keeps a
Bloom filter of each file's keys.  A commit is a folder of such files, a list of them (bucket, file, first and last
key, rows) and one entry in the log.  Rows count from the moment the entry is there, which is put under its version by
a rename that fails if the name is taken:

* a writer that dies before leaves files that nobody reads, and its batch is written again by the replay;
* a batch whose name is in the log is not written again;
* of two writers that began at the same version one comes second: it looks its rows up in what the first has added,
  and tries again.

So no key is ever there twice, where the file system renames atomically (HDFS, or one machine's disk for the writers of
one process); on a store that does not, keep one writer per table.

Lookups read the files whose bucket and key range can hold a wanted key, and of no others so much as the footer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from questloom.session import path_exists

BUCKETS = 64
#: Rows to a file at most: it bounds the key range of a file, and so what a lookup reads.
ROWS_PER_FILE = 1_000_000
#: Up to so many keys are compared with the files' key ranges; a larger batch meets nearly all files anyway.
MOST_COMPARED = 100_000
#: Up to so many keys go to the scan as literals, where Parquet asks its Bloom filters (Spark's own bound for exact IN filters).
MOST_LITERALS = 10
BUCKET, COMMIT = "key_bucket", "commit_id"

_ENTRY = "version long, batch string, folder string, n long, buckets int, key string, fields string, origin long, replaces boolean"
_FILES = f"{COMMIT} string, {BUCKET} int, file string, first string, last string, n long"


@dataclass(frozen=True)
class KeyedTable:
    """One version of a table: the commits that make it up."""

    spark: SparkSession
    path: str
    version: int
    origin: int  # the version in which the contents were last replaced
    buckets: int
    key: str
    schema: T.StructType
    batches: frozenset[str]
    commits: tuple[tuple[int, str], ...]  # version and folder of those that hold rows

    def rows(self) -> DataFrame:
        """All rows."""
        return self._read([f"{self.path}/data/{COMMIT}={folder}" for _, folder in self.commits])

    def files(self, after: int = -1) -> DataFrame:
        """The files of the commits after a version: commit_id, key_bucket, file, first, last, n."""
        lists = [f"{self.path}/files/{folder}" for version, folder in self.commits if version > after]
        read = self.spark.read.schema(_FILES)
        return read.parquet(*lists) if lists else self.spark.createDataFrame([], _FILES)

    def holding(self, keys: DataFrame, after: int = -1) -> DataFrame:
        """The rows of the files that can hold one of ``keys`` (a column named like the key; nulls find nothing).

        More rows than asked for, never fewer; join them with the keys.  ``keys`` is read up to three times.
        """
        wanted = keys.select(F.col(self.key).cast("string").alias("wanted")).where("wanted IS NOT NULL")
        files = self.files(after)
        count = wanted.limit(MOST_COMPARED + 1).count()
        if count <= MOST_COMPARED:
            inside = F.col("wanted").between(F.col("first"), F.col("last"))
            files = files.join(wanted, (F.col(BUCKET) == bucket_of("wanted", self.buckets)) & inside, "left_semi")
        found = self._read([row["file"] for row in files.select("file").collect()])
        if count <= MOST_LITERALS:
            found = found.where(F.col(self.key).isin([row["wanted"] for row in wanted.collect()]))
        return found

    def _read(self, places: list[str]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema, T.StructField(COMMIT, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*places)
        return found.drop(COMMIT, BUCKET)


def bucket_of(key: Column | str, buckets: int) -> Column:
    """The bucket of a key: a whole number below ``buckets``; that of null is 0."""
    key = F.col(key) if isinstance(key, str) else key
    number = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")
    return F.coalesce(F.pmod(number, F.lit(buckets)), F.lit(0)).cast("int")


def is_keyed(spark: SparkSession, path: str) -> bool:
    """Whether a table with a log is at ``path``."""
    return path_exists(spark, f"{path}/log")


def open_keyed(spark: SparkSession, path: str) -> KeyedTable | None:
    """The table as of now, or nothing if there is no commit.  The log is small: an entry per commit since the last rewrite counts."""
    if not is_keyed(spark, path):
        return None
    log = sorted(spark.read.schema(_ENTRY).json(f"{path}/log").collect(), key=lambda entry: entry["version"])
    if not log:
        return None
    start = max((i for i, entry in enumerate(log) if entry["replaces"]), default=0)
    last = log[-1]
    return KeyedTable(
        spark,
        path,
        last["version"],
        last["origin"],
        last["buckets"],
        last["key"],
        T.StructType.fromJson(json.loads(last["fields"])),
        frozenset(entry["batch"] for entry in log),
        tuple((entry["version"], entry["folder"]) for entry in log[start:] if entry["n"]),
    )


def arrange(rows: DataFrame, buckets: int, key: str) -> DataFrame:
    """Deal rows out by ranges of bucket and key, so that a crowded bucket is many tasks and files have narrow key ranges."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(tasks, bucket_of(key, buckets), key)


def merge_keyed(
    new: DataFrame,
    path: str,
    *,
    key: str = "kunnr",
    batch: str | None = None,
    buckets: int | None = None,
    replace: bool = False,
    known: KeyedTable | None = None,
    before_commit: Callable[[], None] | None = None,
) -> int:
    """Add the rows whose key the table does not hold; never update.  Returns how many.

    ``new`` has each key once; rows with a null key are all added.  ``batch`` names the rows: a name that the log has adds
    nothing, whatever the rows (nothing at all is read then).  ``buckets`` counts for a table that is made or replaced
    here.  With ``replace`` the table consists of ``new`` afterwards.  ``known`` is a version in which the rows were
    looked up already; only later commits are searched then, and it is an error if the contents were replaced since.
    ``before_commit`` is called between writing and committing, e.g. to stop there in a test.
    """
    spark = new.sparkSession
    if clash := {BUCKET, COMMIT} & set(new.columns):
        raise ValueError(f"the columns {sorted(clash)} are the table's own")
    batch = batch or uuid.uuid4().hex
    rows, looked_up, origin = new, known.version if known else -1, known.origin if known else None
    while True:
        table = open_keyed(spark, path)
        if table and batch in table.batches:
            return 0
        if table and not replace:
            if (table.key, table.schema.simpleString()) != (key, new.schema.simpleString()):
                raise ValueError(f"the table has key {table.key} and {table.schema.simpleString()}")
            if origin not in (None, table.origin):  # replaced meanwhile: what was known may be new
                if known:
                    raise RuntimeError(f"{path} was replaced while records for it were prepared; run it again")
                rows, looked_up = new, -1
            origin = table.origin
            if looked_up < table.version:
                old = table.holding(rows, looked_up).select(key).distinct()
                rows = rows.join(old, key, "left_anti").select(new.columns)
        keep = table.buckets if table and not (replace and buckets) else buckets or BUCKETS
        folder, count = _write(arrange(rows, keep, key), path, key, keep)
        if before_commit:
            before_commit()
        version = table.version + 1 if table else 0
        origin_now = version if replace or not table else table.origin
        if _publish(spark, path, _entry(version, batch, folder, count, keep, key, new.schema, origin_now, replace)):
            return count
        looked_up = table.version if table else -1
        if count and not replace:
            staged = f"{path}/data/{COMMIT}={folder}"
            rows = spark.read.schema(new.schema).option("recursiveFileLookup", "true").parquet(staged)


def rewrite_keyed(spark: SparkSession, path: str, buckets: int | None = None) -> int:
    """Write all rows anew, into few files and, if wanted, another number of buckets.  Returns the rows.

    What was added meanwhile must not get lost: if the version is no longer the one that was read, all is done again.
    Earlier versions keep their files, for those who still read them.
    """
    while True:
        table = open_keyed(spark, path)
        if table is None:
            return 0
        keep = buckets or table.buckets
        folder, count = _write(arrange(table.rows(), keep, table.key), path, table.key, keep)
        entry = _entry(
            table.version + 1, uuid.uuid4().hex, folder, count, keep, table.key, table.schema, table.origin, True
        )
        if _publish(spark, path, entry):
            return count


def _entry(version, batch, folder, n, buckets, key, schema, origin, replaces) -> dict:
    values = (version, batch, folder, n, buckets, key, schema.json(), origin, replaces)
    return dict(zip((field.split()[0] for field in _ENTRY.split(", ")), values, strict=True))


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> tuple[str, int]:
    """Write the files of a commit and the list of them.  Returns the folder's name and the number of rows."""
    spark, folder = rows.sparkSession, uuid.uuid4().hex
    place = f"{path}/data/{COMMIT}={folder}"
    sorted_rows = rows.withColumn(BUCKET, bucket_of(key, buckets)).sortWithinPartitions(BUCKET, key)
    write = sorted_rows.write.partitionBy(BUCKET).option("maxRecordsPerFile", ROWS_PER_FILE)
    write = write.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    write.parquet(place)
    written = spark.read.schema(T.StructType([*rows.schema, T.StructField(BUCKET, T.IntegerType())])).parquet(place)
    text = F.col(key).cast("string")
    files = written.groupBy(F.lit(folder).alias(COMMIT), BUCKET, F.col("_metadata.file_path").alias("file")).agg(
        F.min(text).alias("first"), F.max(text).alias("last"), F.count(F.lit(1)).alias("n")
    )
    files.write.parquet(f"{path}/files/{folder}")
    counted = spark.read.schema(_FILES).parquet(f"{path}/files/{folder}").agg(F.sum("n").alias("n")).first()
    return folder, counted["n"] or 0


def _publish(spark: SparkSession, path: str, entry: dict) -> bool:
    """Put an entry into the log under its version; false if another writer's is there."""
    context = spark.sparkContext
    hadoop, conf = context._jvm.org.apache.hadoop.fs, context._jsc.hadoopConfiguration()
    name = f"{entry['version']:020d}.json"
    ready, final = hadoop.Path(f"{path}/log/.{uuid.uuid4().hex}"), hadoop.Path(f"{path}/log/{name}")
    files = hadoop.FileContext.getFileContext(ready.toUri(), conf) if ready.toUri().getScheme() else hadoop.FileContext.getFileContext(conf)
    out = ready.getFileSystem(conf).create(ready, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    no_options = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        files.rename(ready, final, no_options)
        return True
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        files.delete(ready, False)
        return False
