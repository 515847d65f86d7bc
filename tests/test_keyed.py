"""The table in hash buckets with a log of commits."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from questloom.models import HashingEmbedder
from questloom.operators.ingest import find_existing, ingest, merge_insert
from questloom.session import path_exists, shared_dir
from questloom.sources.corpus import read_corpus, write_corpus
from questloom.sources.keyed import bucket_of, merge_keyed, open_keyed, rewrite_keyed
from questloom.streaming.ingest_stream import stream_ingest
from tests.conftest import rows


def numbered(spark, start, stop, value="v"):
    return spark.range(start, stop).select(
        F.format_string("%06d", "id").alias("k"), F.lit(value).alias("v"), F.col("id").alias("n")
    )


def merge(df, path, **options):
    return merge_keyed(df, path, key="k", **{"buckets": 8, **options})


def test_merge_inserts_only_and_counts(spark, path):
    target = path("keyed")
    assert open_keyed(spark, target) is None
    assert merge(numbered(spark, 0, 100), target) == 100
    assert merge(numbered(spark, 50, 120, "late"), target) == 20
    assert merge(numbered(spark, 0, 120, "again"), target) == 0
    table = open_keyed(spark, target)
    assert (table.version, table.buckets, table.key) == (2, 8, "k")
    want = [(f"{i:06d}", "v" if i < 100 else "late", i) for i in range(120)]
    assert rows(table.rows(), "k", "v", "n") == want
    with pytest.raises(ValueError, match="the table has key"):
        merge(numbered(spark, 0, 1).drop("n"), target)
    with pytest.raises(ValueError, match="own"):
        merge(numbered(spark, 0, 1).withColumn("key_bucket", F.lit(1)), path("keyed"))


def test_empty_tables_and_null_keys(spark, path):
    target = path("keyed")
    empty = numbered(spark, 0, 0)
    assert merge(empty, target) == 0
    assert open_keyed(spark, target).rows().count() == 0
    nulls = spark.createDataFrame([(None, "a", 1), (None, "a", 1), ("", "b", 2)], "k string, v string, n long")
    assert merge(nulls, target) == 3
    assert merge(nulls, target) == 2  # null keys are never known
    table = open_keyed(spark, target)
    assert table.rows().where("k IS NULL").count() == 4 and table.rows().where("k = ''").count() == 1
    assert table.holding(empty.select("k")).count() == 0


@pytest.mark.parametrize("count", [1, 10, 11, 40])
def test_lookups_read_only_files_that_can_hold_a_key(spark, path, count):
    target = path("keyed")
    for start in (0, 1000, 2000):
        merge(numbered(spark, start, start + 1000), target, buckets=32)
    table = open_keyed(spark, target)
    keys = spark.range(1000, 1000 + count).select(F.format_string("%06d", "id").alias("k"))
    found = table.holding(keys)
    assert rows(found.join(keys, "k"), "n") == [(i,) for i in range(1000, 1000 + count)]
    listed = rows(table.files(), "key_bucket", "file", "first", "last")
    wanted = {(r["k"], r["b"]) for r in keys.withColumn("b", bucket_of("k", 32)).collect()}
    can = {file for bucket, file, first, last in listed if any(b == bucket and first <= k <= last for k, b in wanted)}
    assert len(can) < len(listed) / 3 + 1
    assert {f.rsplit("/", 1)[1] for f in found.inputFiles()} == {f.rsplit("/", 1)[1] for f in can}
    assert sum(r["n"] for r in table.files().collect()) == 3000


class Killed(Exception):
    pass


def test_a_writer_killed_before_its_commit_leaves_nothing(spark, path):
    target = path("keyed")
    merge(numbered(spark, 0, 10), target, batch="one")

    def die():
        raise Killed

    with pytest.raises(Killed):
        merge(numbered(spark, 5, 20), target, batch="two", before_commit=die)
    assert open_keyed(spark, target).rows().count() == 10
    assert merge(numbered(spark, 5, 20), target, batch="two") == 10  # the replay
    assert merge(numbered(spark, 5, 30), target, batch="two") == 0  # killed after its commit: the log knows it
    assert rows(open_keyed(spark, target).rows(), "n") == [(i,) for i in range(20)]


def test_the_second_of_two_writers_looks_again(spark, path):
    target = path("keyed")
    merge(numbered(spark, 0, 10), target)
    once = []

    def other():
        if not once:
            once.append(merge(numbered(spark, 5, 30, "other"), target))

    assert merge(numbered(spark, 0, 40, "mine"), target, before_commit=other) == 10
    assert once == [20]
    stored = rows(open_keyed(spark, target).rows(), "n", "v")
    assert stored == [(i, "v" if i < 10 else "other" if i < 30 else "mine") for i in range(40)]


def test_many_writers_at_once_add_each_key_once(spark, path):
    target = path("keyed")
    added = []
    run = lambda i: added.append(merge(numbered(spark, i * 10, i * 10 + 30, str(i)), target))
    threads = [threading.Thread(target=run, args=(i,)) for i in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sum(added) == 60 and len(added) == 4
    assert rows(open_keyed(spark, target).rows(), "n") == [(i,) for i in range(60)]


def test_rewrite_and_replace(spark, path):
    target = path("keyed")
    for start in range(0, 50, 10):
        merge(numbered(spark, start, start + 10), target, batch=str(start))
    before = open_keyed(spark, target)
    assert rewrite_keyed(spark, target, buckets=2) == 50
    table = open_keyed(spark, target)
    assert (table.buckets, len(table.commits), table.origin) == (2, 1, 0)
    assert rows(table.rows()) == rows(before.rows())  # the earlier version can still be read
    assert merge(numbered(spark, 0, 50), target, batch="0") == 0
    assert merge(numbered(spark, 45, 55), target) == 5
    assert merge(numbered(spark, 0, 3, "new"), target, replace=True, buckets=4) == 3
    assert rows(open_keyed(spark, target).rows(), "v", "n") == [("new", 0), ("new", 1), ("new", 2)]
    # Replaced between lookup and commit: the rows that were known before are new now.
    once = []

    def other():
        if not once:
            once.append(merge(numbered(spark, 2, 4, "other"), target, replace=True))

    assert merge(numbered(spark, 0, 5, "mine"), target, before_commit=other) == 3
    assert rows(open_keyed(spark, target).rows(), "n", "v") == [
        (0, "mine"), (1, "mine"), (2, "other"), (3, "other"), (4, "mine")
    ]
    # The same where the caller has looked the rows up itself: it must do so again.
    seen = open_keyed(spark, target)
    merge(numbered(spark, 0, 1), target, replace=True)
    with pytest.raises(RuntimeError, match="replaced"):
        merge(numbered(spark, 7, 8), target, known=seen)


def records(spark, start, stop):
    return spark.range(start, stop).select(
        F.col("id").cast("string").alias("kunnr"),
        F.concat(F.lit("name "), "id").alias("name1"),
        F.lit("town").alias("ort01"),
        F.lit("land").alias("land1"),
        F.col("id").alias("source_row"),
    )


def test_ingest_in_buckets_equals_plain_ingest(spark, path):
    plain, target, asked = path("corpus"), path("corpus"), spark.sparkContext.accumulator(0)

    def model(texts):
        asked.add(len(texts))
        return HashingEmbedder(16)(texts)

    for start, stop in ((0, 60), (40, 90)):
        ingest(records(spark, start, stop), plain, HashingEmbedder(16), order=["source_row"])
        ingest(records(spark, start, stop), target, model, order=["source_row"], buckets=4, batch=str(start), dim=16)
    assert rows(read_corpus(spark, target)) == rows(read_corpus(spark, plain))
    assert asked.value == 90  # known records never reach the model
    assert ingest(records(spark, 0, 500), target, model, order=["source_row"], batch="0") == 0 and asked.value == 90
    assert rows(find_existing(records(spark, 80, 100), open_keyed(spark, target))) == sorted((str(i),) for i in range(80, 90))
    late = read_corpus(spark, plain).limit(1).withColumn("kunnr", F.lit("late"))
    assert merge_insert(late, target) == 1 and merge_insert(late, target) == 0
    write_corpus(late, target, "append")
    assert read_corpus(spark, target).count() == 91
    assert ingest(records(spark, 0, 5), target, model, order=["source_row"], overwrite=True) == 5
    assert read_corpus(spark, target).count() == 5
    with pytest.raises(ValueError, match="not in buckets"):
        ingest(records(spark, 0, 5), plain, model, order=["source_row"], buckets=4)


def test_stream_in_buckets_knows_its_batches(spark, path):
    source, target, progress = path("src"), path("corpus"), path("progress")
    records(spark, 0, 30).coalesce(1).write.parquet(source)
    schema = records(spark, 0, 1).schema

    def run(checkpoint):
        arriving = spark.readStream.schema(schema).parquet(source)
        stream_ingest(arriving, target, HashingEmbedder(16), checkpoint, order=["source_row"], buckets=4).awaitTermination()

    run(progress)
    records(spark, 20, 50).coalesce(1).write.mode("append").parquet(source)
    run(progress)
    table = open_keyed(spark, target)
    assert table.batches == {f"{progress}#0", f"{progress}#1"}
    run(path("progress"))  # progress lost: everything comes again
    assert rows(read_corpus(spark, target), "kunnr") == sorted((str(i),) for i in range(50))
    assert path_exists(spark, shared_dir(spark))
