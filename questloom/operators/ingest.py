"""Incremental ingest: defaults, first-wins dedup, rendering, embedding, insert-only merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from questloom.functions.vectors import normalize_rows, require_vector
from questloom.operators.ann import add_to_index, build_vector_index, read_index_keys
from questloom.session import stage
from questloom.sources.corpus import read_corpus, write_corpus
from questloom.sources.keyed import BUCKETS, KeyedTable, arrange, is_keyed, merge_keyed, open_keyed

# The record columns, the default, the sentence, the batch bounds.
RECORD_COLUMNS = ["kunnr", "name1", "ort01", "land1"]
UNKNOWN = "Unknown"
SENTENCE = "Customer %s is named %s and is located in %s, %s."
BATCH_SIZE = 256
MAX_BATCH_SIZE = 1024

Embedder = Callable[[list[str]], "np.ndarray"]


def default_unknown(records: DataFrame) -> DataFrame:
    """Replace each null of the record columns by ``Unknown``."""
    return records.fillna(UNKNOWN, subset=RECORD_COLUMNS)


def render_sentence(records: DataFrame, template: str = SENTENCE) -> DataFrame:
    """Add ``sentence``: one line of prose per record."""
    return records.withColumn("sentence", F.format_string(template, *RECORD_COLUMNS))


def dedup_first(records: DataFrame, order: list[str], key: str = "kunnr") -> DataFrame:
    """The first row of each key by ``order``.

    An aggregate, not a window: every task first reduces its own rows, so a
    key that holds a third of the table sends one row per task.
    """
    rest = [c for c in records.columns if c != key and c not in order]
    first = F.min(F.struct(*order, *rest)) if _orderable(records, rest) else F.min_by(
        F.struct(*order, *rest), F.struct(*order)
    )
    columns = [key] + [F.col(f"first.{c}").alias(c) for c in [*order, *rest]]
    return records.groupBy(key).agg(first.alias("first")).select(*columns).select(records.columns)


def _orderable(records: DataFrame, columns: list[str]) -> bool:
    kinds = dict(records.dtypes)
    return not any(kinds[c].startswith(("map", "variant")) for c in columns)


def find_existing(keys: DataFrame, corpus: DataFrame | KeyedTable, key: str = "kunnr") -> DataFrame:
    """The distinct keys that the corpus already holds.  Null keys are not looked up.

    Reads the key column of the corpus only, and of a corpus in buckets only the files that can hold one of the keys.  Written as a semi join from the
    corpus side so that a small batch of keys is broadcast to the corpus scan
    (decided by its size at run time) and the corpus is not shuffled for it.
    """
    wanted = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    if isinstance(corpus, KeyedTable):
        wanted = stage(wanted, "wanted-keys")
        corpus = corpus.holding(wanted)
    return corpus.select(key).join(wanted, key, "left_semi").distinct()


def new_records(records: DataFrame, corpus: DataFrame | KeyedTable | None, key: str = "kunnr") -> DataFrame:
    """The records whose key the corpus does not hold."""
    if corpus is None:
        return records
    return records.join(find_existing(records, corpus, key), key, "left_anti")


def check_batch_size(size: int) -> int:
    if not 1 <= size <= MAX_BATCH_SIZE:
        raise ValueError(f"batch size must be between 1 and {MAX_BATCH_SIZE}, not {size}")
    return size


def embed(
    df: DataFrame,
    embedder: Callable[[], Embedder] | Embedder,
    text_col: str = "sentence",
    batch_size: int = BATCH_SIZE,
    per_task: bool = False,
    key_col: str | None = None,
) -> DataFrame:
    """Add ``vector``: the unit-length embedding of ``text_col``.

    The embedder must be a pure function of each text.  It sees at most
    ``batch_size`` texts per call.  With ``per_task`` it is a factory, called
    once per task, e.g. to load a model.  ``key_col`` shares the rows out by that
    column to as many tasks as there are shuffle partitions, whatever their bytes;
    without it they stay in the tasks they are in.
    """
    check_batch_size(batch_size)
    columns = df.columns
    if key_col:
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = embedder() if per_task else embedder
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                texts = part.column(text_col).to_pylist()
                raw = np.asarray(model(texts), dtype=np.float32)
                if raw.ndim != 2 or len(raw) != len(texts):
                    raise ValueError(f"embedder returned shape {raw.shape} for {len(texts)} texts")
                unit = normalize_rows(raw)
                offsets = pa.array(np.arange(len(unit) + 1) * unit.shape[1], pa.int32())
                vectors = pa.ListArray.from_arrays(offsets, pa.array(unit.reshape(-1), pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], names=[*columns, "vector"])

    fields = ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)
    return df.mapInArrow(run, f"{fields}, vector array<float>")


def corpus_columns(records: DataFrame, vector: Column | None = None) -> DataFrame:
    """Rename record columns to those of the corpus; the country lives on in the sentence."""
    columns = [
        F.col("kunnr"),
        F.col("name1").alias("name"),
        F.col("ort01").alias("city"),
        F.col("sentence"),
    ]
    return records.select(*columns, vector if vector is not None else F.col("vector"))


def merge_insert(new: DataFrame, path: str, key: str = "kunnr") -> int:
    """Append the rows whose key the table does not hold; never update.  Returns how many."""
    if is_keyed(new.sparkSession, path):
        return merge_keyed(new, path, key=key)
    return write_counted(new_records(new, read_corpus(new.sparkSession, path), key), path)


def write_counted(rows: DataFrame, path: str) -> int:
    """Append ``rows`` and count them in the same pass."""
    seen = Observation()
    write_corpus(rows.observe(seen, F.count(F.lit(1)).alias("n")), path, "append")
    return seen.get["n"]


def prepare_records(
    records: DataFrame, corpus: DataFrame | KeyedTable | None, order: list[str], buckets: int | None = None
) -> DataFrame:
    """Records that are new, unique and rendered, in key order (in that of ``buckets``, if given), ready to embed.

    The known ones leave before the model sees anything.  The range partition
    on the key comes before embedding as well: it shares the costly stage out to as
    many tasks as there are shuffle partitions, and leaves each file with a narrow
    key range, so lookups by key skip files.
    """
    # Stored, as the lookup, the anti-join and the range sampling each read it.
    unique = stage(dedup_first(default_unknown(records), order), "unique-records")
    fresh = new_records(unique, corpus)
    if buckets:
        return arrange(render_sentence(fresh), buckets, "kunnr")
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return render_sentence(fresh).repartitionByRange(tasks, "kunnr").sortWithinPartitions("kunnr")


def ingest(
    records: DataFrame,
    path: str,
    embedder: Callable,
    *,
    order: list[str],
    overwrite: bool = False,
    batch_size: int = BATCH_SIZE,
    dim: int | None = None,
    per_task: bool = False,
    index_path: str | None = None,
    buckets: int | None = None,
    batch: str | None = None,
) -> int:
    """Add the new records to the corpus at ``path``; returns how many were inserted.

    With ``index_path`` the vector index there takes up the same records; it is built from the corpus if there is none.
    ``buckets`` makes a new or replaced corpus one in hash buckets of its key with a log of commits; a corpus that is one stays one.
    There, ``batch`` names the records: a name that was committed before adds nothing.
    """
    check_batch_size(batch_size)
    spark = records.sparkSession
    if is_keyed(spark, path) or (buckets and (overwrite or read_corpus(spark, path) is None)):
        return _ingest_keyed(records, path, embedder, order, overwrite, batch_size, dim, per_task, index_path, buckets, batch)
    if buckets or batch:
        raise ValueError(f"the corpus at {path} is not in buckets")
    corpus = None if overwrite else read_corpus(spark, path)
    ready = prepare_records(records, corpus, order)
    embedded = embed(ready, embedder, batch_size=batch_size, per_task=per_task)
    vector = require_vector(F.col("vector"), dim).alias("vector") if dim else None
    rows = corpus_columns(embedded, vector)
    seen = Observation()
    write_corpus(
        rows.observe(seen, F.count(F.lit(1)).alias("n")), path, "overwrite" if overwrite else "append"
    )
    if index_path:
        update_index(spark, path, index_path, rebuild=overwrite)
    return seen.get["n"]


def _ingest_keyed(records, path, embedder, order, overwrite, batch_size, dim, per_task, index_path, buckets, batch) -> int:
    """``ingest`` into a corpus in buckets: the lookup reads the files that the records' keys can be in."""
    spark = records.sparkSession
    table = open_keyed(spark, path)
    if table and batch in table.batches:
        return 0
    layout = table.buckets if table and not (overwrite and buckets) else buckets or BUCKETS
    ready = prepare_records(records, None if overwrite else table, order, layout)
    vector = require_vector(F.col("vector"), dim).alias("vector") if dim else None
    rows = corpus_columns(embed(ready, embedder, batch_size=batch_size, per_task=per_task), vector)
    # Stored, as the merge may look the rows up in later commits and must not ask the model again.
    rows = stage(rows, "embedded")
    count = merge_keyed(rows, path, batch=batch, buckets=layout, replace=overwrite, known=table)
    if index_path:
        update_index(spark, path, index_path, rebuild=overwrite)
    return count


def update_index(spark: SparkSession, path: str, index_path: str, rebuild: bool = False) -> None:
    """Make the index hold what the corpus holds: the records whose keys it lacks, whoever wrote them."""
    stored = read_corpus(spark, path)
    keys = None if rebuild else read_index_keys(spark, index_path)
    if keys is not None:
        missing = stage(stored.join(keys, "kunnr", "left_anti"), "unindexed")
        if not missing.isEmpty():
            add_to_index(missing, index_path)
    elif not stored.isEmpty():
        build_vector_index(stored, index_path, overwrite=rebuild)
