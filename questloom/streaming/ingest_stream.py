"""Ingest as a stream: every micro-batch is merged into the corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from questloom.operators.ingest import ingest
from questloom.sources.corpus import create_corpus
from questloom.sources.keyed import is_keyed


def stream_ingest(
    records: DataFrame,
    path: str,
    embedder: Callable,
    checkpoint: str,
    *,
    order: list[str],
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Merge a stream of records into the corpus at ``path``.

    The corpus itself is the state: what it holds is not inserted again, so a
    replayed micro-batch adds nothing and no dedup state grows with the stream.
    A corpus in buckets (made by ``buckets=`` in ``options``, or there already) is read only where the keys
    of the micro-batch can be, and knows its micro-batches by name, so that a replayed one costs a look into the log.
    """
    keyed = bool(options.get("buckets")) or is_keyed(records.sparkSession, path)
    if not keyed:
        create_corpus(records.sparkSession, path)

    def merge(batch: DataFrame, number: int) -> None:
        name = {"batch": f"{checkpoint}#{number}"} if keyed else {}
        ingest(batch, path, embedder, order=order, **name, **options)

    return (
        records.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
