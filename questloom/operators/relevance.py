"""The best records among those that a filter finds: by filters hit, then by closeness, then by key.

What a filter finds can be a large part of the corpus, so no limit is set before the order is known and no pair of a
question and a hit is made a row.  The records that any filter finds are gathered once, with their vector and all filters
that found them; a question meets only the records of its own filters, block by block, and a task keeps the best of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from questloom.operators.best import Best
from questloom.operators.blocks import Batches, scan_against
from questloom.operators.knn import PAIRS, RESULT_BYTES, TILE_CELLS, _whole, vector_bytes
from questloom.session import stage

#: Decimals of a closeness that count, so that ties do not depend on partitioning.
DECIMALS = 11
#: The closeness of a record without a usable vector: below that of any other.
MISSING = -0.495


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows, zeros where one is missing or of another length, and which are there."""
    there = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim
    out = np.zeros((len(column), dim))
    if there.any():
        out[there] = column.filter(pa.array(there)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out, there


def _entries(column: pa.Array, codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The strings of lists that are among ``codes``, as their places there, and where each row's begin (and the end)."""
    found = pc.index_in(column.flatten(), value_set=codes).fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    kept = found >= 0
    return found[kept], np.searchsorted(rows[kept], np.arange(len(column) + 1))


def _starts(sorted_codes: np.ndarray) -> np.ndarray:
    """Where each run of equal codes begins, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, sorted_codes[1:] != sorted_codes[:-1]]), len(sorted_codes)]


def _closeness(product: np.ndarray) -> np.ndarray:
    """An inner product (over the asker's length) as less than half more or less than nothing; overwrites it."""
    below = np.abs(product)
    below += 1
    product /= below
    product *= 0.49
    return product


class _Askers:
    """The askers in order of their set, and of each the codes of its other sets."""

    def __init__(self, small: pa.Table, dim: int):
        keys = _whole(small["set_key"]).dictionary_encode()
        code = keys.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        self.labels = _whole(small["row"]).take(pa.array(order))
        self.keys = keys.dictionary
        self.edges = np.searchsorted(code[order], np.arange(len(self.keys) + 1))
        self.vectors, _ = _matrix(_whole(small["vector"]).take(pa.array(order)), dim)
        self.length = np.maximum(np.linalg.norm(self.vectors, axis=1), 1e-300)
        with np.errstate(all="ignore"):
            units = self.vectors / self.length[:, None]
        self.units, self.narrow = units, units.astype(np.float32)
        others = _whole(small["others"]).take(pa.array(order))
        self.terms = others.flatten().unique()
        self.others, self.begin = _entries(others, self.terms)


class _Records:
    """The records of one set in a batch, those alike to a vector and the askers' other sets as one."""

    def __init__(self, k: int, ids: pa.Array, vectors: np.ndarray, there: np.ndarray, codes: np.ndarray, rows: np.ndarray):
        """``codes`` are the sets that found the ``rows`` and that askers have as others, in order of the rows."""
        rank = np.empty(len(ids), np.int64)
        rank[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
        raw = pa.FixedSizeBinaryArray.from_buffers(
            pa.binary(vectors.shape[1] * vectors.itemsize), len(vectors), [None, pa.py_buffer(np.ascontiguousarray(vectors))]
        )
        alike = raw.dictionary_encode().indices.to_numpy() * 2 + there
        # Which of those sets found a record; no sets are number 0.
        numbers: dict[tuple, int] = {(): 0}
        signs = np.zeros(len(ids), np.int64)
        edges = _starts(rows) if len(rows) else [0]
        for lo, hi in zip(edges[:-1], edges[1:]):
            signs[rows[lo]] = numbers.setdefault(tuple(sorted(set(codes[lo:hi].tolist()))), len(numbers))
        alike = alike * len(numbers) + signs
        order = np.lexsort((rank, alike))
        starts = _starts(alike[order])
        place = np.arange(len(order)) - np.repeat(starts[:-1], np.diff(starts))
        # Records alike have equal scores, so only the first k ids of them can be among any best k.
        self.ids = ids.take(pa.array(order[place < k]))
        self.copies = np.minimum(np.diff(starts), k)
        self.first = np.r_[0, np.cumsum(self.copies)[:-1]]
        at = order[starts[:-1]]
        self.vectors, self.missing = vectors[at], ~there[at]
        #: Which of these records a set found.
        self.columns: dict[int, list[int]] = {}
        names = list(numbers)
        for column in np.flatnonzero(signs[at]):
            for code in names[signs[at[column]]]:
                self.columns.setdefault(code, []).append(int(column))


def _rate(best: Best, askers: _Askers, low: int, high: int, records: _Records, most: int) -> None:
    """Add to ``best`` what can be among the best of the askers from ``low`` to ``high``, tile by tile.

    Products are screened in single precision, if they fit, and those that can pass are taken again in double precision.
    """
    k, count, dim = best.k, len(records.missing), records.vectors.shape[1]
    reach = np.linalg.norm(records.vectors, axis=1).max()
    single = bool(reach < 1e30)
    stored = (records.vectors.astype(np.float32) if single else records.vectors).T
    units = askers.narrow if single else askers.units
    # Rounding of the products and of the scores, and to DECIMALS.
    slack = 0.49 * ((dim + 4) * 2.0 ** (-24 if single else -53) * 1.1 * reach + 10.0**-DECIMALS / askers.length[low:high])
    slack += (most + 2) * 2.0 ** (-21 if single else -50)
    step = max(1, TILE_CELLS // count)
    for start in range(low, high, step):
        end = min(high, start + step)
        scores = _closeness(units[start:end] @ stored)
        scores[:, records.missing] = MISSING
        if records.columns:
            line = np.repeat(np.arange(end - start), np.diff(askers.begin[start : end + 1]))
            for row, code in zip(line, askers.others[askers.begin[start] : askers.begin[end]].tolist()):
                if code in records.columns:
                    scores[row, records.columns[code]] += 1
        floor, own = best.floor[start:end], slack[start - low : end - low]
        if count > k and np.isneginf(floor).any():
            kth = np.partition(scores, count - k, axis=1)[:, count - k]
            floor = np.fmax(floor, kth - own)
        need = (floor - own).astype(scores.dtype)
        cell = np.flatnonzero(scores >= need[:, None])
        for at in range(0, len(cell), PAIRS):
            part = cell[at : at + PAIRS]
            row, column = start + part // count, part % count
            # The other sets are whole numbers and the rest is less than half.
            others = np.rint(scores.reshape(-1)[part]).astype(np.float64)
            product = np.round(np.einsum("ij,ij->i", askers.vectors[row], records.vectors[column]), DECIMALS) / askers.length[row]
            value = np.where(records.missing[column], MISSING, _closeness(product)) + others
            copies = records.copies[column]
            first = np.repeat(records.first[column] - np.r_[0, np.cumsum(copies)[:-1]], copies)
            best.add(np.repeat(row, copies), np.repeat(value, copies), records.ids.take(pa.array(first + np.arange(copies.sum()))))


def relevance_kernel(k: int, dim: int):
    """Askers (row, set_key, vector, others) against batches (id, set_key, vector, found): the best ``k`` per asker.

    A record's score is the number of the asker's sets (its own and ``others``) among ``found``, and less than half more
    or less for the inner product over the length of the asker's vector; without a usable vector the product counts least.
    """

    def prepare(small: pa.Table):
        askers = _Askers(small, dim)
        most = int(np.diff(askers.begin).max(initial=0))

        def run(batches: Batches) -> Batches:
            best, id_type = Best(len(askers.labels), k), None
            for batch in batches:
                id_type = batch.schema.field("id").type
                own = pc.index_in(batch.column("set_key"), value_set=askers.keys).fill_null(-1).to_numpy(zero_copy_only=False)
                vectors, there = _matrix(batch.column("vector"), dim)
                usable = np.flatnonzero((own >= 0) & np.isfinite(vectors).all(axis=1))
                order = usable[np.argsort(own[usable], kind="stable")]
                if len(order) == 0:
                    continue
                own, vectors, there = own[order], vectors[order], there[order]
                ids = batch.column("id").take(pa.array(order))
                codes, begin = _entries(batch.column("found").take(pa.array(order)), askers.terms)
                edges = _starts(own)
                for lo, hi in zip(edges[:-1], edges[1:]):
                    low, high = askers.edges[own[lo]], askers.edges[own[lo] + 1]
                    wanted = askers.others[askers.begin[low] : askers.begin[high]]
                    rows = np.repeat(np.arange(hi - lo), np.diff(begin[lo : hi + 1]))
                    here = codes[begin[lo] : begin[hi]]
                    asked = np.isin(here, wanted)
                    group = _Records(k, ids.slice(lo, hi - lo), vectors[lo:hi], there[lo:hi], here[asked], rows[asked])
                    with np.errstate(all="ignore"):
                        _rate(best, askers, low, high, group, most)
            kept = best.prune()
            if kept is None:
                none = pa.array([], id_type or pa.string())
                yield pa.RecordBatch.from_arrays([askers.labels.slice(0, 0), none, pa.array([], pa.float64())], ["row", "id", "score"])
                return
            out = pa.table({"row": askers.labels.take(kept["row"].combine_chunks()), "id": kept["id"], "score": kept["score"]})
            yield from out.combine_chunks().to_batches()

        return run

    return prepare


def most_relevant(
    asked: DataFrame, hits: DataFrame, corpus: DataFrame, k: int, *, id_col: str = "kunnr", limit_bytes: int | None = None
) -> DataFrame:
    """(question_id, ordinal, id, position): for each set a question asks for, the best ``k`` records that it finds.

    ``asked``: question_id, ordinal (together unique), set_key, vector.  ``hits``: all (set_key, id).  ``corpus`` has the
    ids, once each, and ``vector``.  First come the records that most of the question's distinct sets find, then the larger inner product
    of the vectors, to ``DECIMALS`` decimals, then the smaller id.  A record whose vector is missing or has another length comes after others.
    """
    asked = stage(asked.select("question_id", "ordinal", "set_key", "vector"), "asked-sets")
    dim = asked.agg(F.max(F.size("vector"))).first()[0]
    if not dim or dim < 1:
        dim = 1
    sets = asked.groupBy("question_id").agg(F.collect_set("set_key").alias("all"))
    row = F.struct("question_id", "ordinal")
    askers = asked.join(sets, "question_id").select(
        F.to_json(row).alias("row"), "set_key", "vector", F.array_remove("all", F.col("set_key")).alias("others")
    )
    found = hits.groupBy("id").agg(F.collect_set("set_key").alias("found"))
    records = corpus.select(F.col(id_col).alias("id"), "vector").join(found, "id")
    records = stage(records.select("id", F.explode("found").alias("set_key"), "vector", "found"), "found-records")
    kept = scan_against(
        records,
        askers,
        relevance_kernel(k, dim),
        f"row string, id {dict(records.dtypes)['id']}, score double",
        row_bytes=vector_bytes(F.col("vector"), F.col("set_key"))
        + F.octet_length("row")
        + F.coalesce(F.octet_length(F.array_join("others", ",")), F.lit(0))
        + F.lit(k * RESULT_BYTES),
        large_bytes=vector_bytes(F.col("vector")) + F.octet_length(F.array_join("found", ",")),
        small_key="row",
        large_key="id",
        match="set_key",
        limit_bytes=limit_bytes,
    )
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc("id")))
    named = kept.withColumn("position", place).where(F.col("position") <= k)
    types = dict(asked.dtypes)
    named = named.withColumn("of", F.from_json("row", f"question_id {types['question_id']}, ordinal {types['ordinal']}"))
    return named.select("of.question_id", "of.ordinal", "id", "position")
