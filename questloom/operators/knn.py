"""Exact nearest neighbours for a table of questions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questloom.functions.vectors import vector_verdict
from questloom.operators.best import Best
from questloom.operators.blocks import Batches, scan_against

# Dot products are compared at this many bits below |q|·|v|, so that copies of a
# vector tie (and are then ordered by id) whichever block of a matrix they sit in.
TIE_BITS = 46
# Scores held at once by a task while it multiplies a batch with the questions.
TILE_CELLS = 2_000_000
# Pairs multiplied again at once.
PAIRS = 20_000


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_dimension(column: pa.Array) -> dict[int, np.ndarray]:
    """Row numbers per vector length; null vectors belong to none."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return {int(d): np.flatnonzero(sizes == d) for d in np.unique(sizes) if d > 0}


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _distinct(vectors: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The distinct vectors of a batch, and per distinct vector its first ``k`` ids.

    Copies score alike, so only the k smallest ids of a vector can be among any
    top k.  Returns the vectors, the start of each one's ids (and the end), and the ids.
    """
    block = np.ascontiguousarray(vectors)
    raw = pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(block.shape[1] * block.itemsize), len(block), [None, pa.py_buffer(block)]
    )
    code = raw.dictionary_encode().indices.to_numpy()
    order = pa.table({"code": code, "id": ids, "at": np.arange(len(code))}).sort_by(
        [("code", "ascending"), ("id", "ascending")]
    )
    code = order["code"].to_numpy()
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    place = np.arange(len(code)) - np.repeat(starts, np.diff(np.r_[starts, len(code)]))
    kept = place < k
    edges = np.r_[np.flatnonzero(place[kept] == 0), kept.sum()]
    return block[order["at"].to_numpy()[starts]], edges, order["id"].combine_chunks().filter(pa.array(kept))


def _exact(
    questions: np.ndarray, vectors: np.ndarray, at: np.ndarray, which: np.ndarray, asked: np.ndarray, stored: np.ndarray
) -> np.ndarray:
    """Inner products of the pairs (at, which), a bounded number at a time, to ``TIE_BITS`` of their lengths ``asked`` and ``stored``."""
    parts = []
    for lo in range(0, len(at), PAIRS):
        left, right = at[lo : lo + PAIRS], which[lo : lo + PAIRS]
        product = np.einsum("ij,ij->i", questions[left], vectors[right])
        _, exponent = np.frexp(asked[left] * stored[right])
        step = np.ldexp(1.0, exponent - TIE_BITS)
        fits = np.isfinite(product) & (step > 0)
        product[fits] = np.round(product[fits] / step[fits]) * step[fits]
        parts.append(product)
    return np.concatenate(parts) + 0.0


def _score(
    best: Best, rows: np.ndarray, questions: np.ndarray, vectors: np.ndarray, ids: pa.Array, lengths: np.ndarray | None = None
) -> None:
    """Add to ``best`` every (question, id) pair that can still be among its top k; ``lengths`` are those of the questions.

    All pairs are multiplied in single precision, which is several times
    faster; what could pass within the error bound of that is multiplied again
    in double precision, and only those products are used.
    """
    finite = np.isfinite(vectors).all(axis=1)
    if not finite.all():
        vectors, ids = vectors[finite], ids.filter(pa.array(finite))
    if len(vectors) == 0:
        return
    vectors, edges, ids = _distinct(vectors, ids, best.k)
    k, count, dim = best.k, len(vectors), vectors.shape[1]
    lengths = np.linalg.norm(questions, axis=1) if lengths is None else lengths
    stored = np.linalg.norm(vectors, axis=1)
    reach = lengths * stored.max()
    single = bool((reach < 1e30).all())
    narrow = vectors.astype(np.float32).T if single else vectors.T
    # Rounding of dim products and sums, and of the inputs themselves.
    error = (dim + 4) * (2.0**-24 if single else 2.0**-53) * 1.1 * reach + 2.0 ** (1 - TIE_BITS) * reach
    step = max(1, TILE_CELLS // count)
    for start in range(0, len(rows), step):
        part, own, slack, asked = (x[start : start + step] for x in (rows, questions, error, lengths))
        scores = (own.astype(np.float32) if single else own) @ narrow
        floor = best.floor[part]
        if count > k and np.isneginf(floor).any():
            kth = np.partition(scores, count - k, axis=1)[:, count - k]
            floor = np.fmax(floor, kth - slack)
        need = floor - slack
        open_rows = np.flatnonzero(scores.max(axis=1) >= need)
        if len(open_rows) == 0:
            continue
        cell = np.flatnonzero(scores[open_rows] >= need[open_rows, None])
        # A pair is a row per id of its vector, up to k, so they are added a bounded number at a time.
        for low in range(0, len(cell), PAIRS):
            pairs = cell[low : low + PAIRS]
            at, which = open_rows[pairs // count], pairs % count
            value = _exact(own, vectors, at, which, asked, stored)
            copies = (edges[1:] - edges[:-1])[which]
            first = np.repeat(edges[:-1][which] - np.r_[0, np.cumsum(copies)[:-1]], copies)
            best.add(
                np.repeat(part[at], copies),
                np.repeat(value, copies),
                ids.take(pa.array(first + np.arange(copies.sum()))),
            )


def fold_copies(k: int) -> Callable[[pa.Table], pa.Table]:
    """Of rows (id, vector[, cell]) with equal vectors in a cell, the ``k`` smallest ids; rows without a vector go."""

    def fold(rows: pa.Table) -> pa.Table:
        vectors, parts = _whole(rows["vector"]), []
        cells = rows["cell"].to_numpy() if "cell" in rows.column_names else np.zeros(len(rows), dtype=np.int64)
        for dim, at in _by_dimension(vectors).items():
            values = vectors.take(pa.array(at)).flatten()
            block = values.to_numpy(zero_copy_only=False)
            if values.null_count:  # equal as they are, or not folded
                parts.append(at)
                continue
            raw = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(dim * block.itemsize), len(at), [None, pa.py_buffer(np.ascontiguousarray(block))]
            )
            code = raw.dictionary_encode().indices.to_numpy()
            table = pa.table({"cell": cells[at], "code": code, "id": rows["id"].take(pa.array(at)), "at": at})
            order = table.sort_by([("cell", "ascending"), ("code", "ascending"), ("id", "ascending")])
            cell, code = order["cell"].to_numpy(), order["code"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (cell[1:] != cell[:-1])])
            place = np.arange(len(code)) - np.repeat(starts, np.diff(np.r_[starts, len(code)]))
            parts.append(order["at"].to_numpy()[place < k])
        return rows.take(pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)))

    return fold


class Cells:
    """Centroids, and how many of the nearest ones a question probes."""

    def __init__(self, numbers: np.ndarray, centroids: np.ndarray, nprobe: int):
        order = np.argsort(numbers)
        self.numbers, self.centroids, self.nprobe = numbers[order], centroids[order], nprobe

    def _scores(self, vectors: np.ndarray) -> np.ndarray:
        """By Euclidean distance, written as an inner product with one extra element per vector: q.c - |c|^2 / 2 orders like -|q - c|."""
        half = np.square(self.centroids).sum(axis=1) / 2
        length = np.sqrt(np.square(self.centroids).sum(axis=1) + half**2)
        with np.errstate(all="ignore"):
            score = vectors @ self.centroids.T - half
            _, exponent = np.frexp(np.sqrt(np.square(vectors).sum(axis=1) + 1)[:, None] * length)
            step = np.ldexp(1.0, exponent - TIE_BITS)
            return np.round(score / step) * step

    def probed(self, vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How often each vector probes each cell: the nearest ones once, ties by number.

        Vectors with the same of ``rows`` are of one question.  They all probe the nearest of their cells, counted together.
        """
        count, width = np.bincount(rows)[rows] if len(rows) else rows, len(self.numbers)
        out = np.zeros((len(vectors), width), dtype=np.min_scalar_type(int(count.max(initial=1))))
        finite = np.isfinite(vectors).all(axis=1)
        alone, step = np.flatnonzero(finite & (count == 1)), max(1, TILE_CELLS // width)
        for start in range(0, len(alone), step):
            part = alone[start : start + step]
            if self.nprobe >= width:
                out[part] = 1
                continue
            near = np.argsort(-self._scores(vectors[part]), axis=1, kind="stable")[:, : self.nprobe]
            out[np.repeat(part, self.nprobe), near.reshape(-1)] = 1
        several = np.flatnonzero(count > 1)
        several = several[np.argsort(rows[several], kind="stable")]
        edges = np.flatnonzero(np.r_[True, np.diff(rows[several]) != 0])
        for at in np.split(several, edges[1:]) if len(several) else []:
            score = self._scores(vectors[at[finite[at]]])
            cell = np.tile(np.arange(width), len(score))
            near = np.lexsort((cell, -score.reshape(-1)))[: self.nprobe]
            out[at] = np.bincount(cell[near], minlength=width)
        return out


def nearest_kernel(k: int, cells: Cells | None = None):
    """Questions (question_id, vector) against batches (id, vector[, cell]).

    With ``cells`` a vector only meets the questions that probe its cell.
    """

    def prepare(small: pa.Table):
        question_ids = _whole(small["question_id"])
        codes = question_ids.dictionary_encode()
        row_of = codes.indices.to_numpy()
        vectors = _whole(small["vector"])
        groups, probed = {}, None
        for dim, at in _by_dimension(vectors).items():
            block = _matrix(vectors.take(pa.array(at)), dim)
            with np.errstate(all="ignore"):
                groups[dim] = (row_of[at], block, np.linalg.norm(block, axis=1))
            if cells is not None and dim == cells.centroids.shape[1]:
                probed = cells.probed(block, row_of[at])

        def run(batches: Batches) -> Batches:
            best = Best(len(codes.dictionary), k)
            id_type = None
            for batch in batches:
                id_type = batch.schema.field("id").type
                column = batch.column("vector")
                for dim, at in _by_dimension(column).items():
                    vectors = _matrix(column.take(pa.array(at)), dim)
                    ids = batch.column("id").take(pa.array(at))
                    if dim not in groups:
                        continue
                    if cells is None:
                        rows, block, lengths = groups[dim]
                        _score(best, rows, block, vectors, ids, lengths)
                        continue
                    if probed is None or dim != cells.centroids.shape[1]:
                        continue
                    rows, block, lengths = groups[dim]
                    own = batch.column("cell").to_numpy(zero_copy_only=False)[at]
                    for cell in np.intersect1d(own, cells.numbers):
                        times = probed[:, np.searchsorted(cells.numbers, cell)]
                        asking = np.repeat(np.arange(len(times)), times)
                        if len(asking):
                            inside = np.flatnonzero(own == cell)
                            _score(best, rows[asking], block[asking], vectors[inside], ids.take(pa.array(inside)), lengths[asking])
            found = best.prune()
            if found is None:
                found = pa.table(
                    {
                        "row": pa.array([], pa.int32()),
                        "score": pa.array([], pa.float64()),
                        "id": pa.array([], id_type or pa.string()),
                    }
                )
            out = pa.table(
                {
                    "question_id": codes.dictionary.take(found["row"].combine_chunks()),
                    "id": found["id"],
                    "score": found["score"],
                }
            )
            yield from out.combine_chunks().to_batches() or [
                pa.RecordBatch.from_arrays([c.combine_chunks() for c in out.columns], schema=out.schema)
            ]

        return run

    return prepare


def top_ranked(hits: DataFrame, k: int, group: str = "question_id") -> DataFrame:
    """The reduce side: ``rank`` 1..k per group by score desc, id asc.

    Each task sends at most k rows per group; the row_number <= k filter is a
    window group limit, so what is left is cut again before it is sorted.
    """
    order = Window.partitionBy(group).orderBy(F.col("score").desc(), F.col("id").asc())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# Bytes of one result that a task keeps for a question, and of the copies it makes to order them.
RESULT_BYTES = 24


def vector_bytes(vector: Column, key: Column | None = None) -> Column:
    """Bytes that a vector, and the key it goes with, take when shipped."""
    width = F.lit(0) if key is None else F.coalesce(F.octet_length(key.cast("string")), F.lit(0))
    return F.lit(32) + width + F.coalesce(F.size(vector), F.lit(0)) * 8


def unusable_vectors(rows: DataFrame, dim: int, id_col: str = "kunnr", vector_col: str = "vector") -> DataFrame:
    """(id, verdict) of the rows that no search with vectors of ``dim`` elements can return."""
    verdict = vector_verdict(F.col(vector_col), dim)
    return rows.select(F.col(id_col).alias("id"), verdict.alias("verdict")).filter(F.col("verdict") != "OK")


def knn(
    questions: DataFrame,
    corpus: DataFrame,
    k: int = 20,
    *,
    id_col: str = "kunnr",
    vector_col: str = "vector",
    limit_bytes: int | None = None,
) -> DataFrame:
    """The ``k`` nearest corpus rows per question by inner product.

    ``questions`` has ``question_id`` and ``vector``; the result has
    ``question_id, id, score, rank``.  On unit vectors the order equals that of
    the Euclidean distance.  Vectors of another length, or with an element that
    is not finite, never match; ``unusable_vectors`` lists them.
    """
    small = questions.select("question_id", "vector")
    large = corpus.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    types = dict(small.dtypes) | dict(large.dtypes)
    hits = scan_against(
        large,
        small,
        nearest_kernel(k),
        f"question_id {types['question_id']}, id {types['id']}, score double",
        row_bytes=vector_bytes(F.col("vector"), F.col("question_id")) + F.lit(k * RESULT_BYTES),
        large_bytes=vector_bytes(F.col("vector")),
        small_key="question_id",
        large_key="id",
        limit_bytes=limit_bytes,
        fold=fold_copies(k),
    )
    return top_ranked(hits, k)
