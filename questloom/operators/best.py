"""Keep the best rows per group inside one task: the map side of a top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def keep_best(rows: pa.Table, k: int) -> pa.Table:
    """The first ``k`` rows of each ``row`` value by score desc, id asc."""
    ordered = rows.sort_by([("row", "ascending"), ("score", "descending"), ("id", "ascending")])
    group = ordered["row"].to_numpy()
    if len(group) == 0:
        return ordered
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    place = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
    return ordered.filter(pa.array(place < k))


class Best:
    """Candidates of one task, pruned to the best ``k`` per row whenever enough wait.

    Memory is bounded by rows x k plus one round of waiting candidates, however
    many batches the task reads.  Between prunes a candidate must beat the k-th
    best of its row so far, by score or, at the same score, by id.
    """

    def __init__(self, rows: int, k: int):
        self.k = k
        self.floor = np.full(rows, -np.inf)
        self.floor_id: pa.Array | None = None
        self.kept: list[pa.Table] = []
        self.waiting = 0
        self.patience = max(rows * k, 200_000)

    def add(self, row: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        floor = self.floor[row]
        better = score > floor
        tied = np.flatnonzero(score == floor)
        if len(tied) and self.floor_id is not None:
            rivals = self.floor_id.take(pa.array(row[tied]))
            better[tied] = pc.less(ids.take(pa.array(tied)), rivals).to_numpy(zero_copy_only=False)
        if not better.all():
            row, score, ids = row[better], score[better], ids.filter(pa.array(better))
        if len(row) == 0:
            return
        self.kept.append(
            pa.table({"row": pa.array(row, pa.int32()), "score": pa.array(score, pa.float64()), "id": ids})
        )
        self.waiting += len(row)
        if self.waiting >= self.patience:
            self.prune()

    def prune(self) -> pa.Table | None:
        if not self.kept:
            return None
        best = keep_best(pa.concat_tables(self.kept).combine_chunks(), self.k)
        self.kept, self.waiting = [best], 0
        row, score = best["row"].to_numpy(), best["score"].to_numpy()
        counts = np.bincount(row, minlength=len(self.floor))
        full = counts >= self.k
        last = np.cumsum(counts) - 1
        self.floor[full] = score[last[full]]
        self.floor_id = best["id"].combine_chunks().take(pa.array(np.where(full, last, 0), mask=~full))
        return best
