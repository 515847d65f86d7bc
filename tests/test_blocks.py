"""What a task holds while it scans: bounded by the block, not by the batch times the questions."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from questloom.operators import blocks
from questloom.operators.knn import RESULT_BYTES, fold_copies, knn, nearest_kernel, vector_bytes
from questloom.operators.relevance import most_relevant, relevance_kernel
from tests.conftest import rows

RNG = np.random.default_rng(11)


def askers(n, dim, others):
    vectors = RNG.normal(size=(n, dim)).astype(np.float32)
    small = {"row": [f"a{i}" for i in range(n)], "set_key": ["oak"] * n, "vector": vectors.tolist(), "others": [others(i) for i in range(n)]}
    return vectors.astype(float), pa.table(small, pa.schema([("row", pa.string()), ("set_key", pa.string()), ("vector", pa.list_(pa.float32())), ("others", pa.list_(pa.string()))]))


def found(n, dim, sets, bare):
    vectors = RNG.normal(size=(n, dim)).astype(np.float32)
    columns = [pa.array([f"r{i:05}" for i in range(n)]), pa.array(["oak"] * n), pa.array([None if bare(i) else v.tolist() for i, v in enumerate(vectors)], pa.list_(pa.float32()))]
    return vectors.astype(float), pa.RecordBatch.from_arrays([*columns, pa.array([["oak", *sets(i)] for i in range(n)])], ["id", "set_key", "vector", "found"])


def test_relevance_in_bounded_memory():
    """6,000 askers of one set against 6,000 records: all products at once are 288 MB, and copies of them more."""
    _, small = askers(6000, 8, lambda i: [f"n{i}"])
    _, batch = found(6000, 8, lambda i: [f"n{i}"], lambda i: False)
    run = relevance_kernel(5, 8)(small)
    tracemalloc.start()
    out = pa.Table.from_batches(list(run(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 30_000 and peak < 150_000_000
    best = {r: i for r, i, s in zip(*(out[c].to_pylist() for c in ("row", "id", "score"))) if s > 0.5}
    assert best == {f"a{i}": f"r{i:05}" for i in range(6000)}


def test_relevance_equals_brute_force():
    """Other sets, missing and repeated vectors, over several batches."""
    k, dim = 4, 3
    asked, small = askers(70, dim, lambda i: [f"s{i % 3}", f"n{i}"][: i % 3])
    parts = [found(90, dim, lambda i: [f"s{i % 4}"] * (i % 2) + [f"n{i % 80}"], lambda i, b=b: (i + b) % 5 == 0) for b in range(3)]
    whole = [b.set_column(0, "id", pa.array([f"b{j}{x}" for x in b.column("id").to_pylist()])) for j, (_, b) in enumerate(parts)]
    out = pa.Table.from_batches(list(relevance_kernel(k, dim)(small)(iter(whole))))
    got = {}
    for row, key, score in sorted(zip(*(out[c].to_pylist() for c in ("row", "id", "score"))), key=lambda x: (x[0], -x[2], x[1])):
        got.setdefault(row, []).append(key)
    for i in range(70):
        mine, rated = set(small["others"][i].as_py()), []
        for batch in whole:
            for r in batch.to_pylist():
                near = None if r["vector"] is None else round(float(np.dot(asked[i], r["vector"])), 11)
                rated.append((-len(mine & set(r["found"])), near is None, -(near or 0), r["id"]))
        assert got[f"a{i}"] == [x[-1] for x in sorted(rated)[:k]]


def test_results_count_for_what_is_sent(spark, monkeypatch):
    """Many results a question take a task's memory as the questions do."""
    seen, measure = [], blocks.measure
    monkeypatch.setattr(blocks, "measure", lambda df, size: seen.append(measure(df, size)) or seen[-1])
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "question_id int, vector array<double>")
    knn(few, few.withColumnRenamed("question_id", "kunnr"), 40)
    assert seen[0][1] >= 50 * 40 * RESULT_BYTES


@pytest.mark.parametrize("limit", [1, 4000, None])
def test_small_sets_share_blocks(spark, limit):
    """Two hundred sets with one record each and a crowded one: the same results however they are cut."""
    n = 200
    asked = [(i, 0, f"n{i}", [float(i), 1.0]) for i in range(n)] + [(i, 1, "all", [float(-i), 1.0]) for i in range(0, n, 20)]
    asked = spark.createDataFrame(asked, "question_id int, ordinal int, set_key string, vector array<double>")
    hits = spark.createDataFrame([(f"n{i}", i) for i in range(n)] + [("all", i) for i in range(n)], "set_key string, id int")
    corpus = spark.createDataFrame([(i, [float(i % 50), 2.0]) for i in range(n)], "kunnr int, vector array<double>")
    got = rows(most_relevant(asked, hits, corpus, 2, limit_bytes=limit), "question_id", "ordinal", "position", "id")
    # Each question's own record is found by two of the sets of those that ask for both; then small products first.
    want = [(i, 0, 1, i) for i in range(n)]
    for i in range(0, n, 20):
        others = sorted((j for j in range(n) if j != i), key=lambda j: (i * (j % 50), j))
        want += [(i, 1, 1, i), (i, 1, 2, others[0])]
    assert got == sorted(want)


@pytest.mark.parametrize("limit", [40, 960])
def test_a_block_of_questions_keeps_its_results_to_the_end(spark, monkeypatch, limit):
    """The large side streams past a block of questions: with as many blocks as tasks, k rows a question come out, however large it is."""
    monkeypatch.setattr(blocks, "LARGE_BLOCK_BYTES", 2000)
    monkeypatch.setattr(blocks, "PACK_BYTES", 4000, raising=False)
    asked, stored = RNG.normal(size=(60, 4)).astype(np.float32), RNG.normal(size=(900, 4)).astype(np.float32)
    small = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "question_id int, vector array<float>")
    large = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(stored)], "id int, vector array<float>").repartition(5)
    hits = blocks.scan_against(
        large, small, nearest_kernel(3), "question_id int, id int, score double", row_bytes=vector_bytes(F.col("vector")),
        large_bytes=vector_bytes(F.col("vector")), small_key="question_id", large_key="id", limit_bytes=limit,
    )
    got = rows(hits, "question_id", "id")
    near = np.argsort(-(asked.astype(float) @ stored.astype(float).T), axis=1)[:, :3]
    assert got == sorted((i, int(j)) for i in range(60) for j in near[i])


def test_copies_fold_before_they_travel():
    """Of equal vectors in a cell the first ids stay, and all of what is different."""
    vectors = [[1.0, 2.0]] * 50 + [[3.0, 4.0]] * 2 + [None, [5.0]]
    table = pa.table({"id": list(range(54))[::-1], "vector": pa.array(vectors, pa.list_(pa.float32())), "cell": [0] * 40 + [1] * 14})
    assert sorted(fold_copies(3)(table)["id"].to_pylist()) == [0, 2, 3, 4, 5, 6, 14, 15, 16]
