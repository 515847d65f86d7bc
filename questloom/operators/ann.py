"""Approximate nearest neighbours over a corpus partitioned into k-means cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from questloom.functions.vectors import vector_verdict
from questloom.operators.blocks import Batches, scan_against
from questloom.operators.knn import RESULT_BYTES, Cells, _by_dimension, _matrix, fold_copies, knn, nearest_kernel, top_ranked, vector_bytes
from questloom.session import path_exists, stage

# Rows that the centroids are placed from, about.
TRAIN_ROWS = 1_000_000
# By default a search probes so many cells that this part of the true neighbours of the trial questions is found.
RECALL = 0.95
# Rows that serve as trial questions, about, and how many neighbours of each.
TRIALS, TRIAL_TOP = 200, 20
# The cells to probe are measured again when an index has so many times the rows of the last measurement.
GROWTH = 2
SEED = 42


def build_vector_index(
    corpus: DataFrame,
    path: str,
    cells: int | None = None,
    *,
    id_col: str = "kunnr",
    vector_col: str = "vector",
    iterations: int = 10,
    train_rows: int = TRAIN_ROWS,
    recall: float = RECALL,
    seed: int = SEED,
    overwrite: bool = False,
) -> int:
    """Write the corpus by cell, and the centroids beside it.  Returns the number of cells.

    By default there are as many cells as the root of the number of rows; there are never more than rows.  The
    centroids are placed from about ``train_rows`` rows, every row is indexed.  Cells differ in size; the
    rebalance hint lets Spark cut a crowded cell into several tasks and files instead of sending it to one.
    Beside the centroids stands how many cells a search must probe to find ``recall`` of the true neighbours, measured on
    about ``TRIALS`` rows of the corpus; questions unlike the corpus may need more.
    Rows without a usable vector (null, empty, not finite, or of another length than most) are in no cell: a search
    could not return them.
    """
    spark = corpus.sparkSession
    sized = corpus.groupBy(F.size(vector_col).alias("dim")).count().filter("dim > 0")
    best = sized.orderBy(F.desc("count"), "dim").first()
    if best is None:
        raise ValueError("no vectors to index")
    usable = corpus.filter(vector_verdict(F.col(vector_col), best["dim"]) == "OK")
    count = usable.count()
    if count == 0:
        raise ValueError("no usable vectors to index")
    cells = max(1, min(count, cells or math.isqrt(count)))
    rows = usable.withColumn("_features", array_to_vector(F.col(vector_col).cast("array<double>")))
    different = usable.select(F.col(vector_col).alias("v")).distinct().limit(2).collect()
    if cells == 1 or len(different) == 1:
        # One cell; with a single one, any place will do for its centroid.
        centroids = [(0, [float(x) for x in different[0]["v"]])]
        placed = rows.withColumn("cell", F.lit(0))
    else:
        fraction = min(1.0, max(train_rows, 4 * cells) / count)
        model = KMeans(
            k=cells, maxIter=iterations, seed=seed, featuresCol="_features", predictionCol="cell"
        ).fit(rows.sample(fraction, seed) if fraction < 1 else rows)
        centroids = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        placed = model.transform(rows)
    mode = "overwrite" if overwrite else "error"
    placed.drop("_features").hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{path}/rows")
    places = spark.createDataFrame(centroids, "cell int, centroid array<double>")
    stored = spark.read.parquet(f"{path}/rows").select(F.col(id_col).alias("kunnr"), F.col(vector_col).alias("vector"), "cell")
    nprobe = _measured_nprobe(stored, places, len(centroids), count, recall, seed)
    places.withColumn("nprobe", F.lit(nprobe)).write.mode(mode).parquet(f"{path}/centroids")
    _note_probes(spark, path, count, nprobe, recall, mode)
    return len(centroids)


def _note_probes(spark: SparkSession, path: str, count: int, nprobe: int, recall: float, mode: str) -> None:
    """Keep a measurement: how many rows there were, and how many cells gave that recall."""
    noted = spark.createDataFrame([(count, nprobe, recall)], "n_rows long, nprobe int, recall double")
    noted.coalesce(1).write.mode(mode).parquet(f"{path}/probes")


def _measured_nprobe(rows: DataFrame, centroids: DataFrame, cells: int, count: int, recall: float, seed: int) -> int:
    """The least number of nearest cells that hold ``recall`` of the true neighbours of some rows, themselves left out."""
    if cells == 1 or count == 1:
        return 1
    share = F.pmod(F.xxhash64("kunnr", F.lit(seed)), F.lit(1_000_000)) < F.lit(math.ceil(1_000_000 * min(1.0, TRIALS / count)))
    trials = stage(rows.filter(share).limit(4 * TRIALS).select(F.col("kunnr").alias("question_id"), "vector"), "trials")
    true = knn(trials, rows, TRIAL_TOP + 1).filter(~F.col("question_id").eqNullSafe(F.col("id"))).select("question_id", "id")
    held = true.join(rows.select(F.col("kunnr").alias("id"), "cell"), "id")
    order = _nearest_cells(trials, centroids, cells).select("question_id", F.col("id").alias("cell"), "rank")
    needed = {r["rank"]: r["count"] for r in held.join(order, ["question_id", "cell"]).groupBy("rank").count().collect()}
    total, found = sum(needed.values()), 0
    for nprobe in sorted(needed):
        found += needed[nprobe]
        if found >= recall * total:
            return nprobe
    return cells  # nothing to measure with


def add_to_index(new: DataFrame, path: str, *, vector_col: str = "vector") -> None:
    """Write further records into the cells of an index, each into the one whose centroid is nearest.

    The centroids stay; rebuild the index when the corpus has outgrown its number of cells.  Once there are ``GROWTH``
    times as many rows as when the cells to probe were measured, they are measured again, for the same recall.
    """
    spark = new.sparkSession
    _, centroids = read_vector_index(new.sparkSession, path)
    dim = len(centroids.first()["centroid"])
    usable = new.filter(vector_verdict(F.col(vector_col), dim) == "OK")
    lifted = usable.select(F.col("kunnr").alias("question_id"), F.col(vector_col).alias("vector"))
    near = probe_cells(lifted, centroids, 1).select(F.col("question_id").alias("kunnr"), "cell")
    usable.join(near, "kunnr").hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{path}/rows")
    last = _last_probes(spark, path)
    if last is None:
        return
    rows = spark.read.parquet(f"{path}/rows").select("kunnr", F.col(vector_col).alias("vector"), "cell")
    count = rows.count()
    if count >= GROWTH * last["n_rows"]:
        places = centroids.select("cell", "centroid")
        nprobe = _measured_nprobe(rows, places, places.count(), count, last["recall"], SEED)
        _note_probes(spark, path, count, nprobe, last["recall"], "append")


def _last_probes(spark: SparkSession, path: str) -> Row | None:
    """The measurement over the most rows; nothing for an index that has none."""
    if not path_exists(spark, f"{path}/probes"):
        return None
    return spark.read.parquet(f"{path}/probes").orderBy(F.desc("n_rows")).first()


def read_index_keys(spark: SparkSession, path: str) -> DataFrame | None:
    """The keys in an index, or nothing if there is none."""
    return spark.read.parquet(f"{path}/rows").select("kunnr") if path_exists(spark, f"{path}/rows") else None


def read_vector_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows by cell, and the centroids with ``nprobe``, the number of cells to probe as last measured."""
    centroids, last = spark.read.parquet(f"{path}/centroids"), _last_probes(spark, path)
    if last is not None:
        centroids = centroids.withColumn("nprobe", F.lit(last["nprobe"]))
    return spark.read.parquet(f"{path}/rows"), centroids


def probe_cells(questions: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """question_id, vector, cell: the ``nprobe`` cells nearest to each question."""
    near = _nearest_cells(questions, centroids, nprobe)
    return near.select("question_id", F.col("id").alias("cell")).join(
        questions.select("question_id", "vector"), "question_id"
    )


def _nearest_cells(questions: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """question_id, id (of a cell), rank.

    Nearest by Euclidean distance, written as an inner product with one extra
    element per vector: q.c - |c|^2 / 2 orders like -|q - c|.
    """
    half_norm = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x) / 2
    lifted_cells = centroids.select("cell", F.concat("centroid", F.array(-half_norm)).alias("vector"))
    lifted = questions.select(
        "question_id", F.concat(F.col("vector").cast("array<double>"), F.array(F.lit(1.0))).alias("vector")
    )
    return knn(lifted, lifted_cells, nprobe, id_col="cell")


def default_nprobe(centroids: DataFrame) -> int:
    """What was measured when the index was built; of an index without that, all cells."""
    if "nprobe" in centroids.columns:
        return centroids.agg(F.max("nprobe")).first()[0]
    return max(1, centroids.count())


def ann_knn(
    questions: DataFrame,
    rows: DataFrame,
    centroids: DataFrame,
    k: int = 20,
    nprobe: int | None = None,
    *,
    id_col: str = "kunnr",
    vector_col: str = "vector",
    limit_bytes: int | None = None,
) -> DataFrame:
    """Like ``knn``, but a question only meets the ``nprobe`` cells nearest to it.

    Only the files of probed cells are read, and they are scanned where they
    are: a crowded cell is many files, not one task.  With ``nprobe`` = number
    of cells the result equals the exact one; by default it is what was measured
    when the index was built.
    """
    # As many as the root of the number of rows, so they travel with the tasks.
    places = centroids.select(F.col("cell").cast("int"), F.col("centroid").cast("array<double>")).toArrow()
    vectors = places["centroid"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(places), -1)
    cells = Cells(places["cell"].to_numpy(), vectors, nprobe or default_nprobe(centroids))
    small = questions.select("question_id", "vector")
    large = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), "cell")
    if cells.nprobe < len(cells.numbers):
        probed = [r["cell"] for r in _probed_cells(small, cells).collect()]  # at most one per centroid
        large = large.filter(F.col("cell").isin(probed))
    types = dict(small.dtypes) | dict(large.dtypes)
    hits = scan_against(
        large,
        small,
        nearest_kernel(k, cells),
        f"question_id {types['question_id']}, id {types['id']}, score double",
        row_bytes=vector_bytes(F.col("vector"), F.col("question_id")) + F.lit(k * RESULT_BYTES + len(cells.numbers)),
        large_bytes=vector_bytes(F.col("vector")),
        small_key="question_id",
        large_key="id",
        limit_bytes=limit_bytes,
        fold=fold_copies(k),
    )
    return top_ranked(hits, k)


def _probed_cells(questions: DataFrame, cells: Cells) -> DataFrame:
    """(cell): those that any question probes."""
    dim = cells.centroids.shape[1]

    def run(batches: Batches) -> Batches:
        some = np.zeros(len(cells.numbers), dtype=bool)
        for batch in batches:
            column = batch.column("vector")
            at = _by_dimension(column).get(dim)
            if at is not None:
                some |= cells.probed(_matrix(column.take(pa.array(at)), dim), np.arange(len(at))).any(axis=0)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cells.numbers[some], pa.int32())})

    return questions.select("vector").mapInArrow(run, "cell int").distinct()
