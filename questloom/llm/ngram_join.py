"""Jaccard self-join of texts on their word n-grams, by MinHash banding.

* The number of bands and rows is chosen so that a pair at the threshold meets in a band with the wanted probability.
* Equal texts are one node.  Nodes that meet in a band are joined to the band's first node: as many links as rows, however
  crowded the band.  What these links connect is a candidate set; every pair that shares a band lies in one.
* All pairs within a candidate set are verified on their full n-gram sets.  Small sets share a task; a large set is cut
  by hash into blocks of some hundred nodes, and each pair of blocks is a task of its own.  A task counts what its
  pairs share by way of their common n-grams, and returns for each node how many links it has, and under which node
  its linked nodes hang: rows as many as nodes, not as pairs.
* The links connect the groups that are returned.

Text is shuffled once (to hand the candidates' texts to their nodes); signatures, bands and links are numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questloom.llm.common import keep_rows, one_of_each, stage_numbers, whole_text
from questloom.llm.components import components
from questloom.session import stage

NGRAM, THRESHOLD = 5, 0.8
#: Chance that a pair at the threshold is found, and the most hash functions to spend on it.
RECALL, MOST_HASHES = 0.9999, 128
#: Nodes, and words, that a block of a candidate set has on average at most.
BLOCK_NODES, BLOCK_WORDS = 512, 1_000_000
#: N-grams of a task held by more nodes than this are counted by a matrix product, the others pair by pair.
CROWDED = 32
MEMO = 500_000


def choose_bands(threshold: float, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective layout within ``most_hashes`` that finds a pair at ``threshold`` with ``recall``."""
    for rows in range(most_hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("no layout reaches that recall with so many hashes")


class _WordHashes(dict):
    """64-bit hashes of words, remembered for the words of a task up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def ngrams(text: str, n: int, memo: dict) -> np.ndarray:
    """64-bit hashes of the word n-grams in order; of a text with fewer words, of all its words; of none, nothing."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    factors = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(width)], np.uint64)
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total += hashed[i : len(hashed) - width + 1 + i] * factors[i]
    return _mixed(total)


def signature(grams: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the n-grams."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(grams), 512):
        np.minimum(least, (grams[low : low + 512, None] * factors + offsets).min(axis=0), out=least)
    return least


def _hash_functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_11)
    return draw.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, count, np.uint64)


def signatures(rows: DataFrame, n: int, bands: int, depth: int) -> DataFrame:
    """Of (doc_id, node, text): doc_id, node, n_words and the bands' hashes (none for a text without words)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        factors, offsets = _hash_functions(bands * depth)
        places = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)
        weights = np.array([pow(0x9FB21C651E98DF25, i + 1, 1 << 64) for i in range(depth)], np.uint64)
        with np.errstate(over="ignore"):
            for batch in batches:
                hashes, sizes = [], []
                for value in batch.column("text"):
                    grams = ngrams(value.as_py(), n, memo)
                    sizes.append(len(grams))
                    if len(grams):
                        least = signature(grams, factors, offsets).reshape(bands, depth)
                        hashes.append(_mixed((least * weights).sum(axis=1, dtype=np.uint64) + places).view(np.int64).tolist())
                    else:
                        hashes.append([])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("node"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                    ["doc_id", "node", "n_grams", "bands"],
                )

    return rows.select("doc_id", "node", "text").mapInArrow(
        run, f"doc_id {kind}, node string, n_grams bigint, bands array<bigint>"
    )


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """For all pairs of sets of numbers, how many numbers they share (a square matrix)."""
    n = len(sets)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owners = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    held = np.diff(np.append(starts, len(values)))
    counts = np.zeros(n * n, np.int64)
    for d in np.unique(held[(held > 1) & (held <= CROWDED)]):
        block = owners[starts[held == d][:, None] + np.arange(d)]
        left, right = np.triu_indices(d, 1)
        for low in range(0, len(block), max(1, 2_000_000 // len(left))):
            part = block[low : low + max(1, 2_000_000 // len(left))]
            codes, times = np.unique(part[:, left] * n + part[:, right], return_counts=True)
            counts[codes] += times
    counts = counts.reshape(n, n)
    counts += counts.T
    crowded = np.flatnonzero(held > CROWDED)
    for low in range(0, len(crowded), 1024):
        here = crowded[low : low + 1024]
        matrix = np.zeros((n, len(here)), np.float32)
        for column, k in enumerate(here):
            matrix[owners[starts[k] : starts[k] + held[k]], column] = 1
        counts += np.rint(matrix @ matrix.T).astype(np.int64)
    return counts


def _verify(threshold: float):
    """The links within a task's nodes: for each node their number, and the first node of what they connect here."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("id").sort_values("id", ignore_index=True)
        ids, groups, blocks = frame["id"].to_numpy(), frame["root"].to_numpy(), frame["block"].to_numpy()
        sets = [np.frombuffer(g, np.uint64) for g in frame["grams"]]
        sizes = np.array([len(s) for s in sets])
        shared = shared_counts(sets)
        either = sizes[:, None] + sizes[None, :] - shared
        linked = (shared >= threshold * either - 1e-9) & (shared > 0) & (groups[:, None] == groups[None, :])
        np.fill_diagonal(linked, False)
        if frame["lo"].iat[0] != frame["hi"].iat[0]:
            linked &= blocks[:, None] != blocks[None, :]
        first = np.full(len(ids), -1)
        for i in range(len(ids)):
            if first[i] < 0 and linked[i].any():
                edge = [i]
                first[i] = i
                while edge:
                    reached = np.flatnonzero(linked[edge].any(axis=0) & (first < 0))
                    first[reached] = i
                    edge = reached.tolist()
        seen = first >= 0
        return pd.DataFrame({"id": ids[seen], "links": linked.sum(axis=1)[seen], "first": ids[first[seen]]})

    return run


def _candidate_sets(nodes: DataFrame) -> DataFrame:
    """(id, root): the nodes that meet another in a band, by what the bands connect."""
    met = nodes.select("id", F.explode("bands").alias("band"))
    crowd = met.groupBy("band").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    edges = met.join(crowd.select("band", "first"), "band").where("id <> first")
    return components(edges.select(F.col("id").alias("a"), F.col("first").alias("b")))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = NGRAM, threshold: float = THRESHOLD,
                 recall: float = RECALL, most_hashes: int = MOST_HASHES, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """One row per row of ``docs``: doc_id, node, class_id, n_links, n_copies.

    Two texts are linked if the Jaccard similarity of their sets of ``n`` successive words (parted by ASCII white
    space) is at least ``threshold``.  ``n_links`` is the number of other texts linked to the row's text, ``n_copies`` the
    number of other rows with an equal text, ``class_id`` the smallest id among all rows that links and copies connect
    (null if all their ids are null).  A text of fewer words than ``n`` counts as one n-gram of all its words; texts
    without words, null ones among them, have no links, but equal ones are copies (a null text equals an empty one).
    ``node`` is the same for equal texts (the first half of the SHA-256).  Rows that repeat an id are separate rows.
    """
    bands, depth = choose_bands(threshold, recall, most_hashes)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    rows = rows.withColumn("node", F.substring(F.sha2("text", 256), 1, 32))
    signed = stage(signatures(rows, n, bands, depth), "signatures")
    # One row for each different text, numbered; written down, so the numbers stay.
    nodes = signed.dropDuplicates(["node"]).withColumn("id", F.monotonically_increasing_id())
    nodes = stage(nodes, "nodes")

    found = stage_numbers(_candidate_sets(nodes), "candidates")
    sizes = found.join(nodes.select("id", "n_grams"), "id").groupBy("root").agg(F.count("*").alias("m"), F.sum("n_grams").alias("w"))
    cuts = F.ceil(F.greatest(F.col("m") / block_nodes, F.col("w") / BLOCK_WORDS)).cast("int")
    sizes = stage_numbers(sizes.select("root", "m", cuts.alias("cuts")), "candidate-sizes")
    bins = max(1, (sizes.where("cuts = 1").agg(F.sum("m")).first()[0] or 0) // block_nodes)
    members = found.join(sizes, "root").join(nodes.select("id", "node", F.col("doc_id").alias("of")), "id")
    members = members.select(
        "id",
        "root",
        "cuts",
        F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root")).alias("set"),
        F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int").alias("block"),
        F.col("node").alias("of_node"),
        "of",
    )
    same = (F.col("node") == F.col("of_node")) & F.col("doc_id").eqNullSafe(F.col("of"))
    texts = rows.join(members, same).select("id", "root", "cuts", "set", "block", "text")
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")
    tasks = _gram_sets(texts, n).select("id", "root", "set", "cuts", "block", "grams", other)
    tasks = tasks.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    checked = tasks.groupBy("set", "cuts", "lo", "hi").applyInPandas(_verify(threshold), "id bigint, links bigint, first bigint")
    checked = stage(checked, "verified")

    linked = stage_numbers(components(checked.select(F.col("id").alias("a"), F.col("first").alias("b"))), "classes")
    links = checked.groupBy("id").agg(F.sum("links").alias("n_links"))
    texts_seen = signed.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("rows"))
    info = texts_seen.join(nodes.select("node", "id"), "node").join(linked, "id", "left").join(links, "id", "left")
    info = stage_numbers(info.withColumn("root", F.coalesce("root", "id")), "node-classes")
    classes = info.groupBy("root").agg(F.min("first_doc").alias("class_id"))
    info = info.join(classes, "root").select(
        "node", "class_id", F.col("root").alias("class_root"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("rows") - 1).alias("n_copies")
    )
    return signed.select("doc_id", "node").join(info, "node").select("doc_id", "node", "class_root", "class_id", "n_links", "n_copies")


def _gram_sets(texts: DataFrame, n: int) -> DataFrame:
    """The text replaced by its set of n-grams, as packed sorted numbers."""
    schema = texts.drop("text").schema.add("grams", "binary")
    names = texts.drop("text").columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                for low in range(0, batch.num_rows, 512):
                    part = batch.slice(low, 512)
                    sets = [np.unique(ngrams(t.as_py(), n, memo)).tobytes() for t in part.column("text")]
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(sets, pa.binary())], [*names, "grams"])

    return texts.mapInArrow(run, schema)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class of ``near_classes``, with all its columns: the one with the smallest id.

    Null ids come last; of rows with one id, the first by the digest of the text, then by the JSON form of the
    other columns.
    """
    found = near_classes(docs, id_col, text_col, **options)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best")
    kept = found.groupBy("class_root").agg(best).select("best.doc_id", "best.node")
    on = {"doc_id": F.col(id_col), "node": F.substring(F.sha2(whole_text(text_col), 256), 1, 32)}
    return one_of_each(keep_rows(docs, kept, on), list(on.values()), (id_col, text_col))
