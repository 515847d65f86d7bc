"""The Merkle manifest against trees built plainly."""

from __future__ import annotations

from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from questloom.llm import merkle
from tests.llm.tables import docs_table, empty_docs


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, fan_out):
    """The root over ``nodes`` and each one's siblings, level by level, left and right."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            low = place // fan_out * fan_out
            ways[i].append(("".join(nodes[low:place]), "".join(nodes[place + 1 : low + fan_out])))
            at[i] = place // fan_out
        nodes = [h(*nodes[i : i + fan_out]) for i in range(0, len(nodes), fan_out)]
    return nodes[0], ways


def brute(docs, tampered, fan_out=2):
    """``docs``: (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for d in docs:
        groups[d[2]].append((d[0], leaf_of(d), leaf_of((*d[:3], d[3] + 1 if d[3] is not None and tampered(d[0]) else d[3], d[4]))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = climb([x[1] for x in groups[g]], fan_out)
    root, over = climb([trees[g][0] for g in order], fan_out)
    out = []
    for g, above in zip(order, over):
        subroot, ways = trees[g]
        for (doc_id, leaf, other), way in zip(groups[g], ways):
            folded = other
            for left, right in way + above:
                folded = h(left, folded, right)
            out.append((doc_id, leaf, subroot, root, h(*[x for pair in way + above for x in pair]), folded, folded == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest(docs, fan_out=2):
    n_chars = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(docs, altered={"n_chars": n_chars}, fan_out=fan_out).collect()
    return Counter(tuple(r[c] for c in COLUMNS) for r in found)


@pytest.mark.parametrize("fan_out", [2, 3])
def test_awkward_table(spark, fan_out):
    docs = docs_table(spark)
    data = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    assert manifest(docs, fan_out) == Counter(brute(data, lambda i: i is not None and i % 3 == 0, fan_out))


@pytest.mark.parametrize("fan_out, levels", [(2, 2), (3, 1)])
def test_trees_over_many_blocks_and_slices(spark, monkeypatch, fan_out, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(merkle, "SLICE_ROWS", 50)
    langs = ["en"] * 8 + ["de", None] + [f"l{i}" for i in range(9)]
    data = [(i % 190 if i % 11 else None, "s", langs[i % len(langs)], i if i % 5 else None, f"text {i % 170}") for i in range(230)]
    docs = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest(docs.repartition(3), fan_out) == Counter(brute(data, lambda i: i is not None and i % 3 == 0, fan_out))


def test_a_single_row_and_none(spark):
    one = [(4, None, None, None, None)]
    docs = spark.createDataFrame(one, "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest(docs) == Counter(brute(one, lambda i: False))
    assert manifest(empty_docs(spark)) == Counter()


def test_only_right_siblings_are_hashed_again():
    tree = merkle.Subtree([h(str(i)) for i in range(11)], 3, None)
    assert tree.nodes[-1][0].decode() == climb([h(str(i)) for i in range(11)], 3)[0]
    for i in range(11):
        assert tree.fold(i, tree.nodes[0][i]) == tree.nodes[-1][0]
        assert tree.fold(i, h("other").encode()) != tree.nodes[-1][0]
    assert [len(slots) for slots in tree.states[0]] == [3, 3, 3, 2]
