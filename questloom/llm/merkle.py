"""A Merkle manifest of a dataset on SHA-256 midstates.

Rows become leaves, the leaves of a group a tree, the roots of all groups a tree above them.  While a parent's digest is
made, it keeps a copy of the hash state in front of each child's slot.  To fold a replaced leaf up to the root, each
parent goes on from the state it kept for that slot with the replacement and the siblings to the right; what lies to the
left is never hashed again.

Trees are cut along their leaves into blocks of a whole subtree each, so that a task holds one block, however large a
group is.  The roots of the blocks are the nodes of a tree again, and so on up; what lies above a block is one path, for
which the states are kept once for all leaves of the block.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questloom.operators.windows import rank_in_slices
from questloom.session import stage

#: Levels of a block: 1,024 leaves for two children a node.
BLOCK_LEVELS = 10
#: A group with more rows than about this is ranked slice by slice.
SLICE_ROWS = 1 << 13
PATH = "array<struct<left:string,right:string>>"


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


class Subtree:
    """The nodes above some consecutive ones, level by level, with the states that parents keep for their slots."""

    def __init__(self, digests: Sequence[str], fan_out: int, levels: int | None):
        """``levels`` above ``digests``, even if one node is left before; None: until one is left."""
        self.fan_out = fan_out
        self.nodes = [[d.encode() for d in digests]]
        self.states: list[list[list]] = []
        while len(self.nodes[-1]) > 1 if levels is None else len(self.states) < levels:
            children, parents, kept = self.nodes[-1], [], []
            for low in range(0, len(children), fan_out):
                state, slots = sha256(), []
                for child in children[low : low + fan_out]:
                    slots.append(state.copy())
                    state.update(child)
                kept.append(slots)
                parents.append(state.hexdigest().encode())
            self.nodes.append(parents)
            self.states.append(kept)

    def siblings(self, at: int) -> list[tuple[bytes, bytes]]:
        """What is beside node ``at`` and its ancestors, to the left and to the right, level by level."""
        found = []
        for children in self.nodes[:-1]:
            low = at - at % self.fan_out
            found.append((b"".join(children[low:at]), b"".join(children[at + 1 : low + self.fan_out])))
            at //= self.fan_out
        return found

    def fold(self, at: int, digest: bytes) -> bytes:
        """The top that ``digest`` in place of node ``at`` leads to."""
        for children, kept in zip(self.nodes, self.states):
            parent, slot = divmod(at, self.fan_out)
            state = kept[parent][slot].copy()
            state.update(digest)
            for sibling in children[at + 1 : (parent + 1) * self.fan_out]:
                state.update(sibling)
            digest = state.hexdigest().encode()
            at = parent
        return digest


class Way:
    """The way from a block's root to the top: its siblings, and the state in front of the slot at each level."""

    def __init__(self, path: Sequence[dict]):
        self.siblings = b"".join((level["left"] + level["right"]).encode() for level in path)
        self.steps = [(sha256(level["left"].encode()), level["right"].encode()) for level in path]

    def fold(self, digest: bytes) -> bytes:
        for before, right in self.steps:
            state = before.copy()
            state.update(digest)
            state.update(right)
            digest = state.hexdigest().encode()
        return digest


def _subtree(table: pa.Table, fan_out: int) -> tuple[pa.Table, Subtree]:
    """The block's rows in order, and the tree above them."""
    table = table.sort_by("at")
    more_blocks = table["size"][0].as_py() > fan_out**BLOCK_LEVELS
    return table, Subtree(table["digest"].to_pylist(), fan_out, BLOCK_LEVELS if more_blocks else None)


def _with_block(nodes: DataFrame, fan_out: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / fan_out**BLOCK_LEVELS))


def climb(nodes: DataFrame, fan_out: int) -> list[DataFrame]:
    """The nodes (tree, at, digest, size) of every stage from ``nodes`` to the roots, each stage stored.

    ``at`` counts a tree's nodes from 0 and ``size`` is their number.  A stage is ``BLOCK_LEVELS`` levels, so that there
    are few; every block of it is one group.
    """
    width = fan_out**BLOCK_LEVELS

    def top(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1)
        _, tree = _subtree(table, fan_out)
        blocks = -(-first["size"][0].as_py() // width)
        return pa.table({"tree": first["tree"], "at": first["block"], "digest": [tree.nodes[-1][0].decode()], "size": pa.array([blocks], pa.int64())})

    stages = [nodes]
    while (stages[-1].agg(F.max("size")).first()[0] or 0) > 1:
        blocks = _with_block(stages[-1].select("tree", "at", "digest", "size"), fan_out).groupBy("tree", "block")
        stages.append(stage(blocks.applyInArrow(top, "tree string, at bigint, digest string, size bigint"), "merkle-nodes"))
    return stages


def descend(stages: list[DataFrame], above: DataFrame, fan_out: int) -> DataFrame:
    """(tree, at, path) for the nodes of the first of ``stages``; ``above`` has (tree, path) for the trees' roots."""
    paths = above.select("tree", F.lit(0).cast("bigint").alias("at"), "path")

    def extend(nodes: pa.Table, over: pa.Table) -> pa.Table:
        nodes, tree = _subtree(nodes, fan_out)
        rest = over["path"][0].as_py()
        found = [
            [{"left": left.decode(), "right": right.decode()} for left, right in tree.siblings(i)] + rest
            for i in range(nodes.num_rows)
        ]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table({"tree": nodes["tree"], "at": nodes["at"], "path": pa.array(found, kind)})

    for nodes in reversed(stages[:-1]):
        blocks = _with_block(nodes.select("tree", "at", "digest", "size"), fan_out).groupBy("tree", "block")
        over = paths.select("tree", F.col("at").alias("block"), "path").groupBy("tree", "block")
        paths = blocks.cogroup(over).applyInArrow(extend, f"tree string, at bigint, path {PATH}")
    return paths


def build(rows: DataFrame, fan_out: int = 2) -> DataFrame:
    """Trees over ``rows`` (id, group, leaf, altered): id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A group's leaves stand by id (null first), those of one id by leaf; leaves alike in both may change places.  While a
    level has several nodes, every ``fan_out`` consecutive ones (the last ones: fewer, even one) become the digest of
    their digests' hex text; a lone leaf is its group's root.  The groups' roots, by group (null first, then by UTF-8
    bytes), become the root in the same way.  ``proof_sha256`` digests the siblings on the way to the root, and
    ``folded_root`` is where ``altered`` (null: the leaf itself) leads with these siblings.  Rows repeated are leaves
    each.  No rows give no rows.
    """
    # Order and equality as of the group, but never null.
    tree = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit(""))
    named = rows.select(F.col("id"), tree.alias("tree"), F.col("leaf").alias("digest"), "altered")
    ranked = rank_in_slices(named, ["tree"], ["id", "digest"], slice_rows=SLICE_ROWS)
    leaves = stage(
        ranked.select("id", "tree", "digest", "altered", (F.col("position") - 1).alias("at"), F.col("group_size").alias("size")),
        "merkle-leaves",
    )
    stages = climb(leaves, fan_out)
    subroots = stages[-1].select("tree", "digest")
    over = rank_in_slices(subroots.withColumn("all", F.lit("")), ["all"], ["tree"], slice_rows=SLICE_ROWS)
    over = stage(over.select(F.col("all").alias("tree"), F.col("tree").alias("group"), "digest", (F.col("position") - 1).alias("at"), F.col("group_size").alias("size")), "merkle-subroots")
    upper = climb(over, fan_out)
    (root,) = upper[-1].select("digest").first() or (None,)  # one digest
    above = descend(upper, upper[-1].select("tree", F.array().cast(PATH).alias("path")), fan_out)
    # One row a group: its root, the dataset's root, and the way between them.
    groups = over.select("at", F.col("group").alias("tree"), F.col("digest").alias("subroot")).join(above.select("at", "path"), "at")
    if len(stages) > 1:
        blocks = descend(stages[1:], groups.select("tree", "path"), fan_out).join(groups.select("tree", "subroot"), "tree")
    else:
        blocks = groups.withColumn("at", F.lit(0).cast("bigint"))

    def fold(block: pa.Table, over: pa.Table) -> pa.Table:
        block, tree = _subtree(block, fan_out)
        way = Way(over["path"][0].as_py())
        proofs, folded = [], []
        for i, (leaf, altered) in enumerate(zip(block["digest"].to_pylist(), block["altered"].to_pylist())):
            proofs.append(sha256(b"".join([x for pair in tree.siblings(i) for x in pair]) + way.siblings).hexdigest())
            folded.append(way.fold(tree.fold(i, (altered or leaf).encode())).decode())
        n = block.num_rows
        return pa.table(
            {
                "id": block["id"],
                "leaf": block["digest"],
                "subroot": [over["subroot"][0].as_py()] * n,
                "root": [root] * n,
                "proof_sha256": proofs,
                "folded_root": folded,
                "verified": [f == root for f in folded],
            }
        )

    kind = rows.schema["id"].dataType.simpleString()
    return (
        _with_block(leaves, fan_out)
        .groupBy("tree", "block")
        .cogroup(blocks.select("tree", F.col("at").alias("block"), "subroot", "path").groupBy("tree", "block"))
        .applyInArrow(fold, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    )


def manifest(docs: DataFrame, *, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang", id_col: str = "doc_id", altered: dict[str, Column] | None = None, fan_out: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; see ``build``.

    A leaf digests ``fields`` in turn, each by ``field_text``, the whole text included; other columns take no part.
    ``altered`` gives other values for some fields, which the leaf is checked with against the manifest.
    """
    new = altered or {}
    leaf = leaf_digest([F.col(f"`{c}`") for c in fields])
    other = leaf_digest([new.get(c, F.col(f"`{c}`")) for c in fields])
    rows = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf.alias("leaf"), other.alias("altered"))
    stored = stage(rows.withColumn("altered", F.nullif("altered", "leaf")), "merkle-rows")
    return build(stored, fan_out).withColumnRenamed("id", "doc_id")
