"""Token counts: how many pieces greedy longest-match segmentation makes of every word, without making them.

The vocabulary is a trie with two roots, for pieces that begin a word and for those that continue one.  Where a node has
no way on, its failure link leads to the node for what is left once the longest pieces are taken off the front, and its
popped count says how many these are.  Both are worked out beforehand, so that a word takes time linear in its bytes
however its pieces overlap.  (A word that can't be segmented is one unknown token.)
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, INSIDE = 0, 1
#: Entries of a task's memo of words, and the longest word that gets one; no effect on results.
MEMO, MEMO_BYTES = 500_000, 64
#: An unknown word counts one in the bits from here on, too.
UNKNOWN = 1 << 40


class Automaton:
    """The trie over bytes, its failure links (-1: none) and popped counts."""

    def __init__(self, initial: Iterable[bytes], inside: Iterable[bytes]):
        self.step: dict[int, int] = {}
        ends = [False, False]
        parents: list[tuple[int, int]] = [(-1, 0), (-1, 0)]
        for root, pieces in ((START, initial), (INSIDE, inside)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    node = self.step.get(key, -1)
                    if node < 0:
                        node = self.step[key] = len(ends)
                        ends.append(False)
                        parents.append((key >> 8, byte))
                if node != root:
                    ends[node] = True
        self.fail = [-1] * len(ends)
        self.popped = [0] * len(ends)
        depth = [0] * len(ends)
        for node in range(2, len(ends)):
            depth[node] = depth[parents[node][0]] + 1
        for node in sorted(range(2, len(ends)), key=depth.__getitem__):
            if ends[node]:
                self.fail[node], self.popped[node] = INSIDE, 1
                continue
            parent, byte = parents[node]
            rest, count = self.fail[parent], self.popped[parent]
            while rest >= 0 and rest << 8 | byte not in self.step:
                count += self.popped[rest]
                rest = self.fail[rest]
            if rest >= 0:
                self.fail[node], self.popped[node] = self.step[rest << 8 | byte], count

    def count(self, word: bytes) -> int:
        """The number of pieces, or 1 + ``UNKNOWN`` if there is no segmentation."""
        step, fail, popped = self.step, self.fail, self.popped
        node = total = 0
        for byte in word:
            following = step.get(node << 8 | byte, -1)
            while following < 0:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1 + UNKNOWN
                following = step.get(node << 8 | byte, -1)
            node = following
        while node != INSIDE:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return 1 + UNKNOWN
        return total


class _Memo(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        value = self.automaton.count(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = value
        return value


def rank_file_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """The vocabulary of a rank file (a base64 token and a rank a line) as pieces: (those that begin words, the others).

    Tokens with one space in front begin words, those without white space continue them, the rest can't occur in a word.
    """
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    whole = [t for t in tokens if len(t.split()) == 1]
    return [t[1:] for t in whole if t[:1] == b" " and t[1:].split() == [t[1:]]], [t for t in whole if t.split() == [t]]


def count_tokens(docs: DataFrame, initial: Iterable[bytes], inside: Iterable[bytes], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens, n_unknown (bigint).

    Words are the runs of bytes of the text's UTF-8 between ASCII white space, whole and of any length; each is
    segmented on its own, greedily by the longest piece, the first one from ``initial``, the others from ``inside``.
    Null and empty texts have 0 everywhere.  With an empty vocabulary every word is unknown.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(initial, inside))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Memo(automaton.value).__getitem__
        for batch in batches:
            n_words, totals = [], []
            for value in batch.column("text"):
                words = (value.as_py() or "").encode().split()
                n_words.append(len(words))
                totals.append(sum(map(known, words)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array([t % UNKNOWN for t in totals], pa.int64()),
                    pa.array([t // UNKNOWN for t in totals], pa.int64()),
                ],
                ["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")
