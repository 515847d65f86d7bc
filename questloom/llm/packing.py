"""Packing of token ids into sequences by Karmarkar-Karp multiway differencing.

A task cuts what its documents have beyond whole sequences off and collects the remainders to blocks of some hundred
sequences.  In a block each remainder starts as a partial partition: one window holds it, the others nothing.  The two
partial partitions with the widest gap between their fullest and emptiest window are merged, the fullest windows of one
onto the emptiest of the other, until one is left: windows that are nearly equal.  Where one exceeds the capacity, the
excess is cut off its longest piece and fills the windows that lack something; what finds no place raises the number of
windows.  Those further windows are as long as powers of two, which need no padding.

Blocks are made of the rows that a task reads one after another: no shuffle, and no key that could be hot.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Windows of a block: bounds a task's memory and the work of a merge.
BLOCK_WINDOWS = 256
#: Entries of a half of a task's memo, and the longest word that gets one; no effect on results.
MEMO, MEMO_BYTES = 400_000, 64
#: Bytes of text tokenized at once.
AT_ONCE = 4 << 20


class Piece(NamedTuple):
    """``length`` tokens of document ``doc`` (its number in the block) from token ``start`` on."""

    doc: int
    start: int
    length: int


def differencing(sizes: list[int], windows: int) -> list[int]:
    """The window (0 to ``windows`` - 1) of each item, by Karmarkar-Karp differencing over all windows at once."""
    if windows <= 1 or not sizes:
        return [0] * len(sizes)
    # A partial partition: its window sums less the smallest one, ascending.  Ties fall to the one made first.
    alone = np.zeros((len(sizes), windows), np.int64)
    alone[:, -1] = sizes
    partitions: list[np.ndarray] = list(alone)
    parents: list[tuple[int, int, np.ndarray]] = []
    heap = [(-size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, one), (_, other) = heapq.heappop(heap), heapq.heappop(heap)
        sums = partitions[one] + partitions[other][::-1]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        sums -= sums[0]
        partitions[one] = partitions[other] = alone[0, :0]
        heapq.heappush(heap, (-int(sums[-1]), len(partitions)))
        partitions.append(sums)
        parents.append((one, other, order))
    # From the last partition back to the items: which window each place of a partition has become.
    places: list[np.ndarray | None] = [None] * len(partitions)
    places[-1] = np.arange(windows)
    for node in range(len(partitions) - 1, len(sizes) - 1, -1):
        one, other, order = parents[node - len(sizes)]
        for child, at in ((one, order), (other, windows - 1 - order)):
            places[child] = np.empty(windows, np.int64)
            places[child][at] = places[node]
        places[node] = None
    return [int(places[i][-1]) for i in range(len(sizes))]


def pack_block(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """The pieces, cut where needed, in sequences that are full or as long as a power of two."""
    total = sum(p.length for p in pieces)
    count = total // capacity
    windows: list[list[Piece]] = [[] for _ in range(count)]
    over: list[Piece] = []
    if count:
        for piece, window in zip(pieces, differencing([p.length for p in pieces], count)):
            windows[window].append(piece)
    else:
        over = list(pieces)
    lacking: list[tuple[int, int]] = []
    for number, window in enumerate(windows):
        excess = sum(p.length for p in window) - capacity
        while excess > 0:
            longest = max(range(len(window)), key=lambda i: window[i].length)
            doc, start, length = window.pop(longest)
            cut = min(excess, length)
            if cut < length:
                window.insert(longest, Piece(doc, start, length - cut))
            over.append(Piece(doc, start + length - cut, cut))
            excess -= cut
        if excess < 0:
            lacking.append((-excess, number))
    # The longest pieces go first, so that few are cut again.
    over.sort(key=lambda p: (p.length, p.doc, p.start))
    lacking.sort(reverse=True)
    rest = total - count * capacity
    places = [(room, windows[number]) for room, number in lacking]
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            windows.append([])
            places.append((1 << bit, windows[-1]))
    for room, window in places:
        while room:
            doc, start, length = over.pop()
            taken = min(room, length)
            window.append(Piece(doc, start, taken))
            if taken < length:
                over.append(Piece(doc, start + taken, length - taken))
            room -= taken
    return windows


#: Fixed: the pre-tokenizer of byte-level vocabularies, and the byte characters they leave as they are.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHOWN = (*range(33, 127), *range(161, 173), *range(174, 256))
#: A space in front of what may be white space, or of nothing.
_BESIDE = re.compile(rb" (?:[\x00-\x20\x7f]|\Z|[\xc2\xc9-\xff])")
#: Parts that go to the tokenizer many at a time: printable ASCII and Latin letters, with line feeds between, not too long.
_PLAIN = re.compile(rb" ?(?!.*\xc3[\x97\xb7])[\x21-\x7e\xc3-\xc8](?:[\n\x21-\x7e\x80-\xbf\xc3-\xc8]{0,58}[\x21-\x7e\x80-\xbf])?", re.S)


class Words:
    """Token ids of whole texts by a byte-level BPE of the ``tokenizers`` library, each distinct word encoded once.

    Its pre-tokenizer begins a new pre-token at every space that something other than white space follows, and merges
    stay inside a pre-token.  So what lies between such spaces (a part) is encoded apart, which is exact.  Many plain
    parts are encoded as one text, parted by tabs, by ``tiktoken`` with the vocabulary of the same file: where the
    number of a token is the rank of its merge, both make the same merges.  All other parts go to the library itself.
    The strings of special tokens count as ordinary text.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(SHOWN)))}
        first = len(model["vocab"]) - len(model["merges"])
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        merged = ["".join(pair) for pair in pairs]
        shift = model["vocab"][merged[0]] if merged else first
        if any(model["vocab"][t] != shift + i for i, t in enumerate(merged)):
            raise ValueError(f"the tokens of {path} are not numbered in the order of its merges")
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t) and i < shift + len(merged)}
        self.plain = tiktoken.Encoding("plain", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        probe = " a.\nAb\t d\u00e9j\u00e0,'s\t\u00d6l!?12\t"
        if self.plain.encode_ordinary(probe) != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{path} does not part words as a byte-level pre-tokenizer does")
        (self.tab,) = self.plain.encode_ordinary("\t")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts = [_parts(t) for t in texts]
        young, old = self.young, self.old
        new = set().union(*parts).difference(young)
        if old:
            again = [p for p in new if p in old]
            young.update(zip(again, map(old.__getitem__, again)))
            new.difference_update(again)
        odd = self._learn(new)
        out = [b"".join(map(young.__getitem__, p)) for p in parts]
        for part in odd:
            if len(part) > MEMO_BYTES:
                del young[part]
        if len(young) > MEMO:
            self.old, self.young = young, {}
        return out

    def _learn(self, new: set[bytes]) -> list[bytes]:
        """Remember the ids of the parts; returns those that are not plain."""
        plain = list(filter(_PLAIN.fullmatch, new))
        odd = list(new.difference(set(plain)))
        for part in odd:
            text = part[1:].decode() if part[:1] == b" " else " " + part.decode()
            self.young[part] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        for low in range(0, len(plain), 8192):
            some = plain[low : low + 8192]
            # The first parts of texts, which have no space in front, come last.
            firsts = [p for p in some if p[:1] == b" "]
            if firsts:
                some = [p for p in some if p[:1] != b" "] + firsts
            at = len(some) - len(firsts)
            text = b"".join([b" " if at else b"", b"\t ".join(some[:at]), b"\t" if at else b"", *[p[1:] + b"\t" for p in firsts]])
            ids = np.array(self.plain.encode_ordinary(text.decode()), "<u4")
            ends = np.flatnonzero(ids == self.tab)
            if len(ends) != len(some):
                raise ValueError("the tokenizer joins a tab with what is beside it")
            flat = ids.tobytes()
            starts = [0, *(4 * ends[:-1] + 4).tolist()]
            self.young.update(zip(some, map(flat.__getitem__, map(slice, starts, (4 * ends).tolist()))))
        return odd


def _may_be_space(part: bytes) -> bool:
    """Whether the part is empty or begins with what some version of Unicode may take for white space."""
    if not part:
        return True
    if part[0] < 128:
        return part[0] < 33 or part[0] == 127
    c = part[:4].decode(errors="ignore")[0]
    return c.isspace() or unicodedata.category(c)[0] in "ZC"


def _parts(text: bytes) -> list[bytes]:
    """The text cut in front of every space that something else than white space follows.

    A part stands for the space in front of it, too; only the first has none, and begins with one to be told from others.
    """
    if not text:
        return []
    first, *others = text.split(b" ")
    parts = [b" " + first]
    # Only ASCII white space, spaces in a row and other scripts' spaces need a closer look, and few texts have any.
    if not _BESIDE.search(text):
        return parts + others
    for p in others:  # white space beside a space: keep it with what is in front
        if _may_be_space(p):
            parts[-1] += b" " + p
        else:
            parts.append(p)
    return parts


class _Block:
    """Documents whose remainders are to be packed together."""

    def __init__(self) -> None:
        self.docs: list[tuple[object, bytes]] = []
        self.whole: list[Piece] = []
        self.left: list[Piece] = []
        self.tokens = 0
        self.left_tokens = 0

    def add(self, doc_id: object, ids: bytes, capacity: int) -> None:
        n = len(ids) // 4
        number = len(self.docs)
        self.docs.append((doc_id, ids))
        full = n // capacity * capacity
        self.whole += [Piece(number, at, capacity) for at in range(0, full, capacity)]
        if n > full:
            self.left.append(Piece(number, full, n - full))
        self.tokens += n
        self.left_tokens += n - full

    def sequences(self, capacity: int) -> Iterable[list[Piece]]:
        yield from ([p] for p in self.whole)
        yield from pack_block(self.left, capacity)


def pack(docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text (null: empty) by the tokenizer at ``path`` and ``end_id`` after them, so that
    an empty document has one token; rows repeated are packed each time.  Every token lies in one piece: ``start`` of
    its document's ``doc_tokens`` tokens are before the piece, and ``offset`` of its sequence's.  ``ids`` are
    little-endian unsigned 32-bit integers.  Sequences hold ``capacity`` tokens or, at the end of a block of about
    ``block_windows`` sequences, a smaller power of two.  A sequence_id occurs once in a result; which documents share a
    sequence depends on the partitions of ``docs``.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], np.uint32).tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def batches_of(block: _Block, first: int, id_type: pa.DataType) -> Iterator[tuple[pa.RecordBatch, int]]:
        columns: list[list] = [[] for _ in names]
        size = 0
        for number, sequence in enumerate(block.sequences(capacity), first):
            offset = 0
            for doc, start, length in sequence:
                doc_id, ids = block.docs[doc]
                values = (doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, number, offset)
                for column, value in zip(columns, values):
                    column.append(value)
                offset += length
            size += offset
            if size >= 1 << 20:
                yield _batch(columns, id_type, names), number + 1
                columns, size = [[] for _ in names], 0
            first = number + 1
        if columns[0]:
            yield _batch(columns, id_type, names), first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(path)
        block, following = _Block(), TaskContext.get().partitionId() << 40
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column("doc_id").type
            for part in _parts_of(batch):
                texts = part.column("text").to_pylist()
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), words.ids(texts)):
                    block.add(doc_id, ids + end, capacity)
                    if block.left_tokens >= block_windows * capacity or block.tokens >= 16 * block_windows * capacity:
                        for out, following in batches_of(block, following, id_type):
                            yield out
                        block = _Block()
        for out, following in batches_of(block, following, id_type):
            yield out

    return rows.mapInArrow(
        run,
        f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint",
    )


def _batch(columns: list[list], id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``AT_ONCE`` bytes of text, of one row at least."""
    sizes = np.cumsum([0, *[len(v.as_buffer()) for v in batch.column("text")]])
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(sizes, sizes[low] + AT_ONCE, side="right")) - 1)
        yield batch.slice(low, high - low)
        low = high
