"""SentencePiece encoding that keeps the place of every piece in the original text, and decoding.

A text is normalised first: at each place the longest prefix that the model's compiled character map knows is replaced
by what the map has for it, any other character is kept, spaces become the space mark and one is put in front.  For every
byte of the normalised text its source byte is noted, so that a piece, once found, is projected to the bytes it came
from.  Pieces are found by merging the best pair of neighbours until none is left.  No piece of the model reaches over
the beginning of a run of space marks (checked when the model is read), so a word with the marks before it is encoded
on its own, and words that come again are looked up in a bounded memo.

The model is read by the driver and sent to the tasks: its size does not depend on the data.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Fixed by the model format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: More than the rank of any pair.
NO_PAIR = 1 << 60
#: Entries of a task's memo, and the longest word that gets one.  They bound memory and change no result.
MEMO, MEMO_CHARS = 400_000, 40


def fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, blob[at : at + size]
            at += size


class CharMap:
    """The compiled map from character sequences to their normal forms: a double-array trie and a table of strings."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The normal form of the longest known prefix of ``text[at:]``, and the length of that prefix."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                start = units[node] & 0x7FFFFFFF
                found = self.strings[start : self.strings.index(b"\0", start)], i + 1 - at
        return found


class Model:
    """What a SentencePiece BPE model file says."""

    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict = {}
        normal: dict = {}
        for number, value in fields(blob):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0" * 4))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("only BPE models with byte fallback and space marks in front of words")
        if set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with user-defined or unused pieces are not supported")
        normal_scores = [s for p, s, k in zip(self.pieces, self.scores, self.kinds) if k == NORMAL and p[1:].strip(MARK)]
        if len(set(normal_scores)) < len(normal_scores) or len(self.pieces) >= 1 << 20:
            raise ValueError("pieces need different scores")
        if any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds) if k == NORMAL):
            raise ValueError("a piece of this model reaches over a space")
        self.begin = trainer.get(41, 1)
        self.end = trainer.get(42, 2)
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self.prefix = bool(normal.get(3, 1))
        self.squeeze = bool(normal.get(4, 1))
        self.char_map = normal.get(2, b"")


def normalise(text: bytes, char_map: CharMap | None, *, prefix: bool, squeeze: bool) -> tuple[bytes, np.ndarray]:
    """The normalised text, and for each of its bytes (and its end) the source byte that it comes from."""
    mark = MARK.encode()
    if char_map is None and not squeeze:
        if not text:
            return b"", np.zeros(1, np.int64)
        source = np.frombuffer(text, np.uint8)
        at = np.repeat(np.arange(len(text)), np.where(source == 32, len(mark), 1))
        front = np.zeros(len(mark) * prefix, np.int64)
        return mark * prefix + text.replace(b" ", mark), np.concatenate([front, at, [len(text)]])
    out, place = bytearray(), []
    at, after_space = 0, squeeze

    def put(piece: bytes, source: int) -> None:
        piece = piece.replace(b" ", mark)
        out.extend(piece)
        place.extend([source] * len(piece))

    started = False
    while at < len(text):
        known = char_map.longest(text, at) if char_map else None
        if known is None:
            first = text[at]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            known = text[at : at + width], width
        piece, width = known
        if squeeze:
            # Of a run of spaces one is left, of those at either end none.
            piece = re.sub(rb" +", b" ", piece)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                after_space = piece.endswith(b" ")
        if piece or not squeeze:
            if not started and prefix:
                put(b" ", at)
            started = True
            put(piece, at)
        at += width
    end = len(text)
    while squeeze and out.endswith(mark) and len(out) > len(mark) * prefix:
        del out[-len(mark) :]
        end = place[-len(mark)]
        del place[-len(mark) :]
    return bytes(out), np.array([*place, end], np.int64)


class Codec:
    """Encodes and decodes texts with one model; holds the memo of a task."""

    def __init__(self, model: Model):
        self.model = model
        self.char_map = CharMap(model.char_map) if model.char_map else None
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == BYTE}
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        # White space that is in no piece joins nothing and so stands alone.
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.ids))
        self.units = re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.width = [len(p.encode()) for p in model.pieces]
        # Pieces by falling score; a pair of ids gives its place there and the id of the joined piece.
        order = {s: r for r, s in enumerate(sorted({model.scores[i] for i in self.ids.values()}, reverse=True))}
        self.pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = order[model.scores[i]] << 20 | i
        self.rank = {p: -model.scores[i] for p, i in self.ids.items()}
        self.surface = [p.replace(MARK, " ") if k == NORMAL else "" for p, k in zip(model.pieces, model.kinds)]

    def merged(self, unit: str) -> list[str]:
        """The characters of ``unit``, neighbours joined by best score, leftmost first, as long as that makes a piece."""
        rank, parts = self.rank, list(unit)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < len(parts):
                joined = parts[left] + parts[right]
                if joined in rank:
                    heapq.heappush(heap, (rank[joined], left, right, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, joined = heapq.heappop(heap)
            if not parts[left] or not parts[right] or after[left] != right or parts[left] + parts[right] != joined:
                continue
            parts[left], parts[right] = joined, ""
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in parts if p]

    def merged_ids(self, unit: str) -> list[int] | None:
        """As ``merged`` for a short unit, by a table of pairs of ids.

        None where a character is no piece itself, or where several marks meet (their pieces have one score).
        """
        if unit.startswith(MARK + MARK):
            return None
        known, join = self.ids, self.pairs.get
        try:
            ids = [known[c] for c in unit]
        except KeyError:
            return None
        ranks = [join(a << 20 | b, NO_PAIR) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_PAIR:
                break
            i = ranks.index(best)
            new = best & 0xFFFFF
            ids[i] = new
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = join(ids[i - 1] << 20 | new, NO_PAIR)
            if i < len(ranks):
                ranks[i] = join(new << 20 | ids[i + 1], NO_PAIR)
        return ids

    def unit(self, unit: str) -> tuple[bytes, bytes]:
        """Packed ids of a unit, and the packed lengths in bytes of what each covers."""
        found = self.memo.get(unit)
        if found is None:
            ids = self.merged_ids(unit) if len(unit) <= MEMO_CHARS else None
            if ids is not None:
                widths = [self.width[i] for i in ids]
            else:
                ids, widths = [], []
                for part in self.merged(unit):
                    known = self.ids.get(part)
                    raw = part.encode()
                    if known is not None:
                        ids.append(known)
                        widths.append(len(raw))
                    else:
                        ids += [self.bytes[b] for b in raw]
                        widths += [1] * len(raw)
            form = f"<{len(ids)}I"
            found = struct.pack(form, *ids), struct.pack(form, *widths)
            if len(unit) <= MEMO_CHARS:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[unit] = found
        return found

    def encode(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Packed ids with begin and end, and for each the bytes of ``text`` it covers: start and end."""
        source = text.encode()
        normal, place = normalise(source, self.char_map, prefix=self.model.prefix, squeeze=self.model.squeeze)
        memo, unit = self.memo, self.unit
        found = [memo.get(u) or unit(u) for u in self.units.findall(normal.decode())]
        ids = b"".join([struct.pack("<I", self.model.begin), *[f[0] for f in found], struct.pack("<I", self.model.end)])
        ends = np.cumsum(np.frombuffer(b"".join([f[1] for f in found]), "<u4"), dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        size = [len(source)]
        return ids, np.concatenate([[0], place[starts], size]), np.concatenate([[0], place[ends], size])

    def decode(self, packed: bytes) -> str:
        """The text of packed ids: space marks are spaces, the one in front is dropped, bytes are put together."""
        ids = np.frombuffer(packed, "<u4").tolist()
        surface, kinds = self.surface, self.model.kinds
        if not any(kinds[i] in (BYTE, UNKNOWN) for i in set(ids)):
            text = "".join([surface[i] for i in ids])
        else:
            parts: list[str] = []
            run = bytearray()
            for i in [*ids, self.model.end]:
                if kinds[i] == BYTE:
                    run.append(int(self.model.pieces[i][3:5], 16))
                    continue
                if run:
                    parts.append(_characters(bytes(run)))
                    run.clear()
                parts.append(self.model.unknown_text if kinds[i] == UNKNOWN else surface[i])
            text = "".join(parts)
        first = next((i for i in ids if kinds[i] != CONTROL), None)
        if (self.model.prefix or self.model.squeeze) and first is not None and kinds[first] == NORMAL and text.startswith(" "):
            text = text[1:]
        return text


def _characters(raw: bytes) -> str:
    """UTF-8, with one replacement character for each byte that is not part of a character; any number of them."""
    codecs.register_error("one-each", lambda e: ("�", e.start + 1))
    return raw.decode(errors="one-each")


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids, starts, ends.

    ``ids`` are packed as little-endian unsigned 32-bit integers, with the model's begin and end ids; ``starts`` and
    ``ends`` (array<int>) give for each id the bytes of the text's UTF-8 that it stands for, empty for begin and end.
    Null and empty texts have begin and end only.  Texts are encoded whole, whatever their length.
    """
    blob = read_model(model_path)
    Model(blob)  # refuse an unfit model here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Model(blob))
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = [codec.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([f[0] for f in found], pa.binary()),
                        _lists([f[1] for f in found]),
                        _lists([f[2] for f in found]),
                    ],
                    ["doc_id", "ids", "starts", "ends"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, starts array<int>, ends array<int>")


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values).astype(np.int32) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def decode(encoded: DataFrame, model_path: str, *, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of its packed ids (null: empty)."""
    blob = read_model(model_path)
    schema = encoded.drop("decoded").schema.add("decoded", "string")
    names = [f.name for f in schema.fields][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Model(blob))
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [codec.decode(x or b"") for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(texts, pa.string())], [*names, "decoded"])

    return encoded.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)
