"""Packing: differencing against its definition, ids against the library, and every token in one place."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from questloom.llm import packing, queries
from tests.llm.tables import docs_table, empty_docs
from tests.test_registered import FOLDER

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_two_windows_take_the_known_difference():
    # 8, 7, 6, 5, 4: differencing ends with 16 and 14.
    sides = packing.differencing([8, 7, 6, 5, 4], 2)
    sums = [sum(s for s, w in zip([8, 7, 6, 5, 4], sides) if w == k) for k in (0, 1)]
    assert sorted(sums) == [14, 16]


@pytest.mark.parametrize("windows", [1, 3, 16])
def test_windows_are_nearly_equal(windows):
    draw = random.Random(windows)
    sizes = [draw.randint(1, 2047) for _ in range(40 * windows)]
    sums = [0] * windows
    for size, window in zip(sizes, packing.differencing(sizes, windows)):
        sums[window] += size
    assert max(sums) - min(sums) < 60


def test_blocks_keep_all_tokens_and_pad_nothing():
    draw = random.Random(9)
    for n in (0, 1, 2, 7, 300):
        pieces = [packing.Piece(i, 2048 * draw.randint(0, 2), draw.randint(1, 2047)) for i in range(n)]
        windows = packing.pack_block(pieces, 2048)
        lengths = [sum(p.length for p in w) for w in windows]
        assert all(x == 2048 or x & (x - 1) == 0 for x in lengths)
        assert sum(x < 2048 for x in lengths) <= 11
        spans = defaultdict(list)
        for window in windows:
            for doc, start, length in window:
                spans[doc].append((start, start + length))
        for doc, start, length in pieces:
            places = sorted(spans[doc])
            assert places[0][0] == start and places[-1][1] == start + length
            assert all(a[1] == b[0] for a, b in zip(places, places[1:]))


def test_ids_are_those_of_the_library(library):
    draw = random.Random(3)
    letters = list("ab1.,'\n\t    é漢\U0001f600\x1c\x85​×÷ ß") + ["'s", " the", "<|endoftext|>"]
    texts = ["", " ", "  ", "\t", " \n x", "a  b", "a  b", "a 　", "\x00 \x00", "x" * 500, "don't 's  ", "a\r\n b"]
    texts += ["".join(draw.choice(letters) for _ in range(draw.randint(1, 30))) for _ in range(3000)]
    words = packing.Words(PATH)
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(i, "<u4").tolist() for i in words.ids([t.encode() for t in texts])] == [library(t) for t in texts]


def test_small_memo_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 5)
    words = packing.Words(PATH)
    for text in ("the cat sat on the mat", "on the mat the other cat sat", "the cat"):
        assert np.frombuffer(words.ids([text.encode()])[0], "<u4").tolist() == library(text)


def check(rows, texts, library):
    """Pieces against the ids of ``texts`` [(doc_id, text)], which may repeat."""
    want = sorted(((-1 if i is None else i, *library(t or ""), 1) for i, t in texts), key=str)
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        of_doc[-1 if r["doc_id"] is None else r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
    for places in of_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end == 2048 or end < 2048 and end & (end - 1) == 0
    ids_of = defaultdict(list)
    for doc_id, *ids in want:
        ids_of[doc_id].append(ids)
    assert set(ids_of) == set(of_doc)
    for doc_id, pieces in of_doc.items():
        assert sum(len(p[1]) for p in pieces) == sum(map(len, ids_of[doc_id]))
        if len(ids_of[doc_id]) == 1:
            assert sum((p[1] for p in sorted(pieces)), []) == ids_of[doc_id][0]
            assert {p[2] for p in pieces} == {len(ids_of[doc_id][0])}


def test_awkward_table(spark, library):
    docs = docs_table(spark)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(packing.pack(docs, PATH).collect(), texts, library)
    check(packing.pack(docs.repartition(3), PATH, block_windows=2).collect(), texts, library)
    assert packing.pack(empty_docs(spark), PATH).collect() == []


def test_query(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = packing.pack(docs, PATH).collect()
    check(rows, texts, library)
    found = queries.op11_packing(spark, FOLDER).collect()
    want = {(r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in rows}
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in found} == want
