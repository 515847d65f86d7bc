"""Collocations against plain counting of words."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from questloom.llm import collocations, queries
from tests.llm.tables import docs_table, empty_docs
from tests.test_registered import FOLDER


def brute(docs, longest, least, top):
    """``docs``: (lang, text)."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(words[i : i + n] for i in range(len(words) - n + 1))
    out = []
    for lang, of in counts.items():
        candidates = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        held = defaultdict(int)
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    held[p[i : i + n]] = max(held[p[i : i + n]], a)
        rows = []
        for p, a in candidates.items():
            if held[p] >= a:
                continue
            score, k = min((1000 * a * total[lang] // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def found(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def noisy(seed, n=300):
    draw = random.Random(seed)
    words = ["the", "The", "of", "a", "new", "york", "times", "é", "x\x00", "ﬁn", "don't", " ", "b"]
    ends = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", " ; "]
    langs = ["en", "de", None, "und"]
    out = []
    for _ in range(n):
        text = "".join(draw.choice(words) + draw.choice(ends) for _ in range(draw.randint(0, 60)))
        if draw.random() < 0.3:
            text += " in new york city hall today"
        out.append((draw.choice(langs), text))
    return out + [("en", None), (None, ""), ("fr", " \t")]


@pytest.mark.parametrize("bits", [64, 9, 4])
def test_against_counting(spark, bits):
    """With 4 or 9 bits nearly all fingerprints collide."""
    data = noisy(1)
    df = spark.createDataFrame(data, "lang string, text string").repartition(3)
    got = collocations.collocations(df, longest=5, least=8, top=40, fingerprint_bits=bits)
    assert found(got) == brute(data, 5, 8, 40)


def test_small_chunks_and_memo_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "AT_ONCE", 200)
    monkeypatch.setattr(collocations, "MEMO", 5)
    data = noisy(2)
    df = spark.createDataFrame(data, "lang string, text string").repartition(2)
    assert found(collocations.collocations(df, longest=4, least=5, top=1000)) == brute(data, 4, 5, 1000)


def test_awkward_table(spark):
    docs = docs_table(spark)
    data = [(r["lang"], r["text"]) for r in docs.collect()]
    assert found(collocations.collocations(docs, least=3, top=100)) == brute(data, 5, 3, 100)
    assert collocations.collocations(empty_docs(spark)).collect() == []


def test_numbers_beyond_64_bits(spark):
    """Counts as of a far larger corpus, put in place of the counted ones."""
    big = 3 * 10**13
    rows = [("en", 0, "", 9 * 10**16), ("en", 1, "a", big), ("en", 1, "b", big + 7), ("en", 2, "a b", big - 1)]
    counts = spark.createDataFrame(rows, "lang string, n tinyint, phrase string, a bigint")
    original, collocations.phrase_counts = collocations.phrase_counts, lambda *a, **b: counts
    try:
        (row,) = collocations.collocations(counts).collect()
    finally:
        collocations.phrase_counts = original
    assert row["score"] == 1000 * (big - 1) * 9 * 10**16 // (big * (big + 7))


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("lang", "text").collect()
    got = found(queries.op12_collocations(spark, FOLDER))
    assert got == brute([tuple(d) for d in docs], 5, 100, 2000)
    assert got
