"""The registered queries for training text on the smallest tables: against their SQL, or against plain Python."""

from __future__ import annotations

import hashlib
import html
import os
import re
import zlib
from collections import Counter

import duckdb
import pytest

from questloom.llm import queries
from tests.test_registered import FOLDER, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = duck.execute(queries.CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_pages(spark, duck):
    found = {r["page_id"]: r["text"] for r in queries.op1_site_style(spark, FOLDER).collect()}
    for page_id, source in duck.execute("SELECT page_id, html FROM pages").fetchall():
        article = re.search("<article>(.*?)</article>", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert found[page_id] == "\n\n".join(b for b in blocks if b)


def test_scores(spark, duck):
    found = queries.op9_quality_net(spark, FOLDER).collect()
    labels = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in found if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.85 * len(held)


def test_pieces_decode_to_the_text(spark, duck):
    texts = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    for r in queries.op10_sentencepiece(spark, FOLDER).collect():
        assert r["decoded_sha256"] == texts[r["doc_id"]]  # no space mark and no leading oddity in these texts
