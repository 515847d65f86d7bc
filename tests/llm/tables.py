"""Small tables with what is awkward: nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""

from __future__ import annotations

import random

_draw = random.Random(1)
LONG = " ".join(f"w{_draw.randint(0, 5000)}" for _ in range(30_000)) + "\n" + "x" * 50_000
_prose = [" ".join(f"t{_draw.randint(0, 900)}" for _ in range(80)) for _ in range(6)]


def _doc(doc_id, text, lang="en", source="s0"):
    return {"doc_id": doc_id, "text": text, "lang": lang, "source": source, "n_chars": len(text or "")}


def _near(text, at):
    words = text.split()
    words[at] = "changed"
    return " ".join(words)


DOCS = [
    _doc(1, _prose[0]),
    _doc(2, _prose[0], source="s1"),
    _doc(3, _near(_prose[0], 79)),
    _doc(4, _near(_prose[0], 0), source=None),
    _doc(5, _prose[1], lang=None),
    _doc(5, _prose[2], lang="de", source="s2"),
    _doc(6, _prose[3]),
    _doc(6, _prose[3]),
    _doc(None, _prose[4]),
    _doc(None, None),
    _doc(7, None, source=None),
    _doc(8, ""),
    _doc(9, " \n\t "),
    _doc(10, "one"),
    _doc(11, "one two three"),
    _doc(12, "one two three", source="S1"),
    _doc(13, LONG),
    _doc(14, "a b c a b c a b c"),
    _doc(15, "é😀 \x00 ▁▁ \u00a0 x\r\ny"),
    _doc(16, "word " * 200),
    _doc(-3, _prose[5], source="é"),
]
LABELS = [(1, 1, 0), (5, 0, 0), (5, 1, 0), (6, None, None), (None, 1, 0), (999, 1, 0), (16, 0, 1)]

#: Names that operators use themselves.
CLASHING = "id keep_id group_size kept digest salt node root class_id size draw copies taken target n_words quality stratum mark spans"
_CLASHING = ", ".join(f"{c} string" for c in CLASHING.split())
_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_table(spark):
    rows = [tuple(r.values()) + ("own",) * len(CLASHING.split()) for r in DOCS]
    return spark.createDataFrame(rows, f"{_COLUMNS}, {_CLASHING}")


def empty_docs(spark):
    return docs_table(spark).limit(0)


def labels_table(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def _page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


PAGES = [
    (1, "http://a.org/1", _page("<nav><a>Menu</a></nav><article><h1>T &amp; U</h1><p>One<br>two  three<p>Four</article><footer>F</footer>")),
    (2, "http://a.org/2", None),
    (None, None, _page("<p>No address</p>")),
    (3, "no address", ""),
    (4, "http://b.org", "just text"),
    (4, "http://b.org", "just text"),
    (5, "http://c.org/x", "<div>" * 3000 + "deep" + "</div>" * 10),
    (6, "://", "<article><script>var t='</p>';</script><p>kept</p><section class='comments'><p>lost</p></section><aside>lost</aside></article>"),
]


def pages_table(spark):
    rows = [(*r, "own", "own", "own") for r in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string, address string")
