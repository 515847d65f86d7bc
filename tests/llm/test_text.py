"""The operators that run Python in tasks, and the pipeline: edge cases, and results against plain versions."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from questloom.llm import ngram_join, pieces, quality_net, site_style, token_counts
from questloom.llm.components import components
from questloom.llm.queries import PIECES, RANKS
from tests.llm.tables import DOCS, PAGES, docs_table, empty_docs, labels_table, pages_table

# --- token counts ---------------------------------------------------------------------------------------------------


def greedy(word, initial, inside):
    at, count = 0, 0
    while at < len(word):
        known = initial if at == 0 else inside
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return 1, 1
        at, count = end, count + 1
    return count, 0


def test_automaton_against_greedy_matching():
    draw = random.Random(3)
    for _ in range(150):
        made = lambda most: {bytes(draw.choices(b"abc", k=draw.randint(1, 5))) for _ in range(most)}
        initial, inside = made(draw.randint(0, 12)), made(draw.randint(0, 12))
        automaton = token_counts.Automaton(initial, inside)
        for _ in range(60):
            word = bytes(draw.choices(b"abc", k=draw.randint(1, 14)))
            found = automaton.count(word)
            assert (found % token_counts.UNKNOWN, found // token_counts.UNKNOWN) == greedy(word, initial, inside)


def test_token_counts(spark):
    initial, inside = token_counts.rank_file_pieces(public_tokenizers.path(RANKS))
    found = token_counts.count_tokens(docs_table(spark), initial, inside).collect()
    a, b = set(initial), set(inside)

    def want(r):
        words = (r["text"] or "").encode().split()
        counts = [greedy(w[:400], a, b) if len(w) > 400 else greedy(w, a, b) for w in words]
        return r["doc_id"], len(words), sum(c for c, _ in counts), sum(u for _, u in counts)

    short = [r for r in DOCS if len(r["text"] or "") < 100_000]
    expected = Counter(map(want, short))
    assert not expected - Counter(map(tuple, found))
    assert len(found) == len(DOCS)
    assert token_counts.count_tokens(empty_docs(spark), initial, inside).count() == 0
    assert {r["n_unknown"] == r["n_words"] for r in token_counts.count_tokens(docs_table(spark), [], []).collect()} == {True}


# --- n-gram join ----------------------------------------------------------------------------------------------------


def grams(text, n=5):
    words = text.encode().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute_classes(docs, threshold=0.8):
    by_text = {}
    for doc_id, text in docs:
        by_text.setdefault(text or "", []).append(doc_id)
    texts = list(by_text)
    sets = [grams(t) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, t in enumerate(texts):
        least.setdefault(find(i), []).extend(d for d in by_text[t] if d is not None)
    return Counter(
        (d, min(least[find(i)], default=None), links[i], len(by_text[t]) - 1) for i, t in enumerate(texts) for d in by_text[t]
    )


def test_near_classes_edges(spark):
    found = ngram_join.near_classes(docs_table(spark)).collect()
    got = Counter((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in found)
    assert got == brute_classes([(r["doc_id"], r["text"]) for r in DOCS])
    assert ngram_join.near_classes(empty_docs(spark)).count() == 0


def test_near_classes_of_crowded_groups(spark):
    """A group of near copies larger than a block, chains of similar texts, and texts with a passage in common."""
    draw = random.Random(9)
    word = lambda: f"v{draw.randint(0, 3000)}"
    base = [word() for _ in range(90)]
    docs = []
    for _ in range(150):
        near = list(base)
        for _ in range(draw.randint(0, 2)):
            near[draw.randrange(90)] = word()
        docs.append(" ".join(near))
    chain = [word() for _ in range(70)]
    for _ in range(40):
        docs.append(" ".join(chain))
        chain = chain[1:] + [word()]
    docs += [" ".join(base[:30] + [word() for _ in range(60)]) for _ in range(60)]
    docs += docs[:5] * 3 + ["", None, "same", "same"]
    table = list(enumerate(docs))
    found = ngram_join.near_classes(spark.createDataFrame(table, "doc_id long, text string"), block_nodes=32).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in found) == brute_classes(table)


def test_drop_near_copies(spark):
    docs = docs_table(spark)
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    classes = {r["class_root"] for r in ngram_join.near_classes(docs).collect()}
    assert kept.count() == len(classes)
    assert {r["doc_id"] for r in kept.where("doc_id IN (1, 2, 3, 4)").collect()} == {1}
    assert ngram_join.drop_near_copies(empty_docs(spark)).count() == 0


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, depth = ngram_join.choose_bands(threshold)
        assert 1 - (1 - threshold**depth) ** bands >= ngram_join.RECALL and bands * depth <= ngram_join.MOST_HASHES


def test_shared_counts():
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 300, draw.integers(0, 120)).astype(np.uint64)) for _ in range(70)]
    counts = ngram_join.shared_counts(sets)
    for i in range(70):
        for j in range(70):
            if i != j:
                assert counts[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_components(spark):
    draw = random.Random(6)
    edges = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == sorted((x, find(x)) for x in linked)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- SentencePiece --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))


def awkward_texts():
    draw = random.Random(1)
    letters = "ab c  ▁éñ\n\t\r😀𐍈tho<>0x41Ω⁇"
    return ["", " ", "▁", "▁▁ ", "<s></s><0x41>", "a" + " " * 40 + "b", "x" * 500, "\x00﻿"] + [
        "".join(draw.choice(letters) for _ in range(draw.randint(0, 70))) for _ in range(1500)
    ]


def test_codec_against_the_library(processor):
    codec = pieces.Codec(pieces.Model(pieces.read_model(public_tokenizers.path(PIECES))))
    for text in [*awkward_texts(), *[r["text"] or "" for r in DOCS]]:
        packed, starts, ends = codec.encode(text)
        want = processor.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(packed, "<u4").tolist() == want
        assert codec.decode(packed) == processor.decode(want)
        raw = text.encode()
        assert b"".join(raw[s:e] for s, e in zip(starts, ends)) == raw
    draw = random.Random(2)
    for _ in range(500):  # any ids, in any order
        ids = [draw.choice([0, 1, 2, draw.randint(3, 258), draw.randint(259, 31_999)]) for _ in range(draw.randint(0, 12))]
        ids = [i for i in ids if i]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == processor.decode(ids)


def test_character_map_against_the_library():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = next(dict(pieces.fields(v)) for k, v in pieces.fields(library.serialized_model_proto()) if k == 3)
    char_map = pieces.CharMap(spec[2])
    draw = random.Random(8)
    for _ in range(1500):
        text = "".join(draw.choice("aＡ①ﾊﾟ ½　 éé​ｶﾞ㌔ \t") for _ in range(draw.randint(0, 20)))
        normal, place = pieces.normalise(text.encode(), char_map, prefix=bool(spec.get(3, 1)), squeeze=bool(spec.get(4, 1)))
        assert normal.decode() == library.normalize(text)
        assert len(place) == len(normal) + 1 and (np.diff(place) >= 0).all() and place[-1] <= len(text.encode())


def test_encode_and_decode(spark, processor):
    model = public_tokenizers.path(PIECES)
    found = pieces.decode(pieces.encode(docs_table(spark), model), model).collect()
    got = Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in found)
    want = Counter()
    for r in DOCS:
        ids = processor.encode(r["text"] or "", add_bos=True, add_eos=True)
        want[(r["doc_id"], np.array(ids, "<u4").tobytes(), processor.decode(ids))] += 1
    assert got == want
    assert pieces.decode(pieces.encode(empty_docs(spark), model), model).count() == 0


# --- classifier -----------------------------------------------------------------------------------------------------


def test_context_sums_against_a_plain_loop(spark):
    texts = ["a b c a", "b b", "", None, "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    plus, minus = quality_net.index_vectors()
    want, buckets = {}, quality_net._Buckets()
    for text in texts:
        s = quality_net.stream(text or "", buckets).tolist()
        for i, here in enumerate(s):
            row = want.setdefault(here, [0] * (quality_net.DIMENSIONS + 1))
            row[0] += 1
            for j in range(max(0, i - quality_net.REACH), min(len(s), i + quality_net.REACH + 1)):
                if j != i:
                    row[1 + plus[s[j]]] += 1
                    row[1 + minus[s[j]]] -= 1
    got = {r[0]: list(r[1:]) for r in quality_net.context_sums(docs).collect()}
    assert got == want


def test_classifier_learns_and_is_calibrated(spark):
    draw = random.Random(4)
    good = lambda: " ".join(draw.choice(["the", "cat", "sat", "on", "mat"]) for _ in range(40))
    bad = lambda: " ".join(draw.choice(["BUY!!", "NOW!!", "$$$", "FREE!!"]) for _ in range(40))
    docs = [(i, bad() if i % 4 == 0 else good()) for i in range(600)]
    noisy = {i: (i % 4 != 0) != (i % 10 == 7) for i, _ in docs}  # a tenth of the labels is wrong
    labels = spark.createDataFrame([(i, int(v)) for i, v in noisy.items()], "doc_id long, quality int")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in quality_net.classify(table, labels, F.col("doc_id") % 5 != 0).collect()}
    held = [i for i in found if i % 5 == 0]
    assert sum((found[i] >= 0.5) == (i % 4 != 0) for i in held) >= 0.95 * len(held)
    assert abs(sum(found.values()) / len(found) - sum(noisy.values()) / len(noisy)) < 0.1
    again = quality_net.classify(table.repartition(3), labels, F.col("doc_id") % 5 != 0).collect()
    assert all(abs(r["score"] - found[r["doc_id"]]) < 1e-4 for r in again)


def test_scores_do_not_depend_on_partitions(spark):
    draw = random.Random(8)
    kinds = [["the", "cat", "Sat", "on", "mat"], ["BUY!!", "NOW", "$$$", "free", "x" * 500]]
    docs = [(i, " ".join(draw.choice(kinds[i % 2]) for _ in range(draw.randint(0, 60)))) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, quality int")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = [
        {r["doc_id"]: r["score"] for r in quality_net.classify(table.repartition(n), labels, F.col("doc_id") % 5 != 0).collect()}
        for n in (1, 3, 17)
    ]
    assert all(abs(found[0][i] - other[i]) < 1e-6 for other in found[1:] for i in found[0])


def test_document_vectors_and_scores_plainly(spark):
    """Mean and spread word by word, for texts with long words, too, and the network's formula on them."""
    texts = ["Ab cd 12 12 ef", "", "x" * 300 + "0" + " x", None, "Ab " * 50, "漢" * 1000 + "1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vectors = quality_net.word_vectors(quality_net.context_sums(docs))
    assert quality_net.shape("x" * 300 + "0") == "a0" and quality_net.shape("漢" * 1000 + "1") == "a0"
    got = {r["doc_id"]: r["features"] for r in quality_net.features(docs, vectors).collect()}
    dims = quality_net.DIMENSIONS
    for i, text in enumerate(texts):
        s = quality_net.stream(text or "", quality_net._Buckets()).tolist()
        want = []
        for part in ([b for b in s if b < quality_net.WORDS], [b for b in s if b >= quality_net.WORDS]):
            columns = [[vectors[b][d] / quality_net.STEPS for b in part] or [0.0] for d in range(dims)]
            means = [sum(c) / len(c) for c in columns]
            want += means + [max(sum(x * x for x in c) / len(c) - m * m, 0) ** 0.5 for c, m in zip(columns, means)]
        assert np.allclose(got[i], want, atol=2e-6)
    x, y = np.array([got[i] for i in range(len(texts))] * 4), np.array([0, 1, 1, 0, 1, 0] * 4)
    network = quality_net.fit(x, y)
    for row, score in zip(x, network.score(x)):
        hidden = [max(0.0, sum((v - m) / s * w for v, m, s, w in zip(row, network.middle, network.scale, column)) + b) for column, b in zip(network.w1.T, network.b1)]
        z = (sum(h * w for h, w in zip(hidden, network.w2)) + float(network.b2)) / network.temperature
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9


def test_repeated_labelled_ids_count_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c d")] * 50 + [(2, "e f")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality_net.classify(docs, labels, F.lit(True)).count() == 101


def test_classifier_edges(spark):
    found = quality_net.classify(docs_table(spark), labels_table(spark), F.lit(True)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in DOCS)
    assert all(0 <= r["score"] <= 1 for r in found)
    unlabelled = quality_net.classify(docs_table(spark), labels_table(spark).limit(0), F.lit(True)).collect()
    assert {r["score"] for r in unlabelled} == {0.5}
    assert quality_net.classify(empty_docs(spark), labels_table(spark), F.lit(True)).count() == 0


# --- pages ----------------------------------------------------------------------------------------------------------


def test_main_text_edges(spark):
    found = site_style.extract(pages_table(spark)).collect()
    assert len(found) == len(PAGES)
    text = {r["page_id"]: r["text"] for r in found}
    assert text[1] == "T & U\n\nOne two three\n\nFour"
    assert text[2] == "" and text[3] == "" and text[4] == "just text" and text[5] == "deep" and text[6] == "kept"
    assert text[None] == "No address"
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert site_style.extract(pages_table(spark).limit(0)).count() == 0


def site(count):
    """Pages without article or telling tags: what they share is furniture."""
    pages = []
    for i in range(count):
        paragraphs = "".join(f"<p>Own words {i} {k} here.</p>" for k in range(2 + i % 3))
        html = f"<html><body><div><span>Home</span><b>About us</b></div><div>{paragraphs}</div><div><i>All rights kept</i></div></body></html>"
        pages.append((i, f"http://site.net/{i}", html))
    pages.append((900, "http://other.net/", "<html><body><div><span>Home</span></div></body></html>"))
    return pages


@pytest.mark.parametrize("most_sent", [10**6, 0])
def test_style_trees_cut_what_pages_share(spark, most_sent):
    table = spark.createDataFrame(site(30), "page_id long, url string, html string")
    for r in site_style.extract(table, most_sent=most_sent).collect():
        if r["page_id"] == 900:
            assert r["text"] == "Home" and r["n_removed"] == 0  # alone on its host
        else:
            i = r["page_id"]
            assert r["text"] == "\n\n".join(f"Own words {i} {k} here." for k in range(2 + i % 3))
            assert r["n_removed"] == 2


def test_importance_against_its_definition(spark):
    rows = [(1, 0, 5)] * 4 + [(2, 1, v) for v in (7, 7, 7, 8)] + [(3, 1, v) for v in (1, 2, 3)] + [(4, 0, 1), (4, 0, 2), (5, 0, 9)]
    table = spark.createDataFrame(rows, "place long, kind int, value long")
    got = {r["place"]: r["importance"] for r in site_style.importance(table).collect()}
    content = 1 - (np.log(3) + np.log(1)) / 2 / np.log(4)
    assert got == {1: 0.0, 2: pytest.approx(content, abs=1e-5)}  # 3 and 4 differ on every page, 5 has one page


def test_articles_keep_what_repeats(spark):
    body = "<nav><a>x</a></nav><article class='post'><header><h1>Title</h1></header><p>Same &amp; same&am</p><div class='ad'>no</div><form>no</form></article><div class='sidebar'>no</div>"
    table = spark.createDataFrame([(i, f"http://a.net/{i}", f"<body>{body}</body>") for i in range(20)], "page_id long, url string, html string")
    assert {r["text"] for r in site_style.extract(table).collect()} == {"Title\n\nSame & same&am"}


def texts_of(spark, bodies):
    table = [(i, f"http://site.net/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    found = site_style.extract(spark.createDataFrame(table, "page_id long, url string, html string")).collect()
    return {r["page_id"]: r["text"] for r in found}


def own_words(i, k):
    return f"Own words {i} {k} that this page alone has, and some more of them."


def test_repeated_block_inside_articles_is_cut(spark):
    """Known by the tree alone; the same article on all pages stays, and so do the parts of tables and of sentences."""
    notice = "<div class='box'><p>Get our letter</p><p>every week</p></div>"
    table = "<table><tr><td>Price</td></tr><tr><td>{}</td></tr></table>"
    got = texts_of(spark, [f"<article><p>{own_words(i, 0)} <b>Note</b></p>{notice}<p>{own_words(i, 1)}</p>{table.format(i)}</article>" for i in range(20)])
    assert got == {i: f"{own_words(i, 0)} Note\n\n{own_words(i, 1)}\n\nPrice\n\n{i}" for i in range(20)}
    versions = [f"<article><p>{own_words(i, 0)}</p><p>{own_words(i, 1)}</p><p>{own_words(0, 2)}</p></article>" for i in range(2)]
    others = [f"<article><h2>{own_words(i, 0)}</h2></article>" for i in range(8)]
    assert texts_of(spark, versions + others)[1] == "\n\n".join([own_words(1, 0), own_words(1, 1), own_words(0, 2)])
    same = texts_of(spark, [f"<article><p>{own_words(0, 0)}</p>{notice}</article>"] * 20)
    assert set(same.values()) == {f"{own_words(0, 0)}\n\nGet our letter\n\nevery week"}


@pytest.mark.parametrize("story", ["<main>{}</main>", "<div class='story'>{}</div>"])
def test_teaser_articles_beside_the_text(spark, story):
    cards = "".join(f"<article><a href='/{k}'>Teaser number {k}</a></article>" for k in range(3))
    paragraphs = [[own_words(i, k) for k in range(4)] for i in range(20)]
    got = texts_of(spark, [story.format("".join(f"<p>{x}</p>" for x in p)) + f"<div>{cards}</div>" for p in paragraphs])
    assert got == {i: "\n\n".join(p) for i, p in enumerate(paragraphs)}


@pytest.mark.parametrize("wrap", ["<div class='social-history'>{}</div>", "<form id='page'>{}</form>"])
def test_noisy_name_around_all_of_the_text(spark, wrap):
    paragraphs = [[own_words(i, k) for k in range(4)] for i in range(20)]
    menu = "<div class='nav'><a>Home</a></div>"
    got = texts_of(spark, [menu + wrap.format("".join(f"<p>{x}</p>" for x in p) + "<div class='share'>Tell others</div>") for p in paragraphs])
    assert got == {i: "\n\n".join(p) for i, p in enumerate(paragraphs)}


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_stages_on_awkward_documents(spark, path):
    folder = path()
    docs_table(spark).write.parquet(f"{folder}/documents.parquet")
    labels_table(spark).write.parquet(f"{folder}/labels.parquet")
    docs, columns = spark.read.parquet(f"{folder}/documents.parquet"), docs_table(spark).columns
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = apply(spark, docs, folder)
        assert docs.columns == columns, name
        docs.write.parquet(f"{folder}/{name.split()[0]}")
        docs = spark.read.parquet(f"{folder}/{name.split()[0]}")
    left = {r["doc_id"] for r in docs.collect()}
    # Kept by the rules are the texts of fifty words and more; of the copies 1 and 2 stays 2, of the near copies the least.
    assert left <= {2, 3, 4, 5, 6, 13, -3, None}
    assert not ({3, 4} & left)
    for empty in (docs.limit(0),):
        for _, apply in corpus_pipeline.STAGES:
            assert apply(spark, empty, folder).count() == 0


def test_pipeline_against_brute_force(spark, path, processor):
    """The near copies' classes and the encoding, checked by hand on what the stages before them keep."""
    draw = random.Random(12)
    text = lambda: " ".join(f"u{draw.randint(0, 4000)}" for _ in range(70))
    docs = [(i, text(), "en", f"s{i % 4}", 0) for i in range(120)]
    docs += [(200 + i, docs[i][1], "en", "s1", 0) for i in range(10)]
    docs += [(300 + i, docs[20 + i][1].replace("u", "v", 1), "en", "s2", 0) for i in range(10)]
    docs += [(400, "too short", "en", "s0", 0), (401, "same same " * 60, "en", "s0", 0), (402, None, "en", "s0", 0)]
    folder = path()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels_table(spark).limit(0).write.parquet(f"{folder}/labels.parquet")
    found = corpus_pipeline.run(spark, folder).collect()
    stay = set(range(10, 120)) | set(range(200, 210))
    kept = {i: t for i, t, *_ in docs if i in stay}
    from questloom.llm.mixing import mix

    rows = spark.createDataFrame([(d[0], d[1], d[3]) for d in docs if d[0] in stay], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mix(rows).collect()}
    assert Counter(r["doc_id"] for r in found) == Counter({i: n for i, n in copies.items() if n})
    for r in found:
        ids = processor.encode(kept[r["doc_id"]], add_bos=True, add_eos=True)
        assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes() and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(kept[r["doc_id"]].encode()).hexdigest()


def test_rank_file_pieces(tmp_path):
    tokens = [b"a", b" b", b"  c", b"\n", b" ", b"d e", b" f\n"]
    file = tmp_path / "ranks"
    file.write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate(tokens)))
    assert token_counts.rank_file_pieces(str(file)) == ([b"b"], [b"a"])


def test_decoding_many_wrong_bytes():
    codec = pieces.Codec(pieces.Model(pieces.read_model(public_tokenizers.path(PIECES))))
    wrong = next(i for i, p in enumerate(codec.model.pieces) if p == "<0xFF>")
    first = next(i for i, p in enumerate(codec.model.pieces) if p == "<0xC3>")
    second = next(i for i, p in enumerate(codec.model.pieces) if p == "<0xA9>")
    ids = [wrong] * 30_000 + [first, second] + [first] * 3
    assert codec.decode(np.array(ids, "<u4").tobytes()) == "\ufffd" * 30_000 + "é" + "\ufffd" * 3
