"""Collocations: word sequences that occur more often than their parts would by chance, by Rabin-Karp fingerprints.

A text's words have two independent 64-bit values each.  Prefix sums of the values times powers of a base give the
polynomial of every n-gram at once (numpy, modulo 2^64): its fingerprint from the first values, its check of 32 bits
from the second.  Tasks aggregate n-grams by fingerprint: how often, the least and the largest check, and a pointer to an
occurrence, the least digest (of 32 bits; it may lead to a few texts) of a text with it.  The shuffle carries such rows of numbers only, and only of n-grams whose
words, then pairs of words, occur often enough themselves; what did is told to tasks by a table of bits of bounded
size, in which a wrong bit costs a row and no result.

Fingerprints that occur often enough are then looked up in the texts pointed to and become words.  Where the checks of all
occurrences are those of that text, they are one phrase.  All others are collisions, whose occurrences are counted again
by their text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questloom.session import stage

#: Fixed: capitals, and what ends a piece.
CAPITALS, ENDS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(CAPITALS + ENDS + b"\t", CAPITALS.lower() + b"\n" * len(ENDS) + b" ")
#: Odd bases of the two polynomials (any would do) and their inverses.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
#: A table of bits has at most 2^MOST_BITS (32 MB); beyond about 2^MOST_BITS / 16 entries it tells less, and no more.
MOST_BITS, CHUNK_BITS = 28, 15
#: Bytes of text hashed at once; a longer text is taken alone.  Words remembered by a task.
AT_ONCE, MEMO = 4 << 20, 500_000
#: Single words meet their candidates in so many places, so that one in very many candidates is not one task's.
SALTS = 16
#: Up to so many languages their totals are sent to the tasks.
MOST_LANGS = 10_000
COUNTED = "n tinyint, fp bigint, a bigint, low bigint, high bigint, doc bigint"


class _Words(dict):
    """Number of each word seen, and its two values; 0 stands for the end of a piece, 1 for no word."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.update({b"\n": 0, b"": 1})
        self.new: list[bytes] = [bytes(32)]
        self.values = np.zeros((0, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(xxhash.xxh3_128_digest(word))
        return number

    def learnt(self) -> np.ndarray:
        if self.new:
            fresh = np.frombuffer(b"".join(self.new), "<u8").reshape(-1, 2)
            self.values = np.concatenate([self.values, fresh])
            self.new = []
        return self.values


class Grams:
    """The n-grams of some texts: for each number of words their places, fingerprints and checks."""

    def __init__(self, texts: Sequence[bytes], langs: Sequence[str], words: _Words, mask: int):
        if len(words) > MEMO:
            words.reset()
        tokens = [t.translate(_TABLE).replace(b"\n", b" \n ").split(b" ") + [b"\n"] for t in texts]
        sizes = [len(t) for t in tokens]
        ids = np.fromiter(map(words.__getitem__, chain.from_iterable(tokens)), np.int64, sum(sizes))
        keep = ids != 1
        self.ids, self.texts = ids[keep], np.repeat(np.arange(len(texts)), sizes)[keep]
        self.tokens, self.kept = tokens, keep
        values = words.learnt()
        of_lang = {x: np.frombuffer(xxhash.xxh3_128_digest(x.encode(), seed=1), "<u8") for x in set(langs)}
        self.salts = np.array([of_lang[x] for x in langs], np.uint64).reshape(-1, 2)
        self.mask = np.uint64(mask)
        size = len(self.ids)
        self.powers, self.sums = [], []
        for i, (base, inverse) in enumerate(zip(BASES, INVERSES)):
            powers = np.full((2, size + 1), 1, np.uint64)
            powers[0, 1:], powers[1, 1:] = base, inverse
            np.cumprod(powers, axis=1, out=powers)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(values[self.ids, i] * powers[1, :size], out=sums[1:])
            self.powers.append(powers[0])
            self.sums.append(sums)
        ends = np.flatnonzero(self.ids == 0)
        #: Words from here to the end of the piece.
        self.room = ends[np.searchsorted(ends, np.arange(size))] - np.arange(size) if size else ends

    def of(self, n: int) -> np.ndarray:
        """The places of all n-grams."""
        return np.flatnonzero(self.room >= n)

    def hashes(self, at: np.ndarray, n: int, which: int) -> np.ndarray:
        """Fingerprints (``which`` 0) or checks (1), of 32 bits, of the n-grams at ``at``."""
        found = (self.sums[which][at + n] - self.sums[which][at]) * self.powers[which][at] ^ self.salts[self.texts[at], which]
        return found & self.mask if which == 0 else found >> np.uint64(32)

    def words(self) -> list[bytes]:
        return list(np.array(list(chain.from_iterable(self.tokens)), object)[self.kept])


class Bits:
    """Which fingerprints are among some; it may say yes too often, never no."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    def has(self, fingerprints: np.ndarray) -> np.ndarray:
        at = _mixed(fingerprints) >> np.uint64(64 - self.bits)
        return (self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(31)) * np.uint64(BASES[0])
    return (values ^ values >> np.uint64(29)) * np.uint64(BASES[1])


def bits_of(fingerprints: DataFrame) -> Bits:
    """The table of bits for the column fp, set chunk by chunk in tasks; the driver gets the bits alone."""
    n = fingerprints.count()
    bits = min(MOST_BITS, max(CHUNK_BITS, int(16 * n).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _mixed(batch.column("fp").to_numpy().view(np.uint64)) >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(CHUNK_BITS)).astype(np.int64)), pa.array((at & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.int64))], ["chunk", "at"])

    def fill(chunk: pa.Table) -> pa.Table:
        table = np.zeros(1 << CHUNK_BITS, np.uint8)
        table[chunk["at"].to_numpy()] = 1
        return pa.table({"chunk": chunk["chunk"].slice(0, 1), "bits": [np.packbits(table, bitorder="little").tobytes()]})

    placed = fingerprints.select("fp").mapInArrow(place, "chunk bigint, at bigint").distinct()
    table = np.zeros(1 << bits - 3, np.uint8)
    width = 1 << CHUNK_BITS - 3
    for row in placed.groupBy("chunk").applyInArrow(fill, "chunk bigint, bits binary").toLocalIterator():
        table[row["chunk"] * width : (row["chunk"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return Bits(bits, table)


def _chunks(batches: Iterator[pa.RecordBatch], words: _Words, mask: int) -> Iterator[tuple[pa.RecordBatch, Grams]]:
    for batch in batches:
        sizes = np.cumsum([0, *[len(v.as_buffer()) for v in batch.column("text")]])
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(sizes, sizes[low] + AT_ONCE, side="right")) - 1)
            part = batch.slice(low, high - low)
            yield part, Grams(part.column("text").to_pylist(), part.column("lang").to_pylist(), words, mask)
            low = high


def _counted(n: int, fp: np.ndarray, check: np.ndarray, doc: np.ndarray, a: np.ndarray | None = None) -> pa.RecordBatch:
    order = np.argsort(fp)
    fp = fp[order]
    starts = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]])) if len(fp) else np.zeros(0, np.int64)
    check, doc = check.view(np.int64)[order], doc[order]
    many = np.diff(np.append(starts, len(fp))) if a is None else np.add.reduceat(a[order], starts)
    columns = [np.full(len(starts), n, np.int8), fp[starts].view(np.int64), many.astype(np.int64)]
    columns += [np.minimum.reduceat(check, starts), np.maximum.reduceat(check, starts), np.minimum.reduceat(doc, starts)] if len(starts) else [np.zeros(0, np.int64)] * 3
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["n", "fp", "a", "low", "high", "doc"])


def frequent(docs: DataFrame, sizes: Sequence[int], least: int, filters: dict[int, Bits], mask: int) -> DataFrame:
    """The stored table ``COUNTED`` of the n-grams of ``sizes`` words that occur ``least`` times or more.

    ``docs`` has doc, lang, text (binary).  ``filters`` say which single words and pairs may do so.  For size 1 there is a
    row of size 0 for each language, too, that counts all words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, filters = _Words(), sent.value
        for part, grams in _chunks(batches, words, mask):
            doc = part.column("doc").to_numpy()
            if 1 in sizes:
                many = np.bincount(grams.texts[grams.of(1)], minlength=len(doc))
                yield _counted(0, grams.salts[:, 0] & grams.mask, grams.salts[:, 1] >> np.uint64(32), doc, many)
            # Whether the smaller n-gram that begins at a place may be frequent.
            may = {}
            for size, bits in filters.items():
                at = grams.of(size)
                may[size] = np.zeros(len(grams.ids) + max(sizes), bool)
                may[size][at] = bits.has(grams.hashes(at, size, 0))
            for n in sizes:
                at = grams.of(n)
                for size, flags in may.items():
                    at = at[reduce(np.logical_and, [flags[at + i] for i in range(n - size + 1)])]
                yield _counted(n, grams.hashes(at, n, 0), grams.hashes(at, n, 1), doc[grams.texts[at]])

    rows = docs.mapInArrow(run, COUNTED).groupBy("n", "fp")
    counted = rows.agg(F.sum("a").alias("a"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("doc").alias("doc"))
    return stage(counted.where((F.col("n") == 0) | (F.col("a") >= least)), "frequent-grams")


def materialise(docs: DataFrame, found: DataFrame, longest: int, mask: int) -> DataFrame:
    """(n, fp, lang, phrase, high): what stands where the pointers of ``found`` lead."""
    wanted = found.groupBy("doc").agg(F.collect_list("fp").alias("fps"))
    # One of all texts alike, however many there are.
    texts = docs.join(wanted.select("doc"), "doc", "left_semi").distinct().join(wanted, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                lang = part.column("lang")[0].as_py()
                grams = Grams(part.column("text").to_pylist(), [lang], words, mask)
                fps = np.unique(part.column("fps").flatten().to_numpy().view(np.uint64))
                tokens = grams.words()
                out: list[tuple] = []
                if len(fps) and (zero := grams.salts[0, 0] & grams.mask) in fps:
                    out.append((0, zero, "", grams.salts[0, 1] >> np.uint64(32)))
                for n in range(1, longest + 1):
                    at = grams.of(n)
                    hashes = grams.hashes(at, n, 0)
                    hit = np.isin(hashes, fps)
                    here, first = np.unique(hashes[hit], return_index=True)
                    at = at[hit][first]
                    for fp, place, check in zip(here, at, grams.hashes(at, n, 1)):
                        out.append((n, fp, b" ".join(tokens[place : place + n]).decode(), check))
                sizes, fp, phrases, checks = zip(*out) if out else ((), (), (), ())
                as_long = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sizes, pa.int8()), as_long(fp), pa.array([lang] * len(out), pa.string()), pa.array(phrases, pa.string()), as_long(checks)],
                    ["n", "fp", "lang", "phrase", "high"],
                )

    return texts.select("doc", "lang", "text", "fps").mapInArrow(run, "n tinyint, fp bigint, lang string, phrase string, high bigint")


def recount(docs: DataFrame, collided: DataFrame, longest: int, least: int, mask: int) -> DataFrame:
    """(lang, n, phrase, a) of all phrases with a fingerprint of ``collided`` (n, fp), counted by their text."""
    sent = docs.sparkSession.sparkContext.broadcast(bits_of(collided))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = _Words(), sent.value
        for part, grams in _chunks(batches, words, mask):
            langs, tokens = part.column("lang").to_pylist(), grams.words()
            salts = grams.salts[:, 0] & grams.mask
            many = np.bincount(grams.texts[grams.of(1)], minlength=len(langs))
            rows = [(0, int(salts[i].view(np.int64)), langs[i], "", int(many[i])) for i in np.flatnonzero(bits.has(salts))]
            for n in range(1, longest + 1):
                at = grams.of(n)
                hashes = grams.hashes(at, n, 0)
                hit = bits.has(hashes)
                for place, fp in zip(at[hit].tolist(), hashes[hit].view(np.int64).tolist()):
                    rows.append((n, fp, langs[grams.texts[place]], b" ".join(tokens[place : place + n]).decode(), 1))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int8(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["n", "fp", "lang", "phrase", "a"])

    rows = docs.mapInArrow(run, "n tinyint, fp bigint, lang string, phrase string, a bigint")
    rows = rows.groupBy("n", "fp", "lang", "phrase").agg(F.sum("a").alias("a")).join(collided, ["n", "fp"], "left_semi")
    return rows.where((F.col("n") == 0) | (F.col("a") >= least)).select("lang", "n", "phrase", "a")


def phrase_counts(docs: DataFrame, *, longest: int = 5, least: int = 100, text_col: str = "text", lang_col: str = "lang", fingerprint_bits: int = 64) -> DataFrame:
    """The stored table (lang, n, phrase, a) of all phrases of 1 to ``longest`` words that occur ``least`` times or more.

    Rows of no words (n = 0) hold the number of all words of a language.  Exact with fingerprints of any width.
    """
    mask = (1 << fingerprint_bits) - 1
    lang, text = F.coalesce(F.col(lang_col), F.lit("und")), F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.shiftrightunsigned(F.xxhash64(lang, text), 32).alias("doc"), lang.alias("lang"), F.encode(text, "UTF-8").alias("text"))
    levels, filters = [], {}
    for sizes in ([1], [2], list(range(3, longest + 1))):
        sizes = [n for n in sizes if n <= longest]
        if sizes:
            levels.append(frequent(docs, sizes, least, filters, mask))
            filters = {sizes[0]: bits_of(levels[-1].where(F.col("n") == sizes[0]))}
    found = reduce(DataFrame.unionByName, levels)
    shown = stage(materialise(docs, found, longest, mask), "phrases")
    same = found.join(shown.withColumnRenamed("high", "check"), ["n", "fp"], "left")
    one = (F.col("low") == F.col("high")) & F.col("check").eqNullSafe(F.col("high"))
    judged = same.groupBy("n", "fp").agg(F.bool_and(one).alias("one"), F.countDistinct("lang", "phrase").alias("texts"))
    judged = judged.select("n", "fp", (F.col("one") & (F.col("texts") == 1)).alias("one"))
    collided = stage(judged.where(~F.col("one")).select("n", "fp"), "collisions")
    verified = shown.select("n", "fp", "lang", "phrase").distinct().join(found.select("n", "fp", "a"), ["n", "fp"])
    verified = verified.join(collided, ["n", "fp"], "left_anti").select("lang", "n", "phrase", "a")
    if not collided.isEmpty():
        verified = verified.unionByName(recount(docs, collided, longest, least, mask))
    return stage(verified, "phrase-counts")


def _salted(part: Column, words: Column) -> Column:
    return F.when(words == 1, F.pmod(F.xxhash64(part), F.lit(SALTS))).otherwise(0).cast("int")


def collocations(docs: DataFrame, *, longest: int = 5, least: int = 100, top: int = 2000, share: int = 100, text_col: str = "text", lang_col: str = "lang", fingerprint_bits: int = 64) -> DataFrame:
    """Each language's first ``top`` collocations: lang, rank, phrase, a, l, r, n, score (numbers bigint).

    Texts (null: empty) have A to Z lowered and are parted at ``ENDS`` into pieces and those at spaces and tabs into words;
    a phrase is words of one piece in a row, overlaps count, and a null language is ``und``.  Candidates are phrases of
    2 to ``longest`` words that occur a >= ``least`` times.  Cut after some words, the first part occurs l and the rest
    r times, and of n words in all that gives floor(1000 a n / (l r)), exact for a below 10^14 and n below 10^17; the cut
    that gives least counts, of several the first.  Dropped are candidates inside a longer one that occurs ``share`` per
    cent as often or more.  Ranks go by score and a, both descending, then by the phrase's bytes.  Rows repeated count each
    time; no rows, or none frequent enough, give none.
    """
    counts = phrase_counts(docs, longest=longest, least=least, text_col=text_col, lang_col=lang_col, fingerprint_bits=fingerprint_bits)
    candidates = counts.where("n >= 2").withColumn("words", F.split("phrase", " "))
    k = F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "n", "a", "words", k)
    first, rest = F.slice("words", F.lit(1), F.col("k")), F.slice("words", F.col("k") + 1, F.col("n") - F.col("k"))
    side = lambda words, name: F.struct(F.array_join(words, " ").alias("part"), F.size(words).alias("size"), F.lit(name).alias("side"))
    parts = cuts.select("lang", "phrase", "n", "a", "k", F.explode(F.array(side(first, "l"), side(rest, "r"))).alias("x"))
    parts = parts.select("lang", "phrase", "n", "a", "k", "x.*").withColumn("salt", _salted(F.col("phrase"), F.col("size")))
    salts = F.when(F.col("n") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = counts.where(F.col("n").between(1, longest - 1)).select("lang", F.col("phrase").alias("part"), F.col("a").alias("of"), F.explode(salts).alias("salt"))
    totals = counts.where("n = 0").select("lang", F.col("a").alias("total"))
    both = parts.join(known, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == "l", F.col("of"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("of"))).alias("r")
    )
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    # One row a language; many only if something else was put there.
    send = F.broadcast if totals.count() <= MOST_LANGS else (lambda table: table)
    both = both.join(send(totals), "lang").withColumn("top", F.lit(1000).cast("decimal(4,0)") * wide("a", 14) * wide("total", 17))
    both = both.withColumn("below", wide("l", 17) * wide("r", 17)).withColumn("score", F.expr("top div below"))
    best = both.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # A longer candidate that holds the phrase and occurs so often has one of one word more in it that does as well.
    longer = parts.where((F.col("size") == F.col("n") - 1) & (F.col("size") > 1)).groupBy("lang", F.col("part").alias("phrase"))
    longer = longer.agg(F.max("a").alias("longer"))
    left = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint"), "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
