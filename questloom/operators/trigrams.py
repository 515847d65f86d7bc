"""Texts that contain given strings, found by an inverted index of short runs of characters over the words of the texts.

A string without white space that is in a text is in one of its words.  So an index has two levels: the runs (grams) of
each distinct word, and for each word posting blocks of the texts that have it.  A string is looked up by the rarest of its
grams (an equi-join with the words that have them, verified with ``contains``), which gives the words it is in and their
texts.  Grams are as long as the string allows, so that they are in few words.  A set of strings is looked up by its rarest
ones: their postings are intersected until few texts are to be expected, and those texts are verified.
Strings under three characters are looked up by runs of their own length, and what is only white space by the empty word
that every text has.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from questloom.session import path_exists, stage

#: Strings are looked up by so many of their rarest grams at once.
RAREST = 2
#: About so many ids make a posting block.
BLOCK_IDS = 4096
#: Strings are looked up by grams of the longest of these sizes that they have; a stored index has the last one.
SIZES = (8, 5, 3)
#: So many strings that are words of the fewest texts, and so many longest ones, may look up a set.
LOOKED_UP = 3
#: About so many texts share the posting lists that are intersected at once; there are so many such shares at least.
SHARE_IDS, SHARES = 65536, 8
#: Lists are intersected until so few texts are expected, ...
FEW = 2.0
#: ... and while they have at most so many ids for each text expected, as verifying a text takes longer than an id.
WORTH = 64
#: Tables of words and grams up to so many rows travel with the tasks.
SENT_ROWS = 200_000
#: Characters of a word beyond which its runs are taken from a list.
LONG = 200
SPACE = r"[\x20\x09-\x0D]+"


def grams(word: Column, sizes: tuple[int, ...] = (3,)) -> Column:
    """The distinct runs of so many characters in a word; the empty word has the empty run."""

    def runs(n: Column, size: int, run: Callable[[Column, int], Column]) -> Column:
        none = F.array().cast("array<string>")
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda at: run(at, size))).otherwise(none)

    # Counting to a place takes as long as the place is far, so long words become lists of characters.
    short = F.concat(*[runs(F.char_length(word), n, lambda at, size: F.substring(word, at, size)) for n in sizes])

    def listed(chars: Column) -> Column:
        return F.concat(*[runs(F.size(chars), n, lambda at, size: F.concat(*[F.get(chars, at + (j - 1)) for j in range(size)])) for n in sizes])

    long = F.transform(F.array(F.split(word, "")), listed)
    found = F.when(F.char_length(word) <= LONG, short).otherwise(F.get(long, F.lit(0)))
    return F.when(word == "", F.array(F.lit(""))).otherwise(F.array_distinct(found))


def pieces(literals: Column) -> Column:
    """What of some strings lies between white space, each once; the empty string if there is nothing."""
    found = F.array_remove(F.array_distinct(F.split(F.array_join(literals, " "), SPACE)), "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def words_of(texts: DataFrame) -> DataFrame:
    """(id, word): the distinct words of ``texts`` (id, text) and, for every text, the empty one."""
    words = F.array_distinct(F.concat(F.array(F.lit("")), F.split("text", SPACE)))
    return texts.where("text IS NOT NULL").select("id", F.explode(words).alias("word"))


def write_index(texts: DataFrame, path: str, mode: str = "append") -> None:
    """Add ``texts`` to the index at ``path``: posting blocks (word, n, ids) and grams (gram, word).

    Both are in the order they are looked up in, so that a lookup skips files and row groups.
    """
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-texts.count() // BLOCK_IDS))
    listed = words_of(texts).groupBy("word", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    listed = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_list("id").alias("ids")).select("word", "n", "ids")
    listed.repartitionByRange(tasks, "word").sortWithinPartitions("word").write.mode(mode).parquet(f"{path}/words")
    each = words_of(texts).select("word").distinct().select(F.explode(grams(F.col("word"), (1, 2, 3))).alias("gram"), "word")
    each.repartitionByRange(tasks, "gram", "word").sortWithinPartitions("gram").write.mode(mode).parquet(f"{path}/grams")


class Index:
    """A stored index, or the same made of the texts as it is asked."""

    def __init__(self, texts: DataFrame | None = None, spark: SparkSession | None = None, path: str | None = None):
        self.stored = path is not None
        if self.stored:
            self.words, self.grams = spark.read.parquet(f"{path}/words"), spark.read.parquet(f"{path}/grams").distinct()
        else:
            self.words = words_of(texts)

    @property
    def sizes(self) -> tuple[int, ...]:
        return SIZES[-1:] if self.stored else SIZES

    def vocabulary(self) -> DataFrame:
        """(word, n): the distinct words and how many texts have them."""
        return self.words.groupBy("word").agg((F.sum("n") if self.stored else F.count(F.lit(1))).alias("n"))

    def words_with(self, vocabulary: DataFrame, wanted: DataFrame) -> DataFrame:
        """``wanted`` (gram and more) with each word that has the gram."""
        if self.stored:
            return self.grams.select("gram", "word").join(_sent(wanted), "gram")
        # Size by size, as there are few short grams, which are sent to the many places where they are, and many long ones.
        each = []
        for (size,) in wanted.select(F.char_length("gram")).distinct().collect():
            held = vocabulary.where(F.char_length("word") >= size if size else F.col("word") == "")
            held = held.select("word", F.explode(grams(F.col("word"), (size,))).alias("gram"))
            each.append(held.join(_sent(wanted.where(F.char_length("gram") == size)), "gram"))
        return reduce(DataFrame.unionByName, each) if each else vocabulary.join(wanted, F.lit(False)).drop("n")

    def texts_with(self, chosen: DataFrame) -> DataFrame:
        """(needle, id) for the words of ``chosen`` (needle, word), with an id once for each word."""
        found = self.words.join(_sent(chosen), "word")
        return found.select("needle", F.explode("ids").alias("id") if self.stored else "id")


def read_index(spark: SparkSession, path: str) -> Index | None:
    return Index(spark=spark, path=path) if path_exists(spark, f"{path}/words") else None


def _sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def _lookups(sets: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(set, needle): the strings of each set that may look it up.

    Rare strings are seldom words of texts, and long ones seldom in other words.  Strings under three characters, which are
    in most words, look up only sets that have no others.
    """
    every = sets.select("set", F.explode("pieces").alias("needle"))
    every = every.join(vocabulary.withColumnRenamed("word", "needle"), "needle", "left").select(
        "set", F.struct((-F.char_length("needle")).alias("less"), F.coalesce("n", F.lit(0)).alias("n"), "needle").alias("x")
    )
    longest = every.groupBy("set").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    able = F.filter("xs", lambda x: x["less"] <= -3)
    longest = longest.select("set", F.when(F.size(able) > 0, able).otherwise(F.slice("xs", 1, 1)).alias("xs"))
    rarest = F.sort_array(F.transform("xs", lambda x: F.struct(x["n"].alias("n"), x["less"].alias("less"), x["needle"].alias("needle"))))
    first = F.concat(F.slice(rarest["needle"], 1, LOOKED_UP), F.slice("xs.needle", 1, LOOKED_UP))
    return longest.select("set", F.explode(F.array_distinct(first)).alias("needle"))


def _worth_reading(by_number: Column, n_texts: int) -> Column:
    """The first strings of ``by_number`` (n, needle; fewest texts first), until few texts are expected to have them all."""
    first = by_number[0]
    start = F.struct(first["n"].cast("double").alias("expected"), F.array(first["needle"]).alias("taken"))

    def read(state: Column, x: Column) -> Column:
        worth = (state["expected"] > FEW) & (x["n"] <= WORTH * state["expected"])
        expected = state["expected"] * F.least(F.lit(1.0), x["n"] / F.lit(float(n_texts)))
        return F.struct(
            F.when(worth, expected).otherwise(state["expected"]).alias("expected"),
            F.when(worth, F.concat(state["taken"], F.array(x["needle"]))).otherwise(state["taken"]).alias("taken"),
        )

    return F.reduce(F.slice(by_number, 2, 2 * LOOKED_UP), start, read)["taken"]


def _in_all(asking: DataFrame, postings: DataFrame) -> DataFrame:
    """(set, id): the ids that the ``postings`` (needle, share, ids) of all needles of a set have."""
    lists = postings.join(_sent(asking), "needle")
    alone = lists.where("needed = 1").select("set", "ids")
    more = lists.where("needed > 1").groupBy("set", "share")
    more = more.agg(F.collect_list("ids").alias("lists"), F.first("needed").alias("needed")).where("size(lists) = needed")
    common = F.reduce(F.slice("lists", F.lit(2), F.size("lists")), F.col("lists")[0], F.array_intersect)
    return alone.unionByName(more.select("set", common.alias("ids"))).select("set", F.explode("ids").alias("id"))


def containing(
    sets: DataFrame, texts: DataFrame, *, matches: Column | None = None, index: Index | None = None, once: bool = False
) -> DataFrame:
    """(set_key, id) of all ``texts`` (id, text; ids once each) that contain every string of a set.

    ``sets`` has set_key (once each) and literals (array, not empty); null texts contain nothing.  ``matches``, over
    set_key and text, decides instead of the literals, which any match must contain.  ``index`` is one of these texts.
    With ``once``, only the (set_key) that any text contains: those found in a first share of the texts are not looked for
    in the others.
    """
    index = index or Index(texts)
    # Keys can be as long as their strings, so sets go by a number.
    numbered = sets.withColumns({"set": F.monotonically_increasing_id(), "pieces": pieces(F.col("literals"))})
    sets = stage(numbered, "sets")
    if sets.isEmpty():  # nothing to look up, so no text is read
        return sets.select("set_key") if once else sets.select("set_key").join(texts.select("id"), F.lit(False))
    # Shared out by number, as the words are few bytes and their grams much work.
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vocabulary = stage(index.vocabulary().repartition(tasks, "word"), "vocabulary")
    n_texts = max(1, vocabulary.agg(F.max(F.when(F.col("word") == "", F.col("n")))).first()[0] or 0)
    asked = stage(_lookups(sets, vocabulary), "looked-up")
    sizes = F.array("needle")
    for size in reversed(index.sizes):
        sizes = F.when(F.char_length("needle") >= size, grams(F.col("needle"), (size,))).otherwise(sizes)
    needles = stage(asked.select("needle").distinct().select("needle", F.explode(sizes).alias("gram")), "needles")
    # No string is in more words than its rarest gram; a gram that no word has leaves its string without any.
    wanted = stage(needles.select("gram").distinct(), "wanted-grams")
    counts = index.words_with(vocabulary, wanted).groupBy("gram").agg(F.count(F.lit(1)).alias("words"))
    rarest = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("words", F.lit(0)).alias("words"), "gram"))), 1, RAREST)
    rated = needles.join(counts, "gram", "left").groupBy("needle").agg(rarest.alias("rarest")).where(F.col("rarest")[0]["words"] > 0)
    looked_up = stage(rated.select("needle", F.size("rarest").alias("needed"), F.explode("rarest.gram").alias("gram")), "rarest-grams")
    inside = index.words_with(vocabulary, looked_up).groupBy("needle", "word", "needed").agg(F.count(F.lit(1)).alias("found"))
    inside = inside.where(F.contains("word", "needle") & (F.col("found") == F.col("needed"))).select("needle", "word")
    inside = stage(inside.join(vocabulary, "word").select("needle", "word", "n"), "needle-words")
    # No string is in more texts than its words are; one that no word has leaves its sets without any.
    in_texts = asked.join(inside.groupBy("needle").agg(F.sum("n").alias("n")), "needle", "left")
    by_number = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "needle"))).alias("by_number")
    able = in_texts.groupBy("set").agg(by_number).where(F.col("by_number")[0]["n"] > 0)
    able = able.select("set", _worth_reading(F.col("by_number"), n_texts).alias("taken"))
    asking = stage(able.select("set", F.size("taken").alias("needed"), F.explode("taken").alias("needle")), "chosen-sets")
    # Strings first, texts last, so that no text is shuffled with a candidate.
    read = stage(inside.join(asking.select("needle").distinct(), "needle", "left_semi").select("needle", "word"), "read-words")
    shares = max(SHARES, -(-n_texts // SHARE_IDS))
    postings = index.texts_with(read).groupBy("needle", F.pmod(F.xxhash64("id"), F.lit(shares)).alias("share"))
    postings = stage(postings.agg(F.collect_set("id").alias("ids")), "postings")
    verified = F.forall("literals", lambda x: F.contains(F.col("text"), x)) if matches is None else matches

    def hits(asking: DataFrame, postings: DataFrame) -> DataFrame:
        candidates = _in_all(asking, postings).join(sets.select("set", "set_key", "literals"), "set")
        return candidates.join(texts.select("id", "text"), "id").where(verified).select("set_key", "id")

    if not once:
        return hits(asking, postings)
    found = stage(hits(asking, postings.where("share = 0")).select("set_key").distinct(), "found")
    left = stage(asking.join(sets.join(found, "set_key").select("set"), "set", "left_anti"), "left-sets")
    return found.unionByName(hits(left, postings.where("share > 0")).select("set_key").distinct())
