"""Exact term search: strings and sets of words, looked up in an index of trigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from questloom.functions.text import words
from questloom.operators.relevance import most_relevant
from questloom.operators.trigrams import Index, containing
from questloom.session import stage

# Fixed value: a filter with this prefix excludes.
NOT_PREFIX = "NOT "


def _texts(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return corpus.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _first_by_id(hits: DataFrame, group: str, limit: int | None) -> DataFrame:
    order = Window.partitionBy(group).orderBy("id")
    placed = hits.withColumn("position", F.row_number().over(order))
    return placed if limit is None else placed.filter(F.col("position") <= limit)


def all_term_hits(
    terms: DataFrame,
    corpus: DataFrame,
    *,
    id_col: str = "kunnr",
    text_col: str = "sentence",
    wildcards: bool = False,
    index: Index | None = None,
) -> DataFrame:
    """(term, id): every row that contains each distinct term, or with ``wildcards`` matches it as in LIKE.

    A pattern is looked up by the strings between its wildcards, and tried where they occur.
    """
    distinct = terms.select("term").filter(F.col("term").isNotNull()).distinct()
    literals = F.split("term", "[%_]") if wildcards else F.array("term")
    matches = None
    if wildcards:
        pattern = F.concat(F.lit("%"), F.replace("set_key", F.lit("\\"), F.lit("\\\\")), F.lit("%"))
        matches = F.like(F.col("text"), pattern)
    sets = distinct.select(F.col("term").alias("set_key"), F.array_distinct(literals).alias("literals"))
    if wildcards:  # the empty strings beside wildcards tell nothing if there are others
        some = F.array_remove("literals", "")
        sets = sets.withColumn("literals", F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(""))))
    hits = containing(sets, _texts(corpus, id_col, text_col), matches=matches, index=index)
    return hits.withColumnRenamed("set_key", "term")


def term_hits(
    terms: DataFrame,
    corpus: DataFrame,
    limit: int | None = 20,
    *,
    id_col: str = "kunnr",
    text_col: str = "sentence",
    wildcards: bool = False,
    index: Index | None = None,
) -> DataFrame:
    """(term, id, position): the first ``limit`` rows by id (None: all) that contain each distinct term."""
    hits = all_term_hits(terms, corpus, id_col=id_col, text_col=text_col, wildcards=wildcards, index=index)
    return _first_by_id(hits, "term", limit)


def split_filters(questions: DataFrame) -> DataFrame:
    """One row per filter: question_id, ordinal (from 0), term, negative."""
    negative = F.col("filter").startswith(NOT_PREFIX)
    return questions.select("question_id", F.posexplode("filters").alias("ordinal", "filter")).select(
        "question_id",
        "ordinal",
        F.when(negative, F.substring("filter", F.lit(len(NOT_PREFIX) + 1), F.length("filter")))
        .otherwise(F.col("filter"))
        .alias("term"),
        negative.alias("negative"),
    )


def term_search(
    questions: DataFrame,
    corpus: DataFrame,
    limit: int | None = 20,
    *,
    id_col: str = "kunnr",
    text_col: str = "sentence",
    wildcards: bool = False,
    index: Index | None = None,
) -> DataFrame:
    """Lexical hits of each positive filter: question_id, ordinal, id, position, rank.

    ``rank`` runs on over the filters of a question: the hits of its first
    filter come first.  Matching is case-sensitive and literal; with
    ``wildcards`` a ``%`` or ``_`` in a term acts as in LIKE.  ``index`` is the trigram index of the corpus, if there
    is one.  Ids must be unique.
    """
    positive = split_filters(questions).filter(~F.col("negative")).drop("negative")
    found = term_hits(
        positive, corpus, limit, id_col=id_col, text_col=text_col, wildcards=wildcards, index=index
    )
    order = Window.partitionBy("question_id").orderBy("ordinal", "position")
    return positive.join(found, "term").select(
        "question_id", "ordinal", "id", "position", F.row_number().over(order).alias("rank")
    )


def word_set_hits(
    questions: DataFrame,
    corpus: DataFrame,
    *,
    intent_col: str = "intent",
    id_col: str = "kunnr",
    text_col: str = "sentence",
    index: Index | None = None,
    once: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(question_id, set_key) of questions with words, and (set_key, id) of all rows that contain each set.

    With ``once``, (set_key) of the sets that any row contains, and of equal texts one is looked at.
    """
    listed = F.array_sort(F.array_distinct(words(F.col(intent_col))))
    # Words hold no white space, so joined by spaces they are a key that can be taken apart.
    asked = questions.select("question_id", F.array_join(listed, " ").alias("set_key")).filter("set_key <> ''")
    sets = asked.select("set_key").distinct().withColumn("literals", F.split("set_key", " "))
    texts = _texts(corpus, id_col, text_col)
    if once:
        texts = stage(texts.where("text IS NOT NULL").groupBy("text").agg(F.min("id").alias("id")), "distinct-texts")
    return asked, containing(sets, texts, index=index, once=once)


def keyword_fallback(
    questions: DataFrame,
    corpus: DataFrame,
    limit: int | None = 5,
    *,
    intent_col: str = "intent",
    id_col: str = "kunnr",
    text_col: str = "sentence",
    index: Index | None = None,
) -> DataFrame:
    """(question_id, id, position): the first ``limit`` rows by id (None: all) that contain every word of the intent.

    An intent without words matches nothing.  Intents with the same words are looked for once.  Where the questions and
    the corpus have a ``vector``, the first rows are the closest ones, then those by id.
    """
    asked, hits = word_set_hits(
        questions, corpus, intent_col=intent_col, id_col=id_col, text_col=text_col, index=index
    )
    if limit is not None and "vector" in questions.columns and "vector" in corpus.columns:
        one = asked.join(questions.select("question_id", "vector"), "question_id").withColumn("ordinal", F.lit(0))
        return most_relevant(one, hits, corpus, limit, id_col=id_col).drop("ordinal")
    return asked.join(_first_by_id(hits, "set_key", limit), "set_key").select("question_id", "id", "position")


def prove_absence(
    questions: DataFrame,
    corpus: DataFrame,
    *,
    intent_col: str = "intent",
    id_col: str = "kunnr",
    text_col: str = "sentence",
    index: Index | None = None,
) -> DataFrame:
    """The questions for which no record contains every word of the intent."""
    asked, held = word_set_hits(
        questions, corpus, intent_col=intent_col, id_col=id_col, text_col=text_col, index=index, once=True
    )
    found = asked.join(held, "set_key").select("question_id")
    return questions.join(found, "question_id", "left_anti")
