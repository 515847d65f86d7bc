"""Hybrid retrieval: dense and lexical hits, exclusions, fusion, payload."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questloom.operators.fusion import reciprocal_score
from questloom.operators.ingest import BATCH_SIZE, embed
from questloom.operators.knn import knn, top_ranked
from questloom.operators.relevance import most_relevant
from questloom.operators.terms import NOT_PREFIX, all_term_hits, split_filters, term_search
from questloom.operators.trigrams import Index
from questloom.session import stage

# Hits per dense search, per term filter, and after fusion.
DENSE_TOP = 20
TERM_TOP = 20
FUSED_TOP = 20


def chunk_payload() -> Column:
    """The JSON text of a record that is shown to a model: city, key and name."""
    return F.to_json(F.struct(F.col("city"), F.col("kunnr"), F.col("name")))


def exclusions(questions: DataFrame) -> DataFrame:
    """question_id, exclusions: the ``NOT`` filters with their place in the filter list."""
    numbered = F.transform("filters", lambda f, i: F.struct(i.alias("ordinal"), f.alias("filter")))
    negative = F.filter(numbered, lambda e: e["filter"].startswith(NOT_PREFIX))
    terms = F.transform(
        negative,
        lambda e: F.struct(
            e["ordinal"].alias("ordinal"),
            F.substring(e["filter"], F.lit(len(NOT_PREFIX) + 1), F.length(e["filter"])).alias("term"),
        ),
    )
    return questions.select("question_id", terms.alias("exclusions"))


def exclude_terms(hits: DataFrame, questions: DataFrame, text_col: str) -> DataFrame:
    """Drop hits that an exclusion removed after they were last brought in.

    ``hits``: question_id, id, ``last_seen`` (the highest ordinal of a positive
    filter that found the id, -1 for the dense search) and a text column.
    Exclusion n removes what was found before it; a later positive filter can
    bring a record back.
    """
    last_removed = F.aggregate(
        "exclusions",
        F.lit(-2),
        lambda last, e: F.when(
            F.col(text_col).contains(e["term"]), F.greatest(last, e["ordinal"])
        ).otherwise(last),
    )
    return (
        hits.join(exclusions(questions), "question_id", "left")
        .filter(F.col("last_seen") > F.coalesce(last_removed, F.lit(-2)))
        .drop("exclusions")
    )


def lookup(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Fetch corpus columns for hits.

    Spark knows the size of the hits when it comes to the join, and sends them to the corpus if they are small, or
    shuffles both (and splits crowded keys) if not.
    """
    return corpus.join(hits, "id")


def relevant_terms(
    questions: DataFrame, corpus: DataFrame, top: int, *, wildcards: bool = False, index: Index | None = None
) -> DataFrame:
    """Lexical hits like those of ``term_search``, but of each filter the ``top`` most relevant: see ``most_relevant``."""
    positive = split_filters(questions).filter(~F.col("negative") & F.col("term").isNotNull()).drop("negative")
    hits = all_term_hits(positive, corpus, wildcards=wildcards, index=index).withColumnRenamed("term", "set_key")
    asked = positive.withColumnRenamed("term", "set_key").join(questions.select("question_id", "vector"), "question_id")
    found = most_relevant(asked, stage(hits, "term-hits"), corpus, top)
    order = Window.partitionBy("question_id").orderBy("ordinal", "position")
    return found.withColumn("rank", F.row_number().over(order))


def hybrid_search(
    questions: DataFrame,
    corpus: DataFrame,
    *,
    dense_top: int = DENSE_TOP,
    term_top: int | None = TERM_TOP,
    fused_top: int = FUSED_TOP,
    negative_on: str = "sentence",
    wildcards: bool = False,
    dense: Callable[[DataFrame, int], DataFrame] | None = None,
    index: Index | None = None,
) -> DataFrame:
    """question_id, kunnr, rank, score, sentence, chunk_text for each question.

    ``questions``: question_id, vector, filters.  ``corpus``: kunnr, name,
    city, sentence, vector.  Dense and lexical ranks are fused, the top
    ``fused_top`` taken, and only then excluded records dropped, so fewer can
    remain and ranks can have gaps.  ``negative_on`` is the text exclusions
    look at: ``sentence`` or ``payload``.  ``dense`` replaces the exact search,
    e.g. by an indexed one.  Of each filter the ``term_top`` most relevant hits count, wherever in the corpus they lie;
    ``term_top=None`` takes all, by key.  ``index`` is the trigram index of the sentences.  The questions and the corpus are read several
    times: pass stored tables (``semantic_search`` does).
    """
    near = dense(questions, dense_top) if dense else knn(questions, corpus, dense_top)
    if term_top is None:
        lexical = term_search(questions, corpus, None, wildcards=wildcards, index=index)
    else:
        lexical = relevant_terms(questions, corpus, term_top, wildcards=wildcards, index=index)
    seen = (
        near.select("question_id", "id", F.lit(-1).alias("ordinal"), "rank")
        .unionByName(lexical.select("question_id", "id", "ordinal", "rank"))
        .groupBy("question_id", "id")
        .agg(
            F.max("ordinal").alias("last_seen"),
            # The fusion of both lists in the same pass over the hits.
            reciprocal_score().alias("score"),
        )
    )
    fused = top_ranked(seen, fused_top)
    found = lookup(
        fused, corpus.select(F.col("kunnr").alias("id"), "kunnr", "name", "city", "sentence")
    ).withColumn("chunk_text", chunk_payload())
    text = {"sentence": "sentence", "payload": "chunk_text"}[negative_on]
    kept = exclude_terms(found, questions, text)
    return kept.select("question_id", "kunnr", "rank", "score", "sentence", "chunk_text")



def semantic_search(
    questions: DataFrame,
    corpus: DataFrame,
    embedder: Callable,
    *,
    text_col: str = "question",
    batch_size: int = BATCH_SIZE,
    per_task: bool = False,
    **options,
) -> DataFrame:
    """``hybrid_search`` for text questions: question_id, ``text_col`` and (optionally) filters.

    Every question is embedded once, and what the search reads several times is stored.  A corpus without a
    ``vector`` column is embedded as well, by its sentence.
    """
    if "filters" not in questions.columns:
        questions = questions.withColumn("filters", F.array().cast("array<string>"))
    columns = questions.select("question_id", F.col(text_col).alias("question_text"), "filters")
    asked = stage(embed(columns, embedder, "question_text", batch_size, per_task, key_col="question_id"), "asked")
    if "vector" not in corpus.columns:
        corpus = stage(embed(corpus, embedder, "sentence", batch_size, per_task, key_col="kunnr"), "stored")
    return hybrid_search(asked.select("question_id", "vector", "filters"), corpus, **options)
