"""Registered queries for retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questloom.models import letter_counts, overlap_scorer
from questloom.operators.ann import add_to_index, ann_knn, build_vector_index, read_vector_index
from questloom.operators.fusion import rerank, rerank_by_scores, rrf
from questloom.operators.health import corpus_health
from questloom.operators.hybrid import chunk_payload, hybrid_search, semantic_search
from questloom.operators.ingest import render_sentence
from questloom.operators.knn import knn
from questloom.operators.terms import keyword_fallback, prove_absence, term_search
from questloom.plans.record_queries import (
    CORPUS_SQL,
    KNA1_SQL,
    corpus,
    indexed,
    kna1,
    unit_letters_sql,
    vectors,
)
from questloom.plans.registry import query
from questloom.session import new_path
from questloom.sources.tables import table


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """A question per given vector, with a city to find, a country to avoid, and a name to bring back."""
    return vector_questions(spark, folder).join(kna1(spark, folder), F.col("question_id").cast("string") == F.col("kunnr")).select(
        "question_id",
        "vector",
        "ort01",
        "land1",
        "name1",
        F.array(F.col("ort01"), F.concat(F.lit("NOT "), "land1"), F.col("name1")).alias("filters"),
    )


def asked(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).select("question_id", "vector", "filters")


ASKED_SQL = f"""
    SELECT vec_id AS question_id, embedding AS vector, ort01 AS city, land1 AS country, name1 AS name
    FROM embeddings JOIN ({KNA1_SQL}) ON kunnr = CAST(vec_id AS VARCHAR)
"""
FILTERS_SQL = """
    SELECT question_id, 0 AS ordinal, city AS term, false AS negative FROM q
    UNION ALL SELECT question_id, 1, country, true FROM q
    UNION ALL SELECT question_id, 2, name, false FROM q
"""


def dense_sql(k: int, asked: str = "q", stored: str = "c") -> str:
    return f"""
        SELECT * FROM (
          SELECT question_id, kunnr AS id, round(score, 8) AS score,
                 row_number() OVER (PARTITION BY question_id ORDER BY round(score, 11) DESC, kunnr) AS rank
          FROM (SELECT q.question_id, c.kunnr, list_inner_product(
                       CAST(q.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[])) AS score
                FROM {asked} q CROSS JOIN {stored} c WHERE c.vector IS NOT NULL)
        ) WHERE rank <= {k}
    """


LEXICAL_SQL = """
    SELECT question_id, ordinal, id, position,
           row_number() OVER (PARTITION BY question_id ORDER BY ordinal, position) AS rank
    FROM (
      SELECT f.question_id, f.ordinal, c.kunnr AS id,
             row_number() OVER (PARTITION BY f.question_id, f.ordinal ORDER BY c.kunnr) AS position
      FROM f JOIN c ON contains(c.sentence, f.term) WHERE NOT f.negative
    ) WHERE position <= 20
"""
# For each filter the 20 hits that most of the question's filters find, then the closest, then the first keys.
RELEVANT_SQL = """
    SELECT question_id, ordinal, id, position,
           row_number() OVER (PARTITION BY question_id ORDER BY ordinal, position) AS rank
    FROM (
      SELECT f.question_id, f.ordinal, c.kunnr AS id, row_number() OVER (
               PARTITION BY f.question_id, f.ordinal
               ORDER BY n.n_filters DESC,
                        round(list_inner_product(CAST(q.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[])), 11) DESC NULLS LAST, c.kunnr
             ) AS position
      FROM f JOIN c ON contains(c.sentence, f.term) JOIN q ON q.question_id = f.question_id
      JOIN (SELECT f.question_id, c.kunnr, count(DISTINCT f.term) AS n_filters
            FROM f JOIN c ON contains(c.sentence, f.term) WHERE NOT f.negative GROUP BY ALL) n
        ON n.question_id = f.question_id AND n.kunnr = c.kunnr
      WHERE NOT f.negative
    ) WHERE position <= 20
"""
BASE_SQL = f"""
    WITH q AS ({ASKED_SQL}), c AS ({CORPUS_SQL}), f AS ({FILTERS_SQL}),
         dense AS ({dense_sql(20)}), lexical AS ({LEXICAL_SQL}),
         seen AS (SELECT question_id, id, -1 AS ordinal, rank FROM dense
                  UNION ALL SELECT question_id, id, ordinal, rank FROM lexical),
         fused AS (
           SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM (
             SELECT question_id, id, max(ordinal) AS last_seen, round(sum(1.0 / (60.0 + rank)), 12) AS score
             FROM seen GROUP BY question_id, id)
         )
"""
PAYLOAD_SQL = "to_json({'city': c.city, 'kunnr': c.kunnr, 'name': c.name})"


# All given vectors are both the questions and the corpus.
ALL_VECTORS_SQL = """
    WITH q AS (SELECT vec_id AS question_id, embedding AS vector FROM embeddings),
         c AS (SELECT CAST(vec_id AS VARCHAR) AS kunnr, embedding AS vector FROM embeddings)
"""
NEAREST_SQL = f"{ALL_VECTORS_SQL} SELECT question_id, id, score, rank FROM ({dense_sql(20)})"


def vector_questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector")
    )


@query("v1_knn", NEAREST_SQL)
def v1(spark: SparkSession, folder: str) -> DataFrame:
    near = knn(vector_questions(spark, folder), vectors(spark, folder), 20)
    return near.withColumn("score", F.round("score", 8))


@query(
    "v1_knn_small_vectors",
    f"""
    WITH q AS (SELECT vec_id AS question_id, embedding AS vector FROM embeddings),
         c AS (SELECT CAST(vec_id AS VARCHAR) AS kunnr, embedding AS vector FROM embeddings)
    SELECT question_id, id, rank FROM ({dense_sql(5)})
    """,
)
def v1_small(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors a millionth (a power of two) of their length: the order must not change."""

    def scaled(df: DataFrame) -> DataFrame:
        return df.withColumn("vector", F.transform("vector", lambda x: (x * F.lit(2.0**-20)).cast("float")))

    near = knn(scaled(vector_questions(spark, folder)), scaled(vectors(spark, folder)), 5)
    return near.select("question_id", "id", "rank")


@query("v2_ann_full_probe", NEAREST_SQL)
def v2(spark: SparkSession, folder: str) -> DataFrame:
    """The indexed search, probing every cell: equal to the exact one."""
    rows, centroids = indexed(spark, folder, cells=16)
    near = ann_knn(vector_questions(spark, folder), rows, centroids, 20, nprobe=16)
    return near.withColumn("score", F.round("score", 8))


@query("v2_ann_knn", "SELECT count(*) * 20 AS hits, true AS recall_at_least_90_percent FROM embeddings")
def v2_part(spark: SparkSession, folder: str) -> DataFrame:
    """The indexed search by its defaults: how many of the true 20 neighbours of all questions it finds."""
    rows, centroids = indexed(spark, folder, cells=None)
    asked_vectors = vector_questions(spark, folder)
    near = ann_knn(asked_vectors, rows, centroids, 20)
    true = knn(asked_vectors, vectors(spark, folder), 20).select("question_id", "id", F.lit(1).alias("true"))
    counted = true.join(near.select("question_id", "id", F.lit(1).alias("found")), ["question_id", "id"], "left")
    return counted.agg(
        F.count("true").alias("hits"), (F.count("found") >= 0.9 * F.count("true")).alias("recall_at_least_90_percent")
    )


@query("v2_ann_after_ingest", f"{ALL_VECTORS_SQL} SELECT question_id, id, rank FROM ({dense_sql(5)})")
def v2_later(spark: SparkSession, folder: str) -> DataFrame:
    """An index of half the vectors, the other half added to it later: all cells probed, all are found."""
    path, every = new_path(spark, "index"), vectors(spark, folder)
    early = F.col("kunnr").cast("bigint") % 2 == 0
    cells = build_vector_index(every.filter(early), path, 16)
    add_to_index(every.filter(~early), path)
    rows, centroids = read_vector_index(spark, path)
    return ann_knn(vector_questions(spark, folder), rows, centroids, 5, nprobe=cells).select("question_id", "id", "rank")


@query(
    "v3_term_search_all_hits",
    """
    SELECT b.item_id AS question_id, d.doc_id AS id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS rank
    FROM benchmark b JOIN documents d ON contains(d.text, b.text)
    """,
)
def v3_all(spark: SparkSession, folder: str) -> DataFrame:
    """No limit: every document that holds a benchmark passage."""
    items = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("question_id"), F.array("text").alias("filters")
    )
    found = term_search(items, table(spark, folder, "documents"), None, id_col="doc_id", text_col="text")
    return found.select("question_id", "id", "rank")


@query("v3_term_search", f"{BASE_SQL} SELECT * FROM lexical")
def v3(spark: SparkSession, folder: str) -> DataFrame:
    return term_search(asked(spark, folder), corpus(spark, folder))


# Every passage of the benchmark as a term, over every document.
@query(
    "v3_term_search_documents",
    """
    SELECT question_id, ordinal, id, position, position AS rank FROM (
      SELECT b.item_id AS question_id, 0 AS ordinal, d.doc_id AS id,
             row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS position
      FROM benchmark b JOIN documents d ON contains(d.text, b.text)
    ) WHERE position <= 20
    """,
)
def v3_documents(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("question_id"), F.array("text").alias("filters")
    )
    return term_search(items, table(spark, folder, "documents"), id_col="doc_id", text_col="text")


@query(
    "v3_term_wildcards",
    f"""
    WITH q AS ({ASKED_SQL}), c AS ({CORPUS_SQL}), t AS (
      SELECT question_id, 'in ' || substr(city, 1, 2) || '%, NATION__.' AS term FROM q)
    SELECT question_id, 0 AS ordinal, id, position, position AS rank FROM (
      SELECT t.question_id, c.kunnr AS id,
             row_number() OVER (PARTITION BY t.question_id ORDER BY c.kunnr) AS position
      FROM t JOIN c ON c.sentence LIKE '%' || t.term || '%'
    ) WHERE position <= 20
    """,
)
def v3_wildcards(spark: SparkSession, folder: str) -> DataFrame:
    patterns = questions(spark, folder).select(
        "question_id",
        F.array(
            F.concat(F.lit("in "), F.substring(F.col("filters")[0], 1, 2), F.lit("%, NATION__."))
        ).alias("filters"),
    )
    return term_search(patterns, corpus(spark, folder), wildcards=True)


HYBRID_SQL = BASE_SQL.replace(LEXICAL_SQL, RELEVANT_SQL)


def hybrid_check(negative_text: str, base: str = HYBRID_SQL) -> str:
    return f"""
        {base}
        SELECT question_id, id AS kunnr, rank, round(score, 6) AS score, {PAYLOAD_SQL} AS chunk_text
        FROM fused JOIN c ON fused.id = c.kunnr
        WHERE rank <= 20 AND last_seen > coalesce(
          (SELECT max(f.ordinal) FROM f WHERE f.negative AND f.question_id = fused.question_id
             AND contains({negative_text}, f.term)), -2)
    """


def shown(found: DataFrame) -> DataFrame:
    return found.select(
        "question_id", "kunnr", "rank", F.round("score", 6).alias("score"), "chunk_text"
    )


# Exclusions looked up in the payload, which has the city but not the country.
@query(
    "v4_exclude_payload",
    hybrid_check(
        PAYLOAD_SQL,
        HYBRID_SQL.replace("0 AS ordinal, city", "0 AS ordinal, country").replace("1, country, true", "1, city, true"),
    ),
)
def v4(spark: SparkSession, folder: str) -> DataFrame:
    avoiding_city = questions(spark, folder).withColumn(
        "filters", F.array(F.col("land1"), F.concat(F.lit("NOT "), "ort01"), F.col("name1"))
    )
    return shown(hybrid_search(avoiding_city, corpus(spark, folder), negative_on="payload"))


@query("v5_rrf", f"{BASE_SQL} SELECT question_id, id, round(score, 6) AS score, rank FROM fused")
def v5(spark: SparkSession, folder: str) -> DataFrame:
    q, c = asked(spark, folder), corpus(spark, folder)
    return rrf(knn(q, c, 20), term_search(q, c)).withColumn("score", F.round("score", 6))


@query("v6_hybrid_search", hybrid_check("c.sentence"))
def v6(spark: SparkSession, folder: str) -> DataFrame:
    return shown(hybrid_search(asked(spark, folder), corpus(spark, folder)))


@query("v6_hybrid_indexed", hybrid_check("c.sentence"))
def v6_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the dense part read from an index of the stored records, all cells probed."""
    stored, path = corpus(spark, folder), new_path(spark, "index")
    cells = build_vector_index(stored, path, cells=8)
    rows, centroids = read_vector_index(spark, path)
    return shown(
        hybrid_search(
            asked(spark, folder), stored, dense=lambda q, k: ann_knn(q, rows, centroids, k, nprobe=cells)
        )
    )


# Text questions over every customer, embedded on both sides by the same function.
LETTER_CORPUS_SQL = f"""
    SELECT kunnr, sentence, {unit_letters_sql("sentence")} AS vector FROM (
      SELECT kunnr, 'Customer ' || kunnr || ' is named ' || name1 || ' and is located in ' || ort01 || ', '
             || land1 || '.' AS sentence FROM ({KNA1_SQL}))
"""


@query(
    "v7_semantic_search",
    f"""
    WITH q AS (SELECT conv_id * 1000 + turn AS question_id, {unit_letters_sql("text")} AS vector
               FROM conversations),
         c AS ({LETTER_CORPUS_SQL})
    SELECT question_id, id AS kunnr, rank, round(1.0 / (60.0 + rank), 6) AS score FROM ({dense_sql(20)})
    """,
)
def v7(spark: SparkSession, folder: str) -> DataFrame:
    records = render_sentence(kna1(spark, folder)).select(
        "kunnr", F.col("name1").alias("name"), F.col("ort01").alias("city"), "sentence"
    )
    turns = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question")
    )
    return semantic_search(turns, records, letter_counts).select(
        "question_id", "kunnr", "rank", F.round("score", 6).alias("score")
    )


# Every benchmark passage as an intent: documents that have all of its words.
@query(
    "v8_keyword_fallback",
    r"""
    SELECT * FROM (
      SELECT b.item_id AS question_id, d.doc_id AS id,
             row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS position
      FROM (SELECT item_id, list_distinct(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS words
            FROM benchmark) b
      JOIN documents d ON len(list_filter(b.words, lambda w: NOT contains(d.text, w))) = 0
      WHERE len(b.words) > 0
    ) WHERE position <= 5
    """,
)
def v8(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("intent")
    )
    return keyword_fallback(items, table(spark, folder, "documents"), id_col="doc_id", text_col="text")


# Each customer's city and country as an intent, over all customer sentences.
@query(
    "v8_keyword_customers",
    f"""
    WITH s AS ({LETTER_CORPUS_SQL.replace(unit_letters_sql("sentence") + " AS vector", "1 AS one")}),
         i AS (SELECT kunnr AS question_id, ort01, land1 FROM ({KNA1_SQL}))
    SELECT * FROM (
      SELECT question_id, s.kunnr AS id, row_number() OVER (PARTITION BY question_id ORDER BY s.kunnr) AS position
      FROM i JOIN s ON contains(s.sentence, i.ort01) AND contains(s.sentence, i.land1)
    ) WHERE position <= 5
    """,
)
def v8_customers(spark: SparkSession, folder: str) -> DataFrame:
    records = render_sentence(kna1(spark, folder))
    intents = records.select(
        F.col("kunnr").alias("question_id"), F.concat_ws("  ", "ort01", "land1").alias("intent")
    )
    return keyword_fallback(intents, records)


@query(
    "v9_prove_absence",
    r"""
    WITH t AS (SELECT conv_id, turn,
                      list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS words
               FROM conversations)
    SELECT conv_id, turn FROM t
    WHERE len(words) = 0 OR NOT EXISTS (
      SELECT 1 FROM documents d WHERE len(list_filter(t.words, lambda w: NOT contains(d.text, w))) = 0)
    """,
)
def v9(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"),
        "conv_id",
        "turn",
        F.col("text").alias("intent"),
    )
    absent = prove_absence(turns, table(spark, folder, "documents"), id_col="doc_id", text_col="text")
    return absent.select("conv_id", "turn")


@query(
    "v10_rerank",
    f"""
    WITH q AS ({ASKED_SQL}), c AS ({CORPUS_SQL}), dense AS ({dense_sql(20)})
    SELECT question_id, kunnr, rank FROM (
      SELECT d.question_id, d.id AS kunnr, row_number() OVER (
               PARTITION BY d.question_id
               ORDER BY (CAST(c.city = q.city AS INT) + CAST(c.name = q.name AS INT)) DESC, d.rank) AS rank
      FROM dense d JOIN q ON q.question_id = d.question_id JOIN c ON c.kunnr = d.id
    ) WHERE rank <= 3
    """,
)
def v10(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest reranked by a model: here, the share of the asked name and city that a chunk has."""
    q, c = asked(spark, folder), corpus(spark, folder)
    near = knn(q, c, 20)
    candidates = (
        near.drop("score")
        .join(c.select(F.col("kunnr").alias("id"), "kunnr", "name", "city"), "id")
        .withColumn("chunk_text", F.concat_ws(" ", F.replace("name", F.lit("#"), F.lit("")), "city"))
        .join(
            q.select(
                "question_id",
                F.concat_ws(
                    " ", F.replace(F.col("filters")[2], F.lit("#"), F.lit("")), F.col("filters")[0]
                ).alias("question"),
            ),
            "question_id",
        )
    )
    return rerank(candidates, overlap_scorer, 3).select("question_id", "kunnr", "rank")


@query(
    "v11_rerank_by_scores",
    """
    SELECT user_id, event_id, rank FROM (
      SELECT user_id, event_id, row_number() OVER (
               PARTITION BY user_id
               ORDER BY event_type = 'error' DESC, CASE WHEN event_type = 'error' THEN 0 ELSE value END DESC,
                        event_id) AS rank
      FROM events) WHERE rank <= 3
    """,
)
def v11(spark: SparkSession, folder: str) -> DataFrame:
    """Scores that are NaN for some rows: those rank first, equal scores keep their order."""
    scored = table(spark, folder, "events").select(
        F.col("user_id").alias("question_id"),
        "event_id",
        F.col("event_id").alias("rank"),
        F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value")).alias("score"),
    )
    return rerank_by_scores(scored, 3).select(F.col("question_id").alias("user_id"), "event_id", "rank")


@query("v12_chunk_payload", f"SELECT c.kunnr, {PAYLOAD_SQL} AS chunk_text FROM ({CORPUS_SQL}) c")
def v12(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select("kunnr", chunk_payload().alias("chunk_text"))


@query(
    "v13_corpus_health",
    f"""
    WITH c AS ({CORPUS_SQL}), n AS (
      SELECT count(*) AS records, count(DISTINCT kunnr) AS keys, count(*) FILTER (WHERE kunnr IS NULL) AS null_keys,
             count(*) FILTER (WHERE vector IS NULL OR len(vector) <> 64) AS bad_vectors FROM c)
    SELECT 'healthy' AS status, true AS model_ok, true AS corpus_ok, n.* FROM n
    UNION ALL SELECT 'degraded', false, true, n.* FROM n
    UNION ALL SELECT 'unhealthy', true, false, 0, 0, 0, 0
    UNION ALL SELECT 'unhealthy', false, false, 0, 0, 0, 0
    """,
)
def v13(spark: SparkSession, folder: str) -> DataFrame:
    """All four states."""
    states = [
        corpus_health(stored, 64, spark=spark, model_ok=model_ok)
        for stored in (corpus(spark, folder), None)
        for model_ok in (True, False)
    ]
    found = states[0]
    for state in states[1:]:
        found = found.unionByName(state)
    return found.drop("indexed", "cached_answers")
