"""Registered queries for batch question answering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from questloom.functions import prompts as P
from questloom.functions.replies import ANSWER_REPLY, parse_reply
from questloom.models import letter_counts, rule_model
from questloom.operators.answers import (
    answer_questions,
    apply_model,
    as_records,
    build_answer_prompt,
    build_prompts,
    resolve_intent,
    resolve_route,
    remember,
    route_and_answer,
    run_statements,
    second_chance,
    settle,
    text_to_sql,
    validate_questions,
    verify_grounding,
)
from questloom.operators.hybrid import chunk_payload
from questloom.operators.ingest import corpus_columns, embed, render_sentence
from questloom.operators.knn import knn
from questloom.operators.ledger import prompt_key, read_ledger
from questloom.operators.reuse import retain_recent, reuse_exact, reuse_similar
from questloom.plans.record_queries import CORPUS_SQL, KNA1_SQL, SPACE_SQL, corpus, kna1, unit_letters_sql
from questloom.plans.registry import query
from questloom.plans.retrieval_queries import ASKED_SQL, LETTER_CORPUS_SQL, PAYLOAD_SQL, asked, dense_sql
from questloom.session import new_path, stage
from questloom.sources.corpus import read_corpus, write_corpus
from questloom.sources.tables import table
from questloom.streaming.question_stream import read_question_stream, stream_questions

TABLE_TEXT = P.describe_table(
    "kna1", T.StructType([T.StructField(c, T.StringType()) for c in ("kunnr", "name1", "ort01", "land1")])
)


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trimmed_sql(text: str) -> str:
    return rf"regexp_replace({text}, '\A{SPACE_SQL}+|{SPACE_SQL}+\z', '', 'g')"


def ask_sql(question: str) -> str:
    return f"""chr(10) || 'Question: "' || {question} || '"' || chr(10) || 'Reply: '"""


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "role", F.col("text").alias("question")
    )


TURNS_SQL = "SELECT conv_id * 1000 + turn AS question_id, role, text AS question FROM conversations"


@query(
    "a1_validate_questions",
    f"""
    SELECT doc_id AS question_id, CASE WHEN t = '' THEN 'EMPTY' WHEN strlen(t) > 4096 THEN 'TOO_LONG' ELSE 'OK' END
           AS verdict, md5(t) AS digest
    FROM (SELECT doc_id, {trimmed_sql("text")} AS t FROM documents)
    """,
)
def a1(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(
        F.col("doc_id").alias("question_id"), F.col("text").alias("question")
    )
    return validate_questions(documents, 4096).select("question_id", "verdict", F.md5("question").alias("digest"))


@query(
    "a2_build_prompts",
    " UNION ALL ".join(
        f"SELECT question_id, '{kind}' AS kind, md5({literal(task)} || {ask_sql('question')}) AS digest FROM ({TURNS_SQL})"
        for kind, task in (
            ("route", P.ROUTE_TASK + TABLE_TEXT),
            ("sql", P.SQL_TASK + TABLE_TEXT),
            ("intent", P.INTENT_TASK),
        )
    ),
)
def a2(spark: SparkSession, folder: str) -> DataFrame:
    source = turns(spark, folder)
    every = [
        build_prompts(source, kind, TABLE_TEXT).select(
            "question_id", F.lit(kind).alias("kind"), F.md5("prompt").alias("digest")
        )
        for kind in ("route", "sql", "intent")
    ]
    return every[0].unionByName(every[1]).unionByName(every[2])


def near_chunks(spark: SparkSession, folder: str, k: int = 3) -> DataFrame:
    """The ``k`` nearest records of every question as chunks."""
    stored = corpus(spark, folder)
    return (
        knn(asked(spark, folder), stored, k)
        .join(stored.select(F.col("kunnr").alias("id"), "kunnr", "name", "city"), "id")
        .select("question_id", "rank", F.col("id").alias("chunk_id"), chunk_payload().alias("chunk_text"))
    )


NEAR_SQL = f"""
    q AS ({ASKED_SQL}), c AS ({CORPUS_SQL}),
    near AS (SELECT d.question_id, d.rank, d.id AS chunk_id, CAST({PAYLOAD_SQL} AS VARCHAR) AS chunk_text
             FROM ({dense_sql(3)}) d JOIN c ON c.kunnr = d.id)
"""


@query(
    "a3_answer_prompt",
    f"""
    WITH {NEAR_SQL}, context AS (
      SELECT question_id, string_agg('CHUNK ID: ' || chunk_id || chr(10) || 'TEXT: ' || chunk_text
                                     || chr(10) || chr(10), '' ORDER BY rank) AS body
      FROM near GROUP BY question_id)
    SELECT question_id, md5({literal(P.ANSWER_TASK)} || body || {ask_sql("'Who is ' || name || '?'")}) AS digest
    FROM context JOIN q USING (question_id)
    """,
)
def a3(spark: SparkSession, folder: str) -> DataFrame:
    source = asked(spark, folder).select(
        "question_id", F.concat(F.lit("Who is "), F.col("filters")[2], F.lit("?")).alias("question")
    )
    return build_answer_prompt(source, near_chunks(spark, folder)).select(
        "question_id", F.md5("prompt").alias("digest")
    )


def measuring_model(prompts: list[str]) -> list[str]:
    """Replies with the length of a prompt; refuses a batch that has a system turn in it."""
    if any(p.startswith("system") for p in prompts):
        raise ConnectionError("offline")
    return [str(len(p)) for p in prompts]


@query(
    "a4_apply_model",
    f"""
    SELECT question_id, CASE WHEN role <> 'system' THEN CAST(length(role || ': ' || question) AS VARCHAR) END AS raw,
           CASE WHEN role = 'system' THEN 'offline' END AS model_error
    FROM ({TURNS_SQL})
    """,
)
def a4(spark: SparkSession, folder: str) -> DataFrame:
    source = turns(spark, folder).select("question_id", F.concat_ws(": ", "role", "question").alias("prompt"))
    return apply_model(source, measuring_model, pause=0.0).select("question_id", "raw", "model_error")


def length_model(prompts: list[str]) -> list[str]:
    return [str(len(p)) for p in prompts]


@query(
    "a4_ask_once",
    f"""
    WITH p AS (SELECT question_id, role, role || ': ' || question AS prompt FROM ({TURNS_SQL})),
         seen AS (SELECT DISTINCT prompt FROM p WHERE role = 'user')
    SELECT question_id, CAST(length(prompt) AS VARCHAR) AS raw, seen.prompt IS NOT NULL AS known
    FROM p LEFT JOIN seen USING (prompt)
    """,
)
def a4_once(spark: SparkSession, folder: str) -> DataFrame:
    """All turns as prompts, after the users' turns were asked by an earlier run over the same ledger."""
    prompts = turns(spark, folder).select("question_id", "role", F.concat_ws(": ", "role", "question").alias("prompt"))
    ledger = new_path(spark, "ledger")
    apply_model(prompts.where("role = 'user'"), length_model, pause=0.0, ledger=ledger)
    known = stage(read_ledger(spark, ledger, "").select(F.col("prompt_key").alias("_known")), "known")
    asked = apply_model(prompts, length_model, pause=0.0, ledger=ledger)
    marked = asked.join(known, prompt_key("prompt", "") == F.col("_known"), "left")
    return marked.select("question_id", "raw", F.col("_known").isNotNull().alias("known"))


# Replies in ten forms, the form chosen by the row; the first six are readable.
FORM_SQL = "(conv_id + turn) % 10"


def replies(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").withColumn("form", (F.col("conv_id") + F.col("turn")) % 10)
    fields = [
        (F.col("role") == "user").alias("answer_found"),
        F.col("text").alias("answer"),
        F.col("role").alias("exact_quote"),
        F.col("conv_id").cast("string").alias("source_chunk_id"),
    ]
    plain = F.to_json(F.struct(*fields))
    forms = [
        plain,
        F.concat(F.lit("```json\n"), plain, F.lit("\n```")),
        F.concat(F.lit("```json"), plain, F.lit("```")),
        F.concat(F.lit(" \n```\n"), plain, F.lit("\n``` \n")),
        F.concat(F.lit("```"), plain, F.lit("```")),
        F.to_json(F.struct(*fields, F.col("turn").alias("extra"))),
        F.col("text"),
        F.to_json(F.struct(*fields[:3])),
        F.to_json(F.struct(F.lit("yes").alias("answer_found"), *fields[1:])),
        F.concat(F.lit("["), plain, F.lit("]")),
    ]
    raw = F.element_at(F.array(*forms), (F.col("form") + 1).cast("int"))
    return rows.select("conv_id", "turn", raw.alias("raw"))


@query(
    "a5_parse_reply",
    f"""
    SELECT conv_id, turn, CASE WHEN {FORM_SQL} < 6 THEN role = 'user' END AS answer_found,
           CASE WHEN {FORM_SQL} < 6 THEN text END AS answer, CASE WHEN {FORM_SQL} < 6 THEN role END AS exact_quote,
           CASE WHEN {FORM_SQL} < 6 THEN CAST(conv_id AS VARCHAR) END AS source_chunk_id
    FROM conversations
    """,
)
def a5(spark: SparkSession, folder: str) -> DataFrame:
    return replies(spark, folder).withColumn("reply", parse_reply(F.col("raw"), ANSWER_REPLY)).select(
        "conv_id", "turn", "reply.*"
    )


@query(
    "a6_resolve_route",
    f"""
    SELECT question_id, CASE WHEN role = 'system' THEN 'SEMANTIC_FALLBACK' WHEN role = 'user' AND question_id % 3 = 0
                             THEN 'SQL' ELSE 'SEMANTIC' END AS route
    FROM ({TURNS_SQL})
    """,
)
def a6(spark: SparkSession, folder: str) -> DataFrame:
    """User turns get a JSON reply (SQL, sql or SEMANTIC), assistant turns prose, system turns no model."""
    kinds = F.element_at(
        F.array(F.lit("SQL"), F.lit("sql"), F.lit("SEMANTIC")), (F.col("question_id") % 3 + 1).cast("int")
    )
    source = turns(spark, folder).select(
        "question_id",
        F.when(F.col("role") == "user", F.to_json(F.struct(kinds.alias("route"))))
        .when(F.col("role") == "assistant", F.col("question"))
        .alias("raw"),
        F.when(F.col("role") == "system", "down").alias("model_error"),
    )
    return resolve_route(source).select("question_id", "route")


@query(
    "a7_resolve_intent",
    f"""
    SELECT question_id, CASE WHEN role = 'user' THEN 'about ' || question ELSE question END AS intent,
           CASE WHEN role = 'user' THEN 'NOT ' || question_id || '|x' ELSE '' END AS filters
    FROM ({TURNS_SQL})
    """,
)
def a7(spark: SparkSession, folder: str) -> DataFrame:
    reply = F.struct(
        F.concat(F.lit("about "), "question").alias("intent"),
        F.array(F.concat(F.lit("NOT "), "question_id"), F.lit("x")).alias("filters"),
    )
    source = turns(spark, folder).select(
        "question_id",
        "question",
        F.when(F.col("role") == "user", F.to_json(reply)).otherwise(F.col("question")).alias("raw"),
        F.when(F.col("role") == "system", "down").alias("model_error"),
    )
    return resolve_intent(source).select(
        "question_id", "intent", F.array_join("filters", "|").alias("filters")
    )


@query(
    "a8_verify_grounding",
    """
    WITH a AS (
      SELECT doc_id, doc_id % 5 <> 3 AS answer_found,
             CASE doc_id % 5 WHEN 1 THEN '§' || string_split(text, chr(10))[-1] WHEN 4 THEN ''
                             ELSE string_split(text, chr(10))[-1] END AS quote,
             CASE WHEN doc_id % 5 = 2 THEN -1 ELSE doc_id END AS cited
      FROM documents)
    SELECT a.doc_id AS question_id, CASE WHEN NOT answer_found THEN 'NOT_FOUND' WHEN d.doc_id IS NULL THEN 'UNKNOWN_CHUNK'
             WHEN NOT contains(d.text, quote) THEN 'HALLUCINATED' ELSE 'VERIFIED' END AS verdict
    FROM a LEFT JOIN documents d ON d.doc_id = a.cited AND d.doc_id = a.doc_id
    """,
)
def a8(spark: SparkSession, folder: str) -> DataFrame:
    """Every document is quoted by its last line: as it is, altered, from a wrong chunk, not at all, empty."""
    documents = table(spark, folder, "documents")
    last = F.element_at(F.split("text", "\n"), -1)
    form = F.col("doc_id") % 5
    answers = documents.select(
        F.col("doc_id").alias("question_id"),
        (form != 3).alias("answer_found"),
        F.when(form == 1, F.concat(F.lit("§"), last)).when(form == 4, "").otherwise(last).alias("exact_quote"),
        F.when(form == 2, "-1").otherwise(F.col("doc_id").cast("string")).alias("source_chunk_id"),
    )
    chunks = documents.select(
        F.col("doc_id").alias("question_id"),
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.col("text").alias("chunk_text"),
    )
    return verify_grounding(answers, chunks).select("question_id", "verdict")


def canned(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts over near chunks with replies by label: down, grounded, invented, or not found."""
    source = asked(spark, folder).select("question_id", F.col("filters")[2].alias("question"))
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("question_id"), "label")
    shown = build_answer_prompt(source, near_chunks(spark, folder)).join(labels, "question_id")
    form = F.col("label") % 4
    first = F.element_at("chunks", 1)
    reply = F.struct(
        (form != 3).alias("answer_found"),
        F.when(form != 3, F.concat(F.lit("It is "), first["chunk_id"])).otherwise("").alias("answer"),
        F.when(form == 1, first["chunk_text"]).when(form == 2, "never said").otherwise("").alias("exact_quote"),
        F.when(form != 3, first["chunk_id"]).otherwise("").alias("source_chunk_id"),
    )
    return shown.select(
        "question_id",
        "question",
        F.col("question").alias("intent"),
        "chunks",
        "prompt",
        F.when(form != 0, F.to_json(reply)).alias("raw"),
        F.when(form == 0, "timeout").alias("model_error"),
    )


CANNED_SQL = f"""
    WITH {NEAR_SQL}, told AS (
      SELECT e.vec_id AS question_id, e.label % 4 AS form, q.name,
             max(n.chunk_id) FILTER (WHERE n.rank = 1) AS top_id, max(n.chunk_text) FILTER (WHERE n.rank = 1) AS top_text,
             string_agg(n.chunk_id || '=' || n.chunk_text, ';' ORDER BY n.rank) AS listed
      FROM embeddings e JOIN q ON q.question_id = e.vec_id JOIN near n ON n.question_id = e.vec_id
      GROUP BY e.vec_id, e.label, q.name)
"""


@query(
    "a9_degrade",
    f"""
    {CANNED_SQL}
    SELECT question_id, ['DEGRADED', 'VERIFIED', 'HALLUCINATED', 'NOT_FOUND'][form + 1] AS status, form = 0 AS degraded,
           CASE form WHEN 1 THEN 'It is ' || top_id WHEN 3 THEN '' END AS answer,
           CASE WHEN form = 0 THEN 'LLM is offline or timed out: timeout' END AS message,
           CASE WHEN form = 0 THEN listed ELSE '' END AS listed
    FROM told
    """,
)
def a9(spark: SparkSession, folder: str) -> DataFrame:
    listed = F.transform("retrieved_chunks", lambda c: F.concat(c["chunk_id"], F.lit("="), c["content"]))
    return settle(canned(spark, folder)).select(
        "question_id", "status", "degraded", "answer", "message", F.array_join(listed, ";").alias("listed")
    )


@query(
    "a10_second_chance",
    f"""
    {CANNED_SQL}, hit AS (
      SELECT t.question_id, c.kunnr, CAST({PAYLOAD_SQL} AS VARCHAR) AS payload,
             row_number() OVER (PARTITION BY t.question_id ORDER BY c.kunnr) AS place
      FROM told t JOIN c ON contains(c.sentence, t.name) WHERE form = 3)
    SELECT question_id, CASE form WHEN 0 THEN 'DEGRADED' WHEN 1 THEN 'VERIFIED' WHEN 2 THEN 'HALLUCINATED'
             ELSE CASE WHEN h.kunnr IS NULL THEN 'ABSENT' ELSE 'VERIFIED' END END AS status,
           CASE form WHEN 1 THEN 'It is ' || top_id WHEN 3 THEN coalesce(h.payload, '') END AS answer,
           CASE form WHEN 1 THEN top_id WHEN 3 THEN coalesce(h.kunnr, '') END AS source_chunk_id
    FROM told LEFT JOIN (SELECT * FROM hit WHERE place = 1) h USING (question_id)
    """,
)
def a10(spark: SparkSession, folder: str) -> DataFrame:
    """Not-found answers are asked again over the records that hold the asked name."""
    settled = stage(settle(canned(spark, folder)), "answers")
    return second_chance(settled, corpus(spark, folder), rule_model).select(
        "question_id", "status", "answer", "source_chunk_id"
    )


def answered(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn as an answered question, and every one again later with another answer."""
    rows = turns(spark, folder).select(
        F.col("question_id").alias("entry_id"),
        "question",
        F.concat(F.lit("first "), "question_id").alias("answer"),
        F.lit("").alias("exact_quote"),
        F.lit("").alias("source_chunk_id"),
    )
    again = rows.withColumn("entry_id", F.col("entry_id") + 1_000_000_000).withColumn("answer", F.lit("later"))
    return rows.unionByName(again)


UPPER_SQL = "translate(question, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query(
    "a11_reuse_exact",
    f"""
    WITH t AS (SELECT question_id, {trimmed_sql(UPPER_SQL)} AS key FROM ({TURNS_SQL}))
    SELECT t.question_id, min(k.question_id) AS entry_id, 'first ' || min(k.question_id) AS answer
    FROM t JOIN t k ON t.key = k.key GROUP BY t.question_id
    """,
)
def a11(spark: SparkSession, folder: str) -> DataFrame:
    """The turns asked again in ASCII capitals, with white space around them."""
    shouted = turns(spark, folder).select(
        "question_id",
        F.concat(
            F.lit(" \t"),
            F.translate("question", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            F.lit("\n"),
        ).alias("question"),
    )
    return reuse_exact(shouted, answered(spark, folder)).select("question_id", "entry_id", "answer")


@query(
    "a12_reuse_similar",
    """
    WITH q AS (SELECT vec_id, [CASE WHEN i <= label % 8 * 2 THEN 0 ELSE CAST(embedding[i] AS DOUBLE) END
                               FOR i IN range(1, 65)] AS v FROM embeddings),
         s AS (SELECT q.vec_id AS question_id, e.vec_id AS entry_id,
                      round(list_inner_product(q.v, CAST(e.embedding AS DOUBLE[])), 12) AS score
               FROM q CROSS JOIN embeddings e)
    SELECT question_id, entry_id, round(score, 8) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, entry_id) AS place FROM s)
    WHERE place = 1 AND score >= 0.95
    """,
)
def a12(spark: SparkSession, folder: str) -> DataFrame:
    """Given vectors against themselves with some elements blanked: some stay close enough."""
    vectors = table(spark, folder, "embeddings")
    blanked = F.transform("embedding", lambda x, i: F.when(i < F.col("label") % 8 * 2, 0.0).otherwise(x))
    asking = vectors.select(F.col("vec_id").alias("question_id"), blanked.cast("array<float>").alias("vector"))
    entries = vectors.select(
        F.col("vec_id").alias("entry_id"),
        F.col("embedding").alias("vector"),
        *[F.lit("").alias(c) for c in ("answer", "exact_quote", "source_chunk_id")],
    )
    return reuse_similar(asking, entries).select("question_id", "entry_id", F.round("score", 8).alias("score"))


@query(
    "a13_retain_recent",
    f"""
    WITH e AS (SELECT question_id AS entry_id, {trimmed_sql(UPPER_SQL)} AS key,
                      TIMESTAMP '2024-01-01 00:00:00' AS stored FROM ({TURNS_SQL})),
         u AS (SELECT user_id * 1000 AS entry_id, max(ts) AS used FROM events GROUP BY user_id),
         m AS (SELECT min(e.entry_id) AS entry_id, max(greatest(stored, coalesce(used, stored))) AS last
               FROM e LEFT JOIN u USING (entry_id) GROUP BY key)
    SELECT entry_id, epoch_us(last) AS last_used FROM m ORDER BY last DESC, entry_id LIMIT 100
    """,
)
def a13(spark: SparkSession, folder: str) -> DataFrame:
    entries = turns(spark, folder).select(
        F.col("question_id").alias("entry_id"),
        "question",
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("last_accessed"),
    )
    uses = table(spark, folder, "events").select(
        (F.col("user_id") * 1000).alias("entry_id"), F.col("ts").cast("timestamp").alias("used_at")
    )
    return retain_recent(entries, uses, capacity=100).select(
        "entry_id", F.unix_micros("last_accessed").alias("last_used")
    )


def letter_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """All customer records, embedded once and stored."""
    path = new_path(spark, "corpus")
    write_corpus(corpus_columns(embed(render_sentence(kna1(spark, folder)), letter_counts, key_col="kunnr")), path)
    return read_corpus(spark, path)


# Documents as questions: blank ones are rejected, the rest answered from the records.
@query(
    "a14_answer_questions",
    f"""
    WITH checked AS (SELECT doc_id AS question_id, {trimmed_sql("text")} AS text FROM documents),
         q AS (SELECT question_id, {unit_letters_sql("text")} AS vector FROM checked
               WHERE text <> ''),
         c AS ({LETTER_CORPUS_SQL}), near AS ({dense_sql(1)})
    SELECT question_id, CASE WHEN text = '' THEN 'REJECTED_EMPTY' ELSE 'VERIFIED' END AS status,
           near.id AS source_chunk_id,
           CASE WHEN near.id IS NOT NULL
                THEN CAST(to_json({{'city': k.ort01, 'kunnr': k.kunnr, 'name': k.name1}}) AS VARCHAR) END AS exact_quote
    FROM checked LEFT JOIN near USING (question_id) LEFT JOIN ({KNA1_SQL}) k ON k.kunnr = near.id
    """,
)
def a14(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(
        F.col("doc_id").alias("question_id"), F.col("text").alias("question")
    )
    answers = answer_questions(
        documents, letter_corpus(spark, folder), embedder=letter_counts, model=rule_model
    )
    return answers.select("question_id", "status", "source_chunk_id", "exact_quote")


@query(
    "a14_ask_again",
    f"""
    WITH q AS (SELECT conv_id * 1000 + turn AS question_id, {trimmed_sql("text")} AS text FROM conversations)
    SELECT question_id, CASE WHEN text = '' THEN 'REJECTED_EMPTY' ELSE 'REUSED_EXACT' END AS status FROM q
    """,
)
def a14_again(spark: SparkSession, folder: str) -> DataFrame:
    """All turns asked, remembered, and asked again: the second time no model is needed."""

    def silent(prompts: list[str]) -> list[str]:
        raise ConnectionError("asked again")

    asked_turns = turns(spark, folder).select("question_id", "question")
    stored, options = letter_corpus(spark, folder), {"embedder": letter_counts, "pause": 0.0}
    first = stage(answer_questions(asked_turns, stored, model=rule_model, **options), "first-answers")
    known = remember(first, None, F.lit("2024-01-01 00:00:00"))
    again = answer_questions(asked_turns, stored, model=silent, answered=known, **options)
    return again.select("question_id", "status")


def counting_questions(spark: SparkSession, folder: str) -> DataFrame:
    """A question per customer: about counts in one segment, about a name in the others."""
    counting = F.concat(F.lit("How many customers are in "), "land1", F.lit("?"))
    naming = F.concat(F.lit("Where is "), "name1", F.lit("?"))
    return kna1(spark, folder).select(
        F.col("kunnr").alias("question_id"),
        F.when(F.col("ort01") == "BUILDING", counting)
        .when(F.col("ort01") == "MACHINERY", F.concat(F.lit("Delete how many of "), "land1"))
        .otherwise(naming)
        .alias("question"),
    )


# The query that counts in a country, as the rule model writes it.
COUNT_IN_SQL = "sha256('SELECT count(*) AS n FROM kna1 WHERE land1 = ' || chr(39) || land1 || chr(39))"


@query(
    "a15_text_to_sql",
    f"""
    SELECT kunnr AS question_id, CASE WHEN ort01 = 'MACHINERY' THEN 'NOT_QUERY' ELSE 'OK' END AS sql_status,
           CASE WHEN ort01 = 'BUILDING' THEN {COUNT_IN_SQL}
                WHEN ort01 <> 'MACHINERY' THEN sha256('SELECT count(*) AS n FROM kna1') END AS result_id
    FROM ({KNA1_SQL})
    """,
)
def a15(spark: SparkSession, folder: str) -> DataFrame:
    kna1(spark, folder).createOrReplaceTempView("kna1")
    generated = text_to_sql(counting_questions(spark, folder), rule_model, TABLE_TEXT)
    return generated.select("question_id", "sql_status", "result_id")


# Queries that the caller has chosen, among them one that fails and one that is refused.
COUNT_LIST = [
    "SELECT count(*) AS n FROM kna1",
    "SELECT count(*) AS n FROM kna1 WHERE land1 = 'NATION_1'",
    "SELECT land1, max(kunnr) AS last FROM kna1 GROUP BY land1",
    "SELECT nothing FROM kna1",
    "DROP TABLE kna1",
]


@query(
    "a15_run_statements",
    f"""
    WITH k AS ({KNA1_SQL})
    SELECT sha256({literal(COUNT_LIST[0])}) AS result_id, '{{"n":' || count(*) || '}}' AS line, false AS failed FROM k
    UNION ALL SELECT sha256({literal(COUNT_LIST[1])}), '{{"n":' || count(*) || '}}', false FROM k WHERE land1 = 'NATION_1'
    UNION ALL SELECT sha256({literal(COUNT_LIST[2])}),
                     '{{"land1":"' || land1 || '","last":"' || max(kunnr) || '"}}', false FROM k GROUP BY land1
    UNION ALL SELECT sha256({literal(COUNT_LIST[3])}), NULL, true
    UNION ALL SELECT sha256({literal(COUNT_LIST[4])}), NULL, true
    """,
)
def a15_run(spark: SparkSession, folder: str) -> DataFrame:
    kna1(spark, folder).createOrReplaceTempView("kna1")
    return run_statements(spark, COUNT_LIST).select("result_id", "line", F.col("sql_error").isNotNull().alias("failed"))


@query(
    "a16_route_and_answer",
    f"""
    WITH k AS ({KNA1_SQL}),
         q AS (SELECT kunnr AS question_id, {unit_letters_sql("'Where is ' || name1 || '?'")} AS vector FROM k
               WHERE ort01 NOT IN ('BUILDING', 'MACHINERY')),
         c AS ({LETTER_CORPUS_SQL}), near AS ({dense_sql(1)})
    SELECT kunnr AS question_id, CASE WHEN ort01 IN ('BUILDING', 'MACHINERY') THEN 'SQL' ELSE 'SEMANTIC' END AS route,
           CASE WHEN ort01 = 'BUILDING' THEN {COUNT_IN_SQL} END AS result_id, near.id AS source_chunk_id,
           CASE WHEN near.id IS NOT NULL THEN 'VERIFIED' END AS status
    FROM k LEFT JOIN near ON near.question_id = k.kunnr
    """,
)
def a16(spark: SparkSession, folder: str) -> DataFrame:
    kna1(spark, folder).createOrReplaceTempView("kna1")
    answers = route_and_answer(
        counting_questions(spark, folder),
        letter_corpus(spark, folder),
        model=rule_model,
        table=TABLE_TEXT,
        embedder=letter_counts,
    )
    return answers.select("question_id", "route", "result_id", "source_chunk_id", "status")


@query(
    "a17_as_records",
    f"""
    {CANNED_SQL}
    SELECT question_id, 'LLM is offline or timed out: timeout' AS answer, n.chunk_id AS kunnr, n.chunk_text AS sentence,
           0.0::DOUBLE AS score
    FROM told JOIN near n USING (question_id) WHERE form = 0
    UNION ALL
    SELECT question_id, CASE form WHEN 1 THEN 'It is ' || top_id ELSE '' END, CASE form WHEN 1 THEN top_id ELSE '' END,
           CASE form WHEN 1 THEN top_text ELSE '' END, CASE form WHEN 1 THEN 1.0 ELSE 0.0 END
    FROM told WHERE form IN (1, 3)
    """,
)
def a17(spark: SparkSession, folder: str) -> DataFrame:
    """Records of checked and degraded answers; refused ones have none to show."""
    return as_records(settle(canned(spark, folder)))


@query(
    "a18_stream_questions",
    f"""
    WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS value FROM conversations),
         asked AS (SELECT {trimmed_sql("value")} AS question FROM lines),
         old AS (SELECT DISTINCT {trimmed_sql("text")} AS question FROM conversations)
    SELECT asked.question, count(*) AS n,
           'OK' AS verdict,
           CASE WHEN old.question IS NOT NULL THEN 'seen' END AS answer,
           CASE WHEN old.question IS NULL
                THEN md5({literal(P.INTENT_TASK)} || {ask_sql("asked.question")}) END AS digest
    FROM asked LEFT JOIN old ON lower(asked.question) = lower(old.question)
    WHERE asked.question <> '' GROUP BY ALL
    """,
)
def a18(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of the conversations arrives as a question; whole turns were answered before."""
    source, target = new_path(spark, "questions"), new_path(spark, "prompts")
    table(spark, folder, "conversations").select("text").repartition(4).write.text(source)
    seen = answered(spark, folder).withColumn("answer", F.lit("seen"))
    stream = stream_questions(read_question_stream(spark, source, maxFilesPerTrigger=2), seen)
    running = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", new_path(spark, "progress"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return (
        spark.read.parquet(target)
        .groupBy("question", "verdict", "answer", F.md5("prompt").alias("digest"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
