"""Batch question answering: prompts, model calls, checked replies, fallbacks."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from questloom.functions.prompts import answer_prompt, build_prompt
from questloom.functions.replies import ANSWER_REPLY, INTENT_REPLY, ROUTE_REPLY, SQL_REPLY, parse_reply
from questloom.functions.text import trim_space
from questloom.operators.fusion import RERANK_TOP, Scorer, rerank
from questloom.operators.gate import run_sql, statement_verdict
from questloom.operators.hybrid import chunk_payload, hybrid_search, lookup
from questloom.operators.ingest import Embedder, embed
from questloom.operators.ledger import ask_once
from questloom.operators.reuse import SIMILAR_THRESHOLD, retain_recent, reuse_exact, reuse_similar
from questloom.operators.terms import keyword_fallback
from questloom.session import new_path, stage
from questloom.sources.tables import to_json_lines

# Model tries and pause, fallback hits.
MODEL_TRIES = 2
MODEL_PAUSE_SECONDS = 0.5
FALLBACK_TOP = 5
DEGRADED_MESSAGE = "LLM is offline or timed out: "

Model = Callable[[list[str]], list[str]]


class BadReply(ValueError):
    """Raised by a model's client for a reply that it can't read: asking again would not help, so nobody does."""


# --- intake ---------------------------------------------------------------


def question_verdict(question: Column, max_bytes: int | None = None) -> Column:
    """``OK``, ``EMPTY``, or ``TOO_LONG`` beyond ``max_bytes`` (if given) of trimmed UTF-8 text."""
    trimmed = trim_space(question)
    long = F.lit(False) if max_bytes is None else F.octet_length(trimmed) > max_bytes
    return F.when(trimmed.isNull() | (trimmed == ""), "EMPTY").when(long, "TOO_LONG").otherwise("OK")


def validate_questions(questions: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Trim the questions and add ``verdict``; a bad row rejects itself only."""
    return questions.withColumn("verdict", question_verdict(F.col("question"), max_bytes)).withColumn(
        "question", trim_space(F.col("question"))
    )


# --- prompts and model calls ----------------------------------------------


def build_prompts(questions: DataFrame, kind: str, table: str = "") -> DataFrame:
    """Add ``prompt`` for a ``route``, ``sql`` or ``intent`` reply."""
    return questions.withColumn("prompt", build_prompt(kind, F.col("question"), table))


def gather_chunks(ranked: DataFrame) -> DataFrame:
    """question_id, chunks: the chunks of a question as one array in rank order.

    ``ranked`` is already cut to a few chunks per question by retrieval.
    """
    return ranked.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "chunk_text"))).alias("chunks")
    )


def build_answer_prompt(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Add ``chunks`` and ``prompt``; a question without chunks gets an empty context."""
    none = F.array().cast("array<struct<rank:int,chunk_id:string,chunk_text:string>>")
    return (
        questions.join(gather_chunks(ranked), "question_id", "left")
        .withColumn("chunks", F.coalesce("chunks", none))
        .withColumn("prompt", answer_prompt(F.col("question"), F.col("chunks")))
    )


def apply_model(
    df: DataFrame,
    model: Callable[[], Model] | Model,
    prompt_col: str = "prompt",
    *,
    tries: int = MODEL_TRIES,
    pause: float = MODEL_PAUSE_SECONDS,
    batch_size: int = 16,
    per_task: bool = False,
    key_col: str = "question_id",
    ledger: str | None = None,
    model_version: str = "",
) -> DataFrame:
    """Add ``raw`` and ``model_error``: a failing call is a value, not a failing job.

    Prompts go out in batches; after a failure each prompt of the batch is
    tried on its own, so one bad prompt does not spoil its neighbours.  A ``BadReply`` to a single prompt is
    final.  With
    ``per_task`` the model is a factory, called once per task (a client).
    ``key_col`` should tell rows apart: it decides which task a row goes to.

    With ``ledger``, the path of a table of replies, only prompts that have no reply of ``model_version`` in it are
    sent, each once; their replies are added to it (``ledger.ask_once``).
    """
    if ledger is not None:
        options = {"tries": tries, "pause": pause, "batch_size": batch_size, "per_task": per_task}

        def ask(prompts: DataFrame) -> DataFrame:
            return apply_model(prompts, model, prompt_col, key_col="prompt_key", **options)

        return ask_once(stage(df, "prompts"), ask, ledger, model_version, prompt_col)
    columns = df.columns
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A call costs far more than its bytes: share the rows out by number, not by size.
    df = df.repartition(spread, *[F.col(c) for c in columns if c == key_col])

    def call(client: Model, prompts: list[str]) -> list[str]:
        replies = list(client(prompts))
        if len(replies) != len(prompts):
            raise ValueError(f"model returned {len(replies)} replies for {len(prompts)} prompts")
        return replies

    def alone(client: Model, prompt: str, left: int) -> tuple[str | None, str | None]:
        error = "no tries left"
        for _ in range(left):
            time.sleep(pause)
            try:
                return call(client, [prompt])[0], None
            except Exception as problem:  # noqa: BLE001 - any failure of a model is a value
                error = str(problem) or type(problem).__name__
                if isinstance(problem, BadReply):
                    break
        return None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = model() if per_task else model
        for batch in batches:
            done: list[tuple[str | None, str | None]] = []
            # Only the prompts become Python objects.
            prompts = batch.column(prompt_col).to_pylist()
            for start in range(0, len(prompts), batch_size):
                part = prompts[start : start + batch_size]
                try:
                    done += [(reply, None) for reply in call(client, part)]
                except Exception as problem:  # noqa: BLE001
                    if tries < 2 or len(part) == 1 and isinstance(problem, BadReply):
                        done += [(None, str(problem))] * len(part)
                    else:
                        done += [alone(client, prompt, tries - 1) for prompt in part]
            added = [pa.array(values, pa.string(), from_pandas=True) for values in ([r for r, _ in done], [e for _, e in done])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*columns, "raw", "model_error"])

    fields = ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)
    return df.mapInArrow(run, f"{fields}, raw string, model_error string")


# --- reading replies ------------------------------------------------------


def resolve_route(replies: DataFrame) -> DataFrame:
    """Add ``route``: SQL, SEMANTIC, or SEMANTIC_FALLBACK when the model was down."""
    asked = parse_reply(F.col("raw"), ROUTE_REPLY)["route"]
    return replies.withColumn(
        "route",
        F.when(F.col("model_error").isNotNull(), "SEMANTIC_FALLBACK")
        .when(asked == "SQL", "SQL")
        .otherwise("SEMANTIC"),
    )


def resolve_intent(replies: DataFrame) -> DataFrame:
    """Add ``intent`` and ``filters``; without a readable reply the question stands for itself."""
    parsed = F.when(F.col("model_error").isNull(), parse_reply(F.col("raw"), INTENT_REPLY))
    return replies.withColumn("_parsed", parsed).select(
        *replies.columns,
        F.coalesce("_parsed.intent", "question").alias("intent"),
        F.coalesce("_parsed.filters", F.array().cast("array<string>")).alias("filters"),
    )


def grounding_verdict(reply: Column, chunks: Column) -> Column:
    """Whether an answer struct is backed by the chunks its question was shown.

    A found answer must cite a shown chunk and quote it letter by letter.
    """
    cited = F.filter(chunks, lambda c: c["chunk_id"] == reply["source_chunk_id"])
    quoted = F.exists(cited, lambda c: c["chunk_text"].contains(reply["exact_quote"]))
    return (
        F.when(reply.isNull(), "BAD_REPLY")
        .when(~reply["answer_found"], "NOT_FOUND")
        .when(F.size(cited) == 0, "UNKNOWN_CHUNK")
        .when(~quoted, "HALLUCINATED")
        .otherwise("VERIFIED")
    )


def verify_grounding(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add ``verdict`` to answers (question_id, answer_found, exact_quote, source_chunk_id).

    ``chunks``: question_id, chunk_id, chunk_text, unique per question and
    chunk.  A plain equi-join, so any number of chunks per question will do.
    """
    shown = chunks.select(
        "question_id", F.col("chunk_id").alias("source_chunk_id"), F.col("chunk_text").alias("_text")
    )
    verdict = (
        F.when(~F.col("answer_found"), "NOT_FOUND")
        .when(F.col("_text").isNull(), "UNKNOWN_CHUNK")
        .when(~F.col("_text").contains(F.col("exact_quote")), "HALLUCINATED")
        .otherwise("VERIFIED")
    )
    return (
        answers.join(shown, ["question_id", "source_chunk_id"], "left")
        .withColumn("verdict", verdict)
        .select(*answers.columns, "verdict")
    )


EMPTY_CHUNKS = "array<struct<chunk_id:string,content:string>>"


def degraded_chunks(chunks: Column) -> Column:
    return F.transform(
        chunks, lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["chunk_text"].alias("content"))
    )


def settle(replies: DataFrame) -> DataFrame:
    """Turn model replies over shown chunks into answers with a status.

    Adds status, answer, exact_quote, source_chunk_id, degraded, message and
    retrieved_chunks.  With the model down the answer degrades to the chunks.
    """
    reply = parse_reply(F.col("raw"), ANSWER_REPLY)
    down = F.col("model_error").isNotNull()
    parsed = replies.withColumn("_reply", reply).withColumn(
        "status",
        F.when(down, "DEGRADED").otherwise(grounding_verdict(F.col("_reply"), F.col("chunks"))),
    )
    usable = F.col("status").isin("VERIFIED", "NOT_FOUND")
    return parsed.select(
        *replies.columns,
        "status",
        *[
            F.when(usable, F.col(f"_reply.{c}")).alias(c)
            for c in ("answer", "exact_quote", "source_chunk_id")
        ],
        down.alias("degraded"),
        F.when(down, F.concat(F.lit(DEGRADED_MESSAGE), "model_error")).alias("message"),
        F.when(down, degraded_chunks(F.col("chunks"))).otherwise(F.array().cast(EMPTY_CHUNKS)).alias(
            "retrieved_chunks"
        ),
    )


SETTLED = [
    "status", "answer", "exact_quote", "source_chunk_id", "degraded", "message", "retrieved_chunks",
]


def second_chance(
    settled: DataFrame,
    corpus: DataFrame,
    model: Callable,
    *,
    retry_rejected: bool = False,
    fallback_top: int | None = FALLBACK_TOP,
    **model_options,
) -> DataFrame:
    """Ask again, with keyword hits, where the first answer was "not found".

    ``settled`` is read several times: pass a stored table.  No keyword hits proves the absence (status ABSENT).  A model that is down
    the second time leaves "not found" standing.  ``retry_rejected`` also asks
    again where grounding failed.  ``fallback_top`` is the number of keyword hits shown (None: all).  Only the
    slice in question is recomputed.
    """
    again = ["NOT_FOUND"] + (["HALLUCINATED", "UNKNOWN_CHUNK"] if retry_rejected else [])
    retry = settled.filter(F.col("status").isin(again))
    hits = keyword_fallback(retry, corpus, fallback_top)
    records = corpus.select(F.col("kunnr").alias("id"), "kunnr", "name", "city")
    ranked = lookup(hits, records).select(
        "question_id",
        F.col("position").alias("rank"),
        F.col("kunnr").alias("chunk_id"),
        chunk_payload().alias("chunk_text"),
    )
    base = [c for c in settled.columns if c not in (*SETTLED, "chunks", "prompt", "raw", "model_error")]
    first = retry.select("question_id", *[F.col(c).alias(f"_{c}") for c in SETTLED])
    prompts = build_answer_prompt(retry.select(*base), ranked)
    asked = stage(
        settle(apply_model(prompts.filter(F.size("chunks") > 0), model, **model_options)), "second-answers"
    )
    second = asked.join(first, "question_id")
    kept = second.select(
        *[c for c in settled.columns if c not in SETTLED],
        *[
            F.when(F.col("degraded"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
            for c in SETTLED
        ],
    )
    absent = retry.join(asked.select("question_id"), "question_id", "left_anti").withColumn(
        "status", F.when(F.col("status") == "NOT_FOUND", "ABSENT").otherwise(F.col("status"))
    )
    rest = settled.filter(~F.col("status").isin(again))
    return rest.unionByName(kept).unionByName(absent)


# --- whole flows ----------------------------------------------------------

ANSWER_COLUMNS = ["question_id", "question", *SETTLED, "vector", "entry_id"]


def answer_questions(
    questions: DataFrame,
    corpus: DataFrame,
    *,
    embedder: Embedder,
    model: Callable,
    scorer: Scorer | None = None,
    answered: DataFrame | None = None,
    similar_threshold: float = SIMILAR_THRESHOLD,
    rerank_top: int = RERANK_TOP,
    retry_rejected: bool = False,
    search: Callable[..., DataFrame] = hybrid_search,
    top_k: int | None = None,
    fallback_top: int | None = FALLBACK_TOP,
    max_question_bytes: int | None = None,
    **model_options,
) -> DataFrame:
    """One row per question: question_id, question, the answer with its status, vector and entry_id.

    ``vector`` is that of a newly answered question, ``entry_id`` the reused entry; ``remember`` makes both into the
    next ``answered``.  ``top_k`` is the number of records that the search returns for a question.  Questions are only
    refused for their length if ``max_question_bytes`` is given.

    Each step works on the questions that still need it: rejected and reused
    ones leave before any model is called.  Model replies are staged to a table
    so that a lost executor never makes a model answer the same prompt twice
    with different words.
    """
    checked = validate_questions(questions, max_question_bytes)
    unknown_vector, no_entry = F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("bigint").alias("entry_id")
    none = F.array().cast(EMPTY_CHUNKS)
    rejected = checked.filter(F.col("verdict") != "OK").select(
        "question_id",
        "question",
        F.concat(F.lit("REJECTED_"), "verdict").alias("status"),
        *[F.lit(None).cast("string").alias(c) for c in ("answer", "exact_quote", "source_chunk_id")],
        F.lit(False).alias("degraded"),
        F.lit(None).cast("string").alias("message"),
        none.alias("retrieved_chunks"),
        unknown_vector,
        no_entry,
    )
    todo = checked.filter(F.col("verdict") == "OK").drop("verdict")
    parts = [rejected]

    def reused(hits: DataFrame, how: str) -> DataFrame:
        return hits.select(
            "question_id",
            "question",
            F.lit(how).alias("status"),
            "answer",
            "exact_quote",
            "source_chunk_id",
            F.lit(False).alias("degraded"),
            F.lit(None).cast("string").alias("message"),
            none.alias("retrieved_chunks"),
            unknown_vector,
            F.col("entry_id").cast("bigint").alias("entry_id"),
        )

    if answered is not None:
        exact = reuse_exact(todo, answered)
        parts.append(reused(exact, "REUSED_EXACT"))
        todo = todo.join(exact.select("question_id"), "question_id", "left_anti")

    replies = apply_model(build_prompts(todo, "intent"), model, **model_options)
    parsed = stage(resolve_intent(replies).select(*todo.columns, "intent", "filters"), "intents")
    ready = stage(embed(parsed, embedder, text_col="intent", key_col="question_id"), "questions")
    vectors = ready.select("question_id", "vector")

    if answered is not None:
        similar = stage(reuse_similar(ready, answered, similar_threshold), "reused")
        parts.append(reused(similar, "REUSED_SIMILAR"))
        ready = ready.join(similar.select("question_id"), "question_id", "left_anti")

    sizes = {} if top_k is None else {"dense_top": top_k, "term_top": top_k, "fused_top": top_k}
    ranked = search(ready, corpus, **sizes).select(
        "question_id", F.col("kunnr").alias("chunk_id"), "chunk_text", "rank"
    )
    if scorer is not None:
        ranked = rerank(
            ranked.join(ready.select("question_id", "question"), "question_id"), scorer, rerank_top
        )
    prompts = build_answer_prompt(ready.drop("vector", "filters"), ranked)
    # Staged after reading, so that nothing later parses a reply again.
    settled = stage(settle(apply_model(prompts, model, **model_options)), "answers")
    final = second_chance(
        settled, corpus, model, retry_rejected=retry_rejected, fallback_top=fallback_top, **model_options
    )
    parts.append(final.join(vectors, "question_id").withColumn("entry_id", F.lit(None).cast("bigint")))

    result = parts[0].select(ANSWER_COLUMNS)
    for part in parts[1:]:
        result = result.unionByName(part.select(ANSWER_COLUMNS))
    return result


def remember(results: DataFrame, answered: DataFrame | None, at: Column, capacity: int | None = None) -> DataFrame:
    """The table of answered questions after ``results`` of ``answer_questions``, which were given at time ``at``.

    Checked answers (found, not found, or proven absent) become entries, behind those there are; entries that were
    reused count as used now.  With ``capacity`` the most recently used stay.  ``results`` is read several times: pass
    a stored table.
    """
    last = answered.agg(F.max("entry_id")).first()[0] if answered is not None else None
    checked = results.filter(F.col("status").isin("VERIFIED", "NOT_FOUND", "ABSENT"))
    new = checked.select(
        (F.lit(-1 if last is None else last) + 1 + F.monotonically_increasing_id()).alias("entry_id"),
        "question",
        "vector",
        "answer",
        "exact_quote",
        "source_chunk_id",
        at.cast("timestamp").alias("last_accessed"),
    )
    new = stage(new, "entries")
    entries = new if answered is None else answered.select(new.columns).unionByName(new)
    uses = results.filter(F.col("status").startswith("REUSED_")).select("entry_id", at.cast("timestamp").alias("used_at"))
    return stage(retain_recent(entries, uses, capacity), "answered")


def text_to_sql(
    questions: DataFrame, model: Callable, table: str = "", **model_options
) -> DataFrame:
    """Add ``query``, ``sql_status`` and ``result_id``.

    The status is OK, MODEL_DOWN, BAD_REPLY, or why the text is refused; ``result_id`` (the SHA-256 of an accepted
    query) is under which ``run_statements`` stores its rows, once for all questions that ask it.  Nothing is run here.
    """
    replies = apply_model(build_prompts(questions, "sql", table), model, **model_options)
    parsed = replies.withColumn("query", parse_reply(F.col("raw"), SQL_REPLY)["query"])
    verdict = (
        F.when(F.col("model_error").isNotNull(), "MODEL_DOWN")
        .when(F.col("query").isNull(), "BAD_REPLY")
        .otherwise(statement_verdict(F.col("query")))
    )
    marked = parsed.withColumn("sql_status", verdict)
    return stage(marked.withColumn("result_id", F.when(F.col("sql_status") == "OK", F.sha2("query", 256))), "sql")


RESULT_SCHEMA = "result_id string, line string, sql_error string"


def run_statements(
    spark: SparkSession, statements: Sequence[str], max_rows: int | None = None, at_once: int = 8
) -> DataFrame:
    """Run queries that the caller names: result_id, line (a row as JSON), sql_error.

    A query can only be started from the driver, so this takes a list and no table; which of the generated ones are
    worth running is the caller's choice.  ``at_once`` of them run together.  Each passes the gate first.  Their rows
    go to the shared folder and not through the driver; a refused or failing query is one row with its error.
    """
    folder = new_path(spark, "sql-results")

    def run(numbered: tuple[int, str]) -> None:
        number, query = numbered
        target = f"{folder}/run={number}"
        name = F.lit(hashlib.sha256(query.encode()).hexdigest()).alias("result_id")
        try:
            to_json_lines(run_sql(spark, query, max_rows)).select(
                name, "line", F.lit(None).cast("string").alias("sql_error")
            ).write.parquet(target)
        except Exception as problem:  # noqa: BLE001 - a refused or failing query is a value
            spark.range(1).select(
                name, F.lit(None).cast("string").alias("line"), F.lit(str(problem)).alias("sql_error")
            ).write.mode("overwrite").parquet(target)

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(run, enumerate(dict.fromkeys(statements))))
    # An empty table of its own keeps the folder readable when nothing ran.
    spark.createDataFrame([], RESULT_SCHEMA).write.parquet(f"{folder}/run=-1")
    return spark.read.schema(RESULT_SCHEMA).parquet(folder).select("result_id", "line", "sql_error")


def route_and_answer(
    questions: DataFrame,
    corpus: DataFrame,
    *,
    model: Callable,
    table: str = "",
    tries: int = MODEL_TRIES,
    pause: float = MODEL_PAUSE_SECONDS,
    ledger: str | None = None,
    model_version: str = "",
    **options,
) -> DataFrame:
    """Route every question to SQL or to the corpus; all answers with their route.

    A question for SQL gets its query, the gate's verdict on it, and the ``result_id`` under which ``run_statements``
    stores the rows.
    """
    model_options = {"tries": tries, "pause": pause, "ledger": ledger, "model_version": model_version}
    routed = stage(
        resolve_route(apply_model(build_prompts(questions, "route", table), model, **model_options)),
        "routes",
    ).select(*questions.columns, "route")
    by_sql = routed.filter(F.col("route") == "SQL").drop("route")
    by_meaning = routed.filter(F.col("route") != "SQL").drop("route")
    generated = text_to_sql(by_sql, model, table, **model_options)
    rows = generated.select("question_id", "question", "query", "sql_status", "result_id")
    answers = answer_questions(by_meaning, corpus, model=model, **model_options, **options)
    both = answers.unionByName(rows, allowMissingColumns=True)
    return both.join(routed.select("question_id", "route"), "question_id")


def as_records(answers: DataFrame) -> DataFrame:
    """Flat records: answer, kunnr, sentence, score.

    A checked answer is one record, score 1.0 if found and 0.0 if not; a
    degraded one is a record per retrieved chunk, score 0.0.  Refused answers
    have no records.
    """
    answers = answers.filter(
        F.col("degraded") | F.col("status").isin("VERIFIED", "NOT_FOUND", "ABSENT", "REUSED_EXACT", "REUSED_SIMILAR")
    )
    found = F.when(F.col("status").isin("NOT_FOUND", "ABSENT"), 0.0).otherwise(1.0)
    one = F.array(
        F.struct(
            F.col("source_chunk_id").alias("kunnr"),
            F.col("exact_quote").alias("sentence"),
            found.alias("score"),
        )
    )
    each = F.transform(
        "retrieved_chunks",
        lambda c: F.struct(
            c["chunk_id"].alias("kunnr"), c["content"].alias("sentence"), F.lit(0.0).alias("score")
        ),
    )
    records = F.when(F.col("degraded"), each).otherwise(one)
    return answers.select(
        "question_id",
        F.when(F.col("degraded"), F.col("message")).otherwise(F.col("answer")).alias("answer"),
        F.explode(records).alias("record"),
    ).select("question_id", "answer", "record.*")
