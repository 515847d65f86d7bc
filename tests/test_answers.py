import json

import pytest
from pyspark.sql import functions as F

from questloom.models import HashingEmbedder, overlap_scorer, rule_model
from questloom.operators.answers import (
    BadReply,
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
from questloom.operators.hybrid import semantic_search
from questloom.operators.reuse import retain_recent, reuse_exact, reuse_similar
from questloom.session import stage
from questloom.streaming.question_stream import read_question_stream, stream_questions
from tests.conftest import rows
from tests.test_retrieval import customers

QUIET = {"pause": 0.0}


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "question_id int, question string")


def test_validation(spark):
    q = asked(spark, " ok ", "  \t", "x" * 5000, "é" * 2048, "é" * 2048 + "x", None)
    got = {r["question_id"]: r["verdict"] for r in validate_questions(q, 4096).collect()}
    assert got == {0: "OK", 1: "EMPTY", 2: "TOO_LONG", 3: "OK", 4: "TOO_LONG", 5: "EMPTY"}
    assert validate_questions(q).filter("question_id = 0").first()["question"] == "ok"
    assert validate_questions(q).filter("verdict = 'OK'").count() == 4


def test_prompt_has_chunks_in_rank_order(spark):
    ranked = spark.createDataFrame(
        [(0, "chunk_2", "Second", 2), (0, "chunk_1", "First", 1)],
        "question_id int, chunk_id string, chunk_text string, rank int",
    )
    prompts = {
        r["question_id"]: r["prompt"]
        for r in build_answer_prompt(asked(spark, "Where?", "Who?"), ranked.repartition(2)).collect()
    }
    assert "CHUNK ID: chunk_1\nTEXT: First\n\nCHUNK ID: chunk_2\nTEXT: Second\n\n" in prompts[0]
    assert "CHUNK ID: chunk" not in prompts[1] and 'Question: "Who?"' in prompts[1]
    for kind in ("route", "sql", "intent"):
        assert 'Question: "Where?"' in build_prompts(asked(spark, "Where?"), kind).first()["prompt"]


def test_model_failures_are_values(spark, path):
    calls = path("calls").removeprefix("file:")

    def flaky(prompts):
        if any(p == "bad" for p in prompts):
            raise TimeoutError("timed out")
        return [p.upper() for p in prompts]

    q = spark.createDataFrame([(i, "bad" if i == 3 else f"p{i}") for i in range(9)], "question_id int, prompt string")
    got = {r["question_id"]: (r["raw"], r["model_error"]) for r in apply_model(q.coalesce(1), flaky, **QUIET).collect()}
    assert got[3] == (None, "timed out")
    assert all(got[i] == (f"P{i}", None) for i in range(9) if i != 3)
    once = apply_model(q, flaky, tries=1, batch_size=1, **QUIET)
    assert rows(once.filter("model_error IS NOT NULL"), "question_id") == [(3,)]
    short = apply_model(q, lambda prompts: [], **QUIET)
    assert short.filter("model_error LIKE '%0 replies%'").count() == 9
    assert calls  # a fresh path: nothing is written by a failing call


def test_route_and_intent(spark):
    df = spark.createDataFrame(
        [
            (0, "q0", '{"route": "SQL"}', None),
            (1, "q1", '{"route": "sql"}', None),
            (2, "q2", "prose", None),
            (3, "q3", None, "down"),
        ],
        "question_id int, question string, raw string, model_error string",
    )
    assert [r[1] for r in rows(resolve_route(df), "question_id", "route")] == [
        "SQL",
        "SEMANTIC",
        "SEMANTIC",
        "SEMANTIC_FALLBACK",
    ]
    intents = df.withColumn(
        "raw", F.when(F.col("question_id") == 0, '{"intent": "i", "filters": ["NOT a"]}').otherwise(F.col("raw"))
    )
    assert rows(resolve_intent(intents), "question_id", "intent", "filters") == [
        (0, "i", ["NOT a"]),
        (1, "q1", []),
        (2, "q2", []),
        (3, "q3", []),
    ]


CHUNK = "Ferry 12 leaves Husum at noon; dogs travel free."
CLAIMS = [
    ((True, "dogs travel free", "timetable"), "VERIFIED"),
    ((True, "Dogs travel free", "timetable"), "HALLUCINATED"),
    ((True, "leaves Husum at noon", "menu"), "UNKNOWN_CHUNK"),
    ((True, "", "timetable"), "VERIFIED"),
    ((False, "no such thing", "menu"), "NOT_FOUND"),
]


def test_grounding_by_join(spark):
    answers = spark.createDataFrame(
        [(i, *claim) for i, (claim, _) in enumerate(CLAIMS)],
        "question_id int, answer_found boolean, exact_quote string, source_chunk_id string",
    )
    chunks = spark.createDataFrame(
        [(i, "timetable", CHUNK) for i in range(5)] + [(7, "menu", CHUNK)],
        "question_id int, chunk_id string, chunk_text string",
    )
    got = [r[1] for r in rows(verify_grounding(answers, chunks), "question_id", "verdict")]
    assert got == [want for _, want in CLAIMS]


def replied(spark, *cases):
    data = [(i, f"q{i}", f"word{i}", [(1, "timetable", CHUNK)], "p", raw, err) for i, (raw, err) in enumerate(cases)]
    return spark.createDataFrame(
        data,
        "question_id int, question string, intent string,"
        " chunks array<struct<rank:int,chunk_id:string,chunk_text:string>>, prompt string, raw string, model_error string",
    )


def body(found, quote="", chunk="", answer="a"):
    return json.dumps({"answer_found": found, "answer": answer, "exact_quote": quote, "source_chunk_id": chunk})


def test_settling_and_records(spark):
    cases = [(body(*claim), None) for claim, _ in CLAIMS] + [("prose", None), (None, "offline")]
    settled = settle(replied(spark, *cases)).cache()
    assert [r[1] for r in rows(settled, "question_id", "status")] == [w for _, w in CLAIMS] + ["BAD_REPLY", "DEGRADED"]
    down = settled.filter("question_id = 6").first()
    assert down["degraded"] and "offline" in down["message"]
    assert down["retrieved_chunks"] == [("timetable", CHUNK)]
    assert rows(as_records(settled), "question_id", "kunnr", "score") == [
        (0, "timetable", 1.0),
        (3, "timetable", 1.0),
        (4, "menu", 0.0),
        (6, "timetable", 0.0),
    ]


def test_second_chance(spark):
    c = customers(spark)
    cases = [(body(False), None), (body(False), None), (body(True, "nowhere", "timetable"), None), (None, "offline")]
    settled = settle(replied(spark, *cases)).withColumn(
        "intent", F.when(F.col("question_id") == 0, "Zephyr Lines").otherwise(F.col("intent"))
    )
    done = rows(second_chance(settled, c, rule_model, **QUIET), "question_id", "status", "source_chunk_id")
    assert done == [(0, "VERIFIED", "K-38"), (1, "ABSENT", ""), (2, "HALLUCINATED", None), (3, "DEGRADED", None)]

    def offline(prompts):
        raise ConnectionError("offline")

    kept = rows(second_chance(settled, c, offline, **QUIET), "question_id", "status")
    assert kept[:2] == [(0, "NOT_FOUND"), (1, "ABSENT")]
    retried = settled.withColumn("intent", F.lit("Zephyr Lines"))
    again = rows(second_chance(retried, c, rule_model, retry_rejected=True, **QUIET), "question_id", "status")
    assert again == [(0, "VERIFIED"), (1, "VERIFIED"), (2, "VERIFIED"), (3, "DEGRADED")]


def entries(spark):
    return spark.createDataFrame(
        [
            (1, "Where is Nordlicht?", [1.0, 0.0], "first", "", ""),
            (2, " where is NORDLICHT? ", [1.0, 0.0], "second", "", ""),
            (3, "Étage", [0.0, 1.0], "third", "", ""),
        ],
        "entry_id long, question string, vector array<float>, answer string, exact_quote string, source_chunk_id string",
    )


def test_reuse(spark):
    q = asked(spark, "WHERE IS NORDLICHT?\n", "étage", "Étage", "other")
    assert rows(reuse_exact(q, entries(spark)), "question_id", "answer") == [(0, "first"), (2, "third")]
    v = spark.createDataFrame(
        [(0, "x", [0.99, 0.141]), (1, "y", [0.7, 0.7]), (2, "z", [0.0, 1.0]), (3, "w", [1.0])],
        "question_id int, question string, vector array<float>",
    )
    assert rows(reuse_similar(v, entries(spark)), "question_id", "answer") == [(0, "first"), (2, "third")]


def test_least_recently_used_entry_leaves(spark):
    df = spark.createDataFrame(
        [(1, "Q1", 10), (2, "Q2", 20), (3, "Q3", 40), (4, "q1 ", 5)], "entry_id long, question string, t long"
    ).select("entry_id", "question", F.timestamp_seconds("t").alias("last_accessed"))
    uses = spark.createDataFrame([(1, 30), (1, 25)], "entry_id long, t long").select(
        "entry_id", F.timestamp_seconds("t").alias("used_at")
    )
    assert rows(retain_recent(df, uses, 2), "entry_id") == [(1,), (3,)]
    assert rows(retain_recent(df, None, 2), "entry_id") == [(2,), (3,)]
    assert retain_recent(df, None, 0).count() == 0
    assert retain_recent(df, uses).count() == 3


def flow(spark, questions, model=rule_model, **options):
    return answer_questions(
        questions, customers(spark), embedder=HashingEmbedder(16), model=model, **QUIET, **options
    )


def test_whole_flow(spark):
    old = entries(spark).withColumn("vector", F.array(F.lit(0.0).cast("float")))
    q = asked(spark, "Where is Zephyr Lines?", "  ", "x" * 5000, "where IS nordlicht?", "Who is not in Tromsø")
    options = {"answered": old, "scorer": overlap_scorer}
    got = {r["question_id"]: r for r in flow(spark, q, max_question_bytes=4096, **options).collect()}
    assert {i: r["status"] for i, r in got.items()} == {
        0: "VERIFIED",
        1: "REJECTED_EMPTY",
        2: "REJECTED_TOO_LONG",
        3: "REUSED_EXACT",
        4: "VERIFIED",
    }
    assert got[3]["answer"] == "first"
    assert got[0]["source_chunk_id"] == "K-38"
    assert "Tromsø" not in got[4]["exact_quote"]
    assert got[3]["entry_id"] == 1 and got[0]["vector"] and got[1]["vector"] is None
    # Without a limit the long question is asked like any other.
    assert flow(spark, q.filter("question_id = 2"), **options).first()["status"] != "REJECTED_TOO_LONG"


def test_remembered_answers_need_no_model(spark):
    q = asked(spark, "Where is Zephyr Lines?", "  ", "Who is not in Tromsø")
    at = F.lit("2024-05-01 00:00:00")
    first = stage(flow(spark, q), "first")
    known = remember(first, None, at)
    assert known.count() == 2

    def silent(prompts):
        raise AssertionError("asked again")

    again = stage(flow(spark, q, model=silent, answered=known), "again")
    assert rows(again, "question_id", "status") == [(0, "REUSED_EXACT"), (1, "REJECTED_EMPTY"), (2, "REUSED_EXACT")]
    later = remember(again.filter("question_id = 0"), known, F.lit("2024-06-01 00:00:00"), capacity=1)
    assert rows(later, "question") == [("Where is Zephyr Lines?",)]


def test_columns_beside_the_prompt_stay_as_they_are(spark):
    """A model sees prompts only: large numbers beside nulls, and nested rows, come back as they were."""
    kind = "question_id bigint, n bigint, chunks array<struct<rank:int,chunk_id:string>>, prompt string"
    df = spark.createDataFrame([(1, 2**53 + 1, [(1, "a"), (None, None)], "x"), (2, None, None, None)], kind).coalesce(1)
    got = apply_model(df, lambda prompts: [p and p.upper() for p in prompts], pause=0.0)
    assert dict(got.dtypes) == {**dict(df.dtypes), "raw": "string", "model_error": "string"}
    assert {r["question_id"]: (r["n"], r["chunks"], r["raw"]) for r in got.collect()} == {1: (2**53 + 1, [(1, "a"), (None, None)], "X"), 2: (None, None, None)}


def test_bad_reply_is_final(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(prompts):
        calls.add(1)
        raise BadReply("not JSON")

    df = build_prompts(asked(spark, "a"), "intent")
    assert apply_model(df, model, tries=5, pause=0.0).collect()[0]["model_error"] == "not JSON"
    assert calls.value == 1


def test_each_text_is_embedded_once(spark):
    calls = spark.sparkContext.accumulator(0)
    base = HashingEmbedder(16)

    def counting(texts):
        calls.add(len(texts))
        return base(texts)

    records = customers(spark).drop("vector")
    found = semantic_search(asked(spark, "Where is Zephyr Lines?", "Who is in Tromsø?"), records, counting, dense_top=2)
    assert found.select("question_id").distinct().count() == 2
    assert calls.value == 2 + records.count()


def test_flow_with_the_model_down(spark):
    def offline(prompts):
        raise ConnectionError("no route")

    got = flow(spark, asked(spark, "Where is Zephyr Lines?"), model=offline).first()
    assert got["status"] == "DEGRADED" and "no route" in got["message"]
    assert len(got["retrieved_chunks"]) == 5


def test_similar_question_is_reused(spark):
    first = flow(spark, asked(spark, "Where is Zephyr Lines?"))
    vectors = HashingEmbedder(16)(["Where is Zephyr Lines?"])
    unit = (vectors / (vectors**2).sum() ** 0.5)[0].tolist()
    old = first.select(
        F.lit(1).cast("long").alias("entry_id"),
        "question",
        F.array(*[F.lit(x).cast("float") for x in unit]).alias("vector"),
        "answer",
        "exact_quote",
        "source_chunk_id",
    )
    got = flow(spark, asked(spark, "zephyr lines: where is?"), answered=old).first()
    assert got["status"] == "REUSED_SIMILAR" and got["source_chunk_id"] == first.first()["source_chunk_id"]


def test_text_to_sql(spark):
    spark.createDataFrame([("1", "DE"), ("2", "FR")], "kunnr string, land1 string").createOrReplaceTempView("kna1")
    q = asked(spark, "How many are in DE?", "How many are in FR?", "Delete all", "broken", "wrong")

    def model(prompts):
        if any("broken" in p for p in prompts):
            raise ConnectionError("down")
        return ['{"query": "SELECT nothing FROM kna1"}' if "wrong" in p else rule_model([p])[0] for p in prompts]

    got = {r["question_id"]: r for r in text_to_sql(q, model, **QUIET).collect()}
    assert {i: r["sql_status"] for i, r in got.items()} == {
        0: "OK",
        1: "OK",
        2: "NOT_QUERY",
        3: "MODEL_DOWN",
        4: "OK",
    }
    assert got[2]["result_id"] is None
    chosen = [r["query"] for r in got.values() if r["sql_status"] == "OK"]
    results = {r["result_id"]: r for r in run_statements(spark, chosen).collect()}
    assert results[got[0]["result_id"]]["line"] == '{"n":1}'
    assert "nothing" in results[got[4]["result_id"]]["sql_error"]
    assert run_statements(spark, []).count() == 0
    assert spark.table("kna1").count() == 2


def test_routing(spark):
    spark.createDataFrame([("1", "DE")], "kunnr string, land1 string").createOrReplaceTempView("kna1")
    got = route_and_answer(
        asked(spark, "How many are in DE?", "Where is Zephyr Lines?"),
        customers(spark),
        model=rule_model,
        embedder=HashingEmbedder(16),
        **QUIET,
    )
    assert rows(got, "question_id", "route", "sql_status", "status") == [
        (0, "SQL", "OK", None),
        (1, "SEMANTIC", None, "VERIFIED"),
    ]


def test_question_stream(spark, path):
    source, target = path("src"), path("out")
    spark.createDataFrame([("Where is Nordlicht?\n\n  New one  ",)], "value string").write.text(source)
    stream = stream_questions(read_question_stream(spark, source), entries(spark))
    stream.writeStream.format("parquet").option("path", target).option(
        "checkpointLocation", path("progress")
    ).trigger(availableNow=True).start().awaitTermination()
    got = {r["question"]: r for r in spark.read.parquet(target).collect()}
    assert got["Where is Nordlicht?"]["answer"] == "first" and got["Where is Nordlicht?"]["prompt"] is None
    assert 'Question: "New one"' in got["New one"]["prompt"]


def test_scorer_must_answer_every_pair(spark):
    with pytest.raises(Exception, match="scorer returned"):
        flow(spark, asked(spark, "Where is Zephyr Lines?"), scorer=lambda pairs: [0.0]).collect()
