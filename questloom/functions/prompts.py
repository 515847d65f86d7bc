"""Prompt text: fixed instructions around the question, the schema and the chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: how a chunk is laid out in an answer prompt.
CHUNK_BLOCK = ("CHUNK ID: ", "\nTEXT: ", "\n\n")

ROUTE_TASK = (
    "Decide how to answer a question about the table below: with an exact SQL query, or with a"
    " search by meaning. Reply with one JSON object and nothing else. It has one key, \"route\","
    " whose value is \"SQL\" for counts, lists and totals and \"SEMANTIC\" for anything else.\n\n"
)
SQL_TASK = (
    "Write one read-only SQL query that answers a question about the table below. Reply with one"
    " JSON object and nothing else. It has one key, \"query\", whose value is the SQL text.\n\n"
)
INTENT_TASK = (
    "Split a question into what it is about and its hard conditions. Reply with one JSON object and"
    " nothing else. Its key \"intent\" is the meaning without identifiers or exclusions. Its key"
    " \"filters\" is a list of exact terms that must occur, each exclusion written as \"NOT \" and"
    " the term; the list is empty if there are none.\n\n"
)
ANSWER_TASK = (
    "Answer a question from the chunks below and from nothing else. Reply with one JSON object and"
    " nothing else, with the keys \"answer_found\" (true or false), \"answer\", \"exact_quote\" (text"
    " copied letter by letter from one chunk) and \"source_chunk_id\" (the CHUNK ID it was copied"
    " from). If the chunks do not hold the answer, set \"answer_found\" to false and the rest to \"\".\n\n"
    "CHUNKS:\n"
)


def describe_table(name: str, schema: T.StructType) -> str:
    """The table as a model is told about it."""
    lines = [f"- {f.name} ({f.dataType.simpleString()})" for f in schema.fields]
    return f"Table `{name}`:\n" + "\n".join(lines) + "\n"


def ask(question: Column) -> Column:
    return F.concat(F.lit('\nQuestion: "'), question, F.lit('"\nReply: '))


def build_prompt(kind: str, question: Column, table: str = "") -> Column:
    """The prompt that asks for a ``route``, a ``sql`` query or the ``intent`` of a question."""
    task = {"route": ROUTE_TASK + table, "sql": SQL_TASK + table, "intent": INTENT_TASK}[kind]
    return F.concat(F.lit(task), ask(question))


def chunk_context(chunks: Column) -> Column:
    """``chunks``: an array of structs (rank, chunk_id, chunk_text); laid out in rank order."""
    before, between, after = CHUNK_BLOCK
    blocks = F.transform(
        F.array_sort(chunks),
        lambda c: F.concat(F.lit(before), c["chunk_id"], F.lit(between), c["chunk_text"], F.lit(after)),
    )
    return F.array_join(blocks, "")


def answer_prompt(question: Column, chunks: Column) -> Column:
    return F.concat(F.lit(ANSWER_TASK), chunk_context(chunks), ask(question))
