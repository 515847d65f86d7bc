import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from questloom.functions.replies import ANSWER_REPLY, INTENT_REPLY, ROUTE_REPLY, parse_reply
from questloom.functions.text import fold_ascii, trim_space, words
from questloom.functions.vectors import l2_normalize, normalize_rows, require_vector, vector_verdict


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, route",
    [
        ('{"why": "it counts", "route": "SQL"}', "SQL"),
        ('```json\n{"route": "SQL"}\n```', "SQL"),
        ('```json{"route": "SQL"}```', "SQL"),
        ('```\n{"route": "SEMANTIC", "sure": 0.7}\n```', "SEMANTIC"),
        ('\t\n```{"route": "elsewhere"}   ```\n', "elsewhere"),
        ("I would look it up in the table", None),
        ('{"rout": "SQL"}', None),
        ('{"route": "SQL"', None),
        ('{"route": 5}', None),
        ('{"route": null}', None),
        ('["route"]', None),
        ("", None),
        (None, None),
    ],
)
def test_reply_fences_and_types(spark, raw, route):
    got = one(spark, parse_reply(F.lit(raw).cast("string"), ROUTE_REPLY))
    assert (got and got["route"]) == route


def test_intent_reply(spark):
    good = '{"intent": "a", "filters": ["NOT in Munich", "NOT in Berlin"]}'
    assert one(spark, parse_reply(F.lit(good), INTENT_REPLY))["filters"] == ["NOT in Munich", "NOT in Berlin"]
    assert one(spark, parse_reply(F.lit('{"intent": "a", "filters": []}'), INTENT_REPLY))["filters"] == []
    for bad in ('{"intent": "a"}', '{"intent": "a", "filters": [1]}', '{"intent": "a", "filters": ["x", null]}'):
        assert one(spark, parse_reply(F.lit(bad), INTENT_REPLY)) is None


def test_answer_reply_needs_a_boolean(spark):
    body = '{"answer_found": %s, "answer": "", "exact_quote": "", "source_chunk_id": ""}'
    assert one(spark, parse_reply(F.lit(body % "false"), ANSWER_REPLY))["answer_found"] is False
    assert one(spark, parse_reply(F.lit(body % '"false"'), ANSWER_REPLY)) is None


def test_text(spark):
    assert one(spark, trim_space(F.lit(" \t a b 　\n"))) == "a b"
    assert one(spark, words(F.lit("  a\t\tb\n c "))) == ["a", "b", "c"]
    assert one(spark, words(F.lit("  "))) == []
    assert one(spark, fold_ascii(F.lit(" ÀBc "))) == "Àbc"


VECTORS = [
    [3.0, 4.0],
    [0.0, 0.0],
    [1e30, 1e30],
    [1e-39, 0.0],
    [float("nan"), 1.0],
    [float("inf"), 1.0],
    [-3e38, 3e38],
]


def test_normalise_both_ways(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VECTORS)], "i int, v array<float>")
    native = {r["i"]: r["n"] for r in df.select("i", l2_normalize(F.col("v")).alias("n")).collect()}
    block = normalize_rows(np.array(VECTORS, dtype=np.float32))
    for i in native:
        np.testing.assert_array_equal(np.array(native[i], dtype=np.float32), block[i])
    assert native[0] == pytest.approx([0.6, 0.8])
    assert native[1] == [0.0, 0.0]
    assert math.isnan(native[4][0]) and native[4][1] == 1.0


def test_vector_shape(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, None]), (5, [])], "i int, v array<float>"
    )
    got = {r["i"]: r["d"] for r in df.select("i", vector_verdict(F.col("v"), 2).alias("d")).collect()}
    assert got == {1: "OK", 2: "BAD_DIMENSION", 3: "NULL_VECTOR", 4: "NULL_ELEMENT", 5: "BAD_DIMENSION"}
    with pytest.raises(Exception, match="BAD_DIMENSION"):
        df.filter("i = 2").select(require_vector(F.col("v"), 2)).collect()
