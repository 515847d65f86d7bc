import pytest
from pyspark.sql import functions as F

from questloom.operators.answers import apply_model
from questloom.operators.ledger import ask_once, read_ledger
from tests.conftest import rows


def shout(prompts):
    if any(p == "bad" for p in prompts):
        raise TimeoutError("timed out")
    return [p.upper() for p in prompts]


class Asker:
    """Counts the prompts that are sent; the run dies at wave ``dies``."""

    def __init__(self, dies=None):
        self.sent, self.waves, self.dies = [], 0, dies

    def __call__(self, prompts):
        self.waves += 1
        if self.waves == self.dies:
            raise RuntimeError("executor lost")
        self.sent += [r["prompt"] for r in prompts.select("prompt").collect()]
        return apply_model(prompts, shout, pause=0.0, key_col="prompt_key")


def test_a_run_after_a_failed_one_asks_only_what_is_unseen(spark, path):
    ledger = path("ledger")
    df = spark.createDataFrame([(i, f"p{i % 60}") for i in range(90)], "question_id int, prompt string")
    first = Asker(dies=3)
    with pytest.raises(RuntimeError, match="lost"):
        ask_once(df, first, ledger, "v1", wave_prompts=20)
    assert 0 < len(first.sent) == len(set(first.sent)) < 60
    second = Asker()
    got = ask_once(df, second, ledger, "v1", wave_prompts=20)
    assert rows(got, "question_id", "raw", "model_error") == [(i, f"P{i % 60}", None) for i in range(90)]
    assert sorted(first.sent + second.sent) == sorted(f"p{i}" for i in range(60))
    third = Asker()
    assert rows(ask_once(df, third, ledger, "v1")) == rows(got) and third.sent == []
    other = Asker()
    ask_once(df, other, ledger, "v2")
    assert len(other.sent) == 60
    assert read_ledger(spark, ledger, "v1").count() == read_ledger(spark, ledger, "v2").count() == 60


def test_failures_and_null_prompts_are_not_kept(spark, path):
    ledger = path("ledger")
    data = [(1, "a", 0), (2, "bad", 0), (3, None, 0), (4, "", 0), (5, "bad", 0), (1, "a", 0)]
    df = spark.createDataFrame(data, "question_id int, prompt string, prompt_key int")
    want = [(1, "A", None, 0), (1, "A", None, 0), (2, None, "timed out", 0), (3, None, None, 0), (4, "", None, 0), (5, None, "timed out", 0)]
    for sent in (["", "a", "bad"], ["bad"]):
        asker = Asker()
        got = ask_once(df, asker, ledger, "v")
        assert sorted(asker.sent) == sent and got.columns == [*df.columns, "raw", "model_error"]
        assert sorted(map(str, rows(got, "question_id", "raw", "model_error", "prompt_key"))) == sorted(map(str, want))
    assert ask_once(df.limit(0), Asker(), path("ledger"), "v").collect() == []


def test_two_writers_of_one_prompt_leave_one_reply(spark, path):
    ledger = path("ledger")
    both = spark.createDataFrame([("k", "v", "x"), ("k", "v", "b")], "prompt_key string, model_version string, raw string")
    both.write.parquet(ledger)
    assert rows(read_ledger(spark, ledger, "v")) == [("k", "b")]


def test_ledger_by_option(spark, path):
    ledger = path("ledger")
    df = spark.range(30).select(F.col("id").alias("question_id"), F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("prompt"))

    def refuses(prompts):
        raise ValueError("asked again")

    want = rows(apply_model(df, shout, pause=0.0, ledger=ledger, model_version="v"))
    assert rows(apply_model(df, refuses, pause=0.0, ledger=ledger, model_version="v")) == want
    assert apply_model(df, refuses, pause=0.0, ledger=ledger, model_version="w").where("model_error IS NULL").count() == 0
