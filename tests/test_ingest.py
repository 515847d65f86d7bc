import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from questloom.models import HashingEmbedder
from questloom.operators.ann import read_index_keys
from questloom.operators.ingest import (
    dedup_first,
    default_unknown,
    embed,
    find_existing,
    ingest,
    merge_insert,
    new_records,
    render_sentence,
)
from questloom.operators.terms import keyword_fallback
from questloom.session import path_exists, shared_dir, stage, staging
from questloom.sources.corpus import CORPUS_SCHEMA, corpus_exists, create_corpus, read_corpus, write_corpus
from questloom.sources.tables import SOURCE_ORDER, read_questions, read_records, register_csv
from questloom.streaming.ingest_stream import stream_ingest
from tests.conftest import rows

HEADER = "kunnr,name1,ort01,land1\n"


@pytest.fixture
def csv(tmp_path):
    def write(text):
        target = tmp_path / f"{len(list(tmp_path.iterdir()))}.csv"
        target.write_text(text)
        return str(target)

    return write


def load(spark, source, target, **options):
    return ingest(read_records(spark, source), target, HashingEmbedder(16), order=SOURCE_ORDER, **options)


def test_ingest_counts_and_is_repeatable(spark, csv, path):
    source, target = csv(HEADER + "P-1,Nordlicht Glas,Berlin,DE\nP-2,Quarry Glas,Munich,DE\n"), path("corpus")
    assert load(spark, source, target, dim=16) == 2
    assert load(spark, source, target) == 0
    assert load(spark, source, target, overwrite=True) == 2
    stored = read_corpus(spark, target)
    assert [f.name for f in stored.schema] == CORPUS_SCHEMA.names
    assert rows(stored, "sentence")[0] == (
        "Customer P-1 is named Nordlicht Glas and is located in Berlin, DE.",
    )
    norms = stored.select(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("n"))
    assert all(abs(r["n"] - 1) < 1e-6 for r in norms.collect())


def test_first_row_wins_within_and_across_batches(spark, csv, path):
    target = path("corpus")
    assert load(spark, csv(HEADER + "A,first,X,DE\nB,b,X,DE\nA,second,Y,DE\n"), target) == 2
    assert load(spark, csv(HEADER + "A,third,Z,DE\nC,c,Z,DE\n"), target) == 1
    assert rows(read_corpus(spark, target), "kunnr", "name") == [("A", "first"), ("B", "b"), ("C", "c")]


def test_null_keys_are_one_record(spark, csv, path):
    target = path("corpus")
    assert load(spark, csv(HEADER + ",one,,DE\n,two,X,\n1,,X,\n"), target) == 2
    assert rows(read_corpus(spark, target), "kunnr", "name", "city") == [
        ("1", "Unknown", "X"),
        ("Unknown", "one", "Unknown"),
    ]
    assert load(spark, csv(HEADER + ",three,,DE\n"), target) == 0


def test_quotes_and_extra_columns(spark, csv, path):
    text = 'land1,extra,kunnr,name1,ort01\nIE,1,Q-01,D\'Arcy Glas,Dublin\nDE,2,00001042,"A ""B"", C",Berlin\n'
    got = rows(read_records(spark, csv(text)), "kunnr", "name1", "ort01", "land1")
    assert got == [("00001042", 'A "B", C', "Berlin", "DE"), ("Q-01", "D'Arcy Glas", "Dublin", "IE")]
    target = path("corpus")
    load(spark, csv(text), target)
    q = spark.createDataFrame([(1, "D'Arcy")], "question_id int, intent string")
    assert rows(keyword_fallback(q, read_corpus(spark, target)), "id") == [("Q-01",)]
    assert load(spark, csv(text), target) == 0


def test_line_breaks_inside_quotes(spark, csv):
    text = HEADER + '1,"two\nlines",Berlin,DE\n'
    assert rows(read_records(spark, csv(text), multi_line=True), "name1") == [("two\nlines",)]


def test_headers_decide_in_every_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("kunnr,name1,ort01,land1\n1,Alpha,Kiel,DE\n")
    (tmp_path / "b.csv").write_text("land1,extra,kunnr,name1,ort01\nFR,x,2,Beta,Lyon\n")
    want = [("1", "Alpha", "Kiel", "DE"), ("2", "Beta", "Lyon", "FR")]
    assert rows(read_records(spark, str(tmp_path)), "kunnr", "name1", "ort01", "land1") == want
    typed = T.StructType([T.StructField("name1", T.StringType()), T.StructField("kunnr", T.IntegerType())])
    assert rows(register_csv(spark, str(tmp_path), "mixed", typed)) == [("Alpha", 1), ("Beta", 2)]
    (tmp_path / "c.csv").write_text("kunnr,name1\n3,Gamma\n")
    with pytest.raises(AnalysisException, match="ort01"):
        read_records(spark, str(tmp_path))


def test_embedding_is_spread(spark, path):
    """As many embedding tasks as shuffle partitions, however small the rows."""
    tasks = spark.sparkContext.accumulator(0)
    base = HashingEmbedder(16)

    def factory():
        tasks.add(1)
        return base

    records = spark.range(2000).select(
        F.col("id").cast("string").alias("kunnr"), *[F.lit("x").alias(c) for c in ("name1", "ort01", "land1")], F.col("id").alias("source_row")
    )
    assert ingest(records, path("corpus"), factory, order=["source_row"], per_task=True) == 2000
    assert tasks.value == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ingest_keeps_the_index(spark, csv, path):
    target, index = path("corpus"), path("index")
    line = "".join(f"{i},name {i},town {i % 3},DE\n" for i in range(30))
    assert load(spark, csv(HEADER + line), target, index_path=index) == 30
    more = "".join(f"{i},other {i},town {i % 5},FR\n" for i in range(20, 50))
    assert load(spark, csv(HEADER + more), target, index_path=index) == 20
    # What another writer added without the index is taken up as well.
    assert load(spark, csv(HEADER + "99,late,there,IT\n"), target) == 1
    assert load(spark, csv(HEADER + "99,late,there,IT\n"), target, index_path=index) == 0
    assert rows(read_index_keys(spark, index)) == rows(read_corpus(spark, target), "kunnr")
    assert load(spark, csv(HEADER + "1,only,here,IT\n"), target, index_path=index, overwrite=True) == 1
    assert rows(read_index_keys(spark, index)) == [("1",)]


def test_staged_tables_go_with_their_block(spark):
    with staging(spark):
        kept = stage(spark.range(5), "kept")
        folder = kept.inputFiles()[0].rsplit("/", 1)[0]
        assert kept.count() == 5 and path_exists(spark, folder)
    assert not path_exists(spark, folder)


def test_malformed_row_fails(spark, csv):
    with pytest.raises(Exception, match="(?i)malformed"):
        read_records(spark, csv(HEADER + "1,a,b,c,d,e\n")).collect()


def test_keys_stay_text(spark, csv):
    register_csv(spark, csv(HEADER + "00001042,A,B,DE\n"), "kept")
    assert spark.table("kept").first()["kunnr"] == "00001042"


def records(spark, *data):
    return spark.createDataFrame(list(data), "kunnr string, name1 string, ort01 string, land1 string, n int")


def test_steps(spark):
    df = records(spark, (None, "a", None, "DE", 2), ("1", None, "B", None, 1), (None, "z", "Q", "FR", 1))
    full = default_unknown(df)
    assert rows(full, "kunnr", "name1") == [("1", "Unknown"), ("Unknown", "a"), ("Unknown", "z")]
    assert rows(dedup_first(full, ["n"]), "kunnr", "name1") == [("1", "Unknown"), ("Unknown", "z")]
    assert rows(render_sentence(full), "sentence")[0] == (
        "Customer 1 is named Unknown and is located in B, Unknown.",
    )
    known = spark.createDataFrame([("1",), ("9",)], "kunnr string")
    assert rows(find_existing(df, known)) == [("1",)]
    assert rows(new_records(full, known), "name1") == [("a",), ("z",)]
    assert new_records(full, None).count() == 3


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_dedup_does_not_depend_on_partitions(spark, parts):
    data = [(str(i % 7) if i % 3 else "hot", f"n{i}", "c", "l", i) for i in range(200)]
    df = records(spark, *data).repartition(parts, "name1")
    want = {}
    for k, name, *_, n in data:
        want.setdefault(k, name)
    assert rows(dedup_first(df, ["n"]), "kunnr", "name1") == sorted(want.items())


def test_merge_never_updates(spark, path):
    target = path("corpus")
    create_corpus(spark, target)
    assert corpus_exists(spark, target) and not corpus_exists(spark, target + "-none")
    row = ("1", "a", "b", "s", [1.0])
    df = spark.createDataFrame([row, ("2", "a", "b", "s", [1.0])], CORPUS_SCHEMA)
    assert merge_insert(df, target) == 2
    assert merge_insert(df.withColumn("name", F.lit("changed")), target) == 0
    assert {r["name"] for r in read_corpus(spark, target).collect()} == {"a"}
    with pytest.raises(ValueError):
        write_corpus(df, target, "ignore")


@pytest.mark.parametrize("size", [0, -1, 1025])
def test_batch_bounds(spark, size):
    with pytest.raises(ValueError, match="between 1 and 1024"):
        embed(spark.range(1).select(F.lit("a").alias("sentence")), HashingEmbedder(), batch_size=size)


def test_embedding_is_per_text_and_batched(spark):
    def model(texts):
        assert len(texts) <= 7
        return HashingEmbedder(16)(texts)

    df = spark.range(50).select("id", F.concat(F.lit("word "), F.col("id")).alias("sentence"))
    a = rows(embed(df.repartition(3), model, batch_size=7), "id", "vector")
    assert a == rows(embed(df.coalesce(1), HashingEmbedder(16), batch_size=50), "id", "vector")
    b = rows(embed(df, lambda: HashingEmbedder(16), per_task=True), "id", "vector")
    assert a == b
    with pytest.raises(Exception, match="embedder returned"):
        embed(df, lambda texts: HashingEmbedder(16)(texts)[:-1]).collect()


def test_stream_equals_batch_and_replay_adds_nothing(spark, path):
    source, batch, stream = path("src"), path("corpus"), path("corpus")
    df = records(spark, *[(str(i % 40), f"n{i}", "c", "l", i) for i in range(60)]).coalesce(1)
    df.write.parquet(source)
    ingest(df, batch, HashingEmbedder(16), order=["n"])
    for _ in range(2):  # the second run has lost its progress and sees everything again
        arriving = spark.readStream.schema(df.schema).parquet(source)
        stream_ingest(arriving, stream, HashingEmbedder(16), path("progress"), order=["n"]).awaitTermination()
    assert rows(read_corpus(spark, stream)) == rows(read_corpus(spark, batch))


def test_questions_from_lines(spark, csv):
    assert rows(read_questions(spark, csv("  a b \r\n\n \t\nc \n"))) == [("a b",), ("c",)]


def test_shared_dir_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (configured.rstrip("/") if configured else spark.sparkContext.getCheckpointDir())
