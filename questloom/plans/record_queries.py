"""Registered queries for sources, sinks, the gate and ingest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questloom.functions.vectors import l2_normalize, vector_verdict
from questloom.models import HashingEmbedder, letter_counts
from questloom.operators.ann import build_vector_index, read_vector_index
from questloom.operators.gate import audit_statements, run_sql
from questloom.operators.ingest import (
    corpus_columns,
    dedup_first,
    default_unknown,
    embed,
    find_existing,
    ingest,
    merge_insert,
    new_records,
    render_sentence,
)
from questloom.plans.registry import query, views
from questloom.session import new_path, stage
from questloom.sources.corpus import read_corpus, write_corpus
from questloom.sources.keyed import BUCKETS, merge_keyed, open_keyed
from questloom.sources.tables import (
    SOURCE_ORDER,
    read_questions,
    read_records,
    register_csv,
    table,
    to_json_lines,
    write_json_lines,
)
from questloom.streaming.ingest_stream import stream_ingest

KNA1_SQL = """
    SELECT CAST(c_custkey AS VARCHAR) AS kunnr, c_name AS name1, c_mktsegment AS ort01, n_name AS land1
    FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
# Records with null keys (a third of the rows), null fields and many repeats of a key.
ORDER_RECORDS_SQL = """
    SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS kunnr,
           o_orderpriority AS name1, nullif(o_orderstatus, 'F') AS ort01, n_name AS land1, o_orderkey AS source_row
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""
SENTENCE_SQL = """'Customer ' || kunnr || ' is named ' || name1 || ' and is located in ' || ort01 || ', ' || land1 || '.'"""


def kna1(spark: SparkSession, folder: str) -> DataFrame:
    """The customer records of the given tables."""
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").cast("string").alias("kunnr"),
        F.col("c_name").alias("name1"),
        F.col("c_mktsegment").alias("ort01"),
        F.col("n_name").alias("land1"),
    )


def order_records(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return orders.join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string")).alias("kunnr"),
        F.col("o_orderpriority").alias("name1"),
        F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("ort01"),
        F.col("n_name").alias("land1"),
        F.col("o_orderkey").alias("source_row"),
    )


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """All records, with the given vectors where there is one: kunnr, name, city, sentence, vector."""
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("kunnr"), F.col("embedding").alias("vector")
    )
    return corpus_columns(render_sentence(kna1(spark, folder)).join(vectors, "kunnr", "left"))


CORPUS_SQL = f"""
    SELECT kunnr, name1 AS name, ort01 AS city, {SENTENCE_SQL} AS sentence, embedding AS vector
    FROM ({KNA1_SQL}) LEFT JOIN embeddings ON kunnr = CAST(vec_id AS VARCHAR)
"""


def customer_csv(spark: SparkSession, folder: str) -> str:
    """The customer records as CSV files, with a column too many and names that need quotes."""
    path = new_path(spark, "csv")
    kna1(spark, folder).select(
        "land1",
        "kunnr",
        F.concat(F.lit('"'), "name1", F.lit('", Inc.')).alias("name1"),
        F.length("name1").alias("extra"),
        "ort01",
    ).write.option("escape", '"').csv(path, header=True)
    return path


# --- sources and sinks ------------------------------------------------------


@query(
    "s1_register_csv",
    f"""
    SELECT land1, count(*) AS n, count(DISTINCT ort01) AS cities, max(kunnr) AS last_key
    FROM ({KNA1_SQL}) GROUP BY land1
    """,
)
def s1(spark: SparkSession, folder: str) -> DataFrame:
    register_csv(spark, customer_csv(spark, folder))
    return run_sql(
        spark,
        "SELECT land1, count(*) AS n, count(DISTINCT ort01) AS cities, max(kunnr) AS last_key"
        " FROM kna1 GROUP BY land1",
        max_rows=None,
    )


@query(
    "s2_read_records",
    f"""SELECT kunnr, '"' || name1 || '", Inc.' AS name1, ort01, land1 FROM ({KNA1_SQL})""",
)
def s2(spark: SparkSession, folder: str) -> DataFrame:
    return read_records(spark, customer_csv(spark, folder)).drop(*SOURCE_ORDER)


@query("s2_mixed_headers", f"SELECT kunnr, name1, ort01, land1 FROM ({KNA1_SQL})")
def s2_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """A folder whose files order their columns in two ways, one of them with a column more."""
    path, records = new_path(spark, "csv"), kna1(spark, folder)
    even = F.col("kunnr").cast("bigint") % 2 == 0
    records.filter(even).select("kunnr", "name1", "ort01", "land1").write.csv(path, header=True)
    records.filter(~even).select("land1", "ort01", F.lit("x").alias("more"), "name1", "kunnr").write.mode("append").csv(path, header=True)
    return read_records(spark, path).drop(*SOURCE_ORDER)


@query(
    "s3_write_corpus",
    f"SELECT kunnr, name, city, sentence, round(CAST(vector[1] AS DOUBLE), 6) AS first_element, len(vector) AS dim FROM ({CORPUS_SQL})",
)
def s3(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "corpus")
    write_corpus(corpus(spark, folder), path)
    return read_corpus(spark, path).select(
        "kunnr",
        "name",
        "city",
        "sentence",
        F.round(F.element_at("vector", 1).cast("double"), 6).alias("first_element"),
        F.size("vector").cast("bigint").alias("dim"),
    )


@query("s4_overwrite", f"SELECT kunnr, sentence FROM ({CORPUS_SQL})")
def s4(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "corpus")
    rows = corpus(spark, folder)
    write_corpus(rows, path, "overwrite")  # nothing there yet: not an error
    write_corpus(rows, path, "append")
    write_corpus(rows, path, "overwrite")
    return read_corpus(spark, path).select("kunnr", "sentence")


SPACE_SQL = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(
    "s5_read_questions",
    rf"""
    WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS value FROM conversations),
         trimmed AS (SELECT regexp_replace(value, '\A{SPACE_SQL}+|{SPACE_SQL}+\z', '', 'g') AS question FROM lines)
    SELECT question, count(*) AS n FROM trimmed WHERE question <> '' GROUP BY question
    """,
)
def s5(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "questions")
    table(spark, folder, "conversations").select("text").write.text(path)
    return read_questions(spark, path).groupBy("question").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s6_json_lines",
    """
    SELECT to_json({'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, 'l_returnflag': l_returnflag,
                    'l_linestatus': l_linestatus}) AS line, count(*) AS n
    FROM lineitem GROUP BY ALL
    """,
)
def s6(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "json")
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"
    )
    write_json_lines(rows, path)
    again = spark.read.schema(rows.schema).json(path)
    return to_json_lines(again).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


# --- the gate ---------------------------------------------------------------

R1_SQL = "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey"


@query("r1_run_sql", R1_SQL + " LIMIT 10000")
def r1(spark: SparkSession, folder: str) -> DataFrame:
    views(spark, folder, "orders")
    return run_sql(spark, R1_SQL + ";")


R2_SQL = """
    WITH lines AS (SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem WHERE l_returnflag = 'R')
    SELECT l_suppkey, CAST(sum(l_quantity) AS DOUBLE) AS returned, 'a;b -- DROP TABLE x' AS literal
    FROM lines GROUP BY l_suppkey
"""


@query("r2_guarded_select", R2_SQL)
def r2(spark: SparkSession, folder: str) -> DataFrame:
    views(spark, folder, "lineitem")
    return run_sql(spark, R2_SQL, max_rows=None)


R3_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem"
R3_ORDER = " ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"


@query("r3_row_cap", R3_SQL + R3_ORDER + " LIMIT 300")
def r3(spark: SparkSession, folder: str) -> DataFrame:
    views(spark, folder, "lineitem")
    return run_sql(spark, R3_SQL + R3_ORDER, max_rows=300)


# One statement per part, of a form chosen by its size; the check knows the form, not the text.
FORMS = [
    ("SELECT * FROM part WHERE p_name = '{}'", "OK"),
    ("select count(*) from part -- it's {}", "OK"),
    ("SELECT 'drop; table' AS a, \"{}\" AS b;", "OK"),
    ("WITH x AS (SELECT '{}' AS a) SELECT * FROM x", "OK"),
    ("WITH x AS (SELECT '{}' AS a) INSERT INTO part SELECT * FROM x", "NOT_QUERY"),
    ("FROM part INSERT INTO other SELECT '{}'", "NOT_QUERY"),
    ("DROP TABLE `{}`", "NOT_QUERY"),
    ("INSERT INTO part VALUES ('{}')", "NOT_QUERY"),
    ("COPY part TO '/{}'", "NOT_QUERY"),
    ("SELECT 1; DROP TABLE part /* {} */", "MULTIPLE"),
    ("BEGIN TRANSACTION; DELETE FROM part WHERE p_name = '{}'; COMMIT;", "MULTIPLE"),
    ("SELECT 1; /* {} */ SELECT 2", "MULTIPLE"),
    ("/* {} */ ;", "EMPTY"),
    ("-- {}", "EMPTY"),
    ("(SELECT p_name FROM part WHERE p_name LIKE '%{}%')", "OK"),
    ("VALUES (1, '{}')", "OK"),
]
R4_SQL = (
    "SELECT p_partkey, CASE p_size % 16 "
    + " ".join(f"WHEN {i} THEN '{verdict}'" for i, (_, verdict) in enumerate(FORMS))
    + " END AS verdict FROM part"
)


@query("r4_audit_statements", R4_SQL)
def r4(spark: SparkSession, folder: str) -> DataFrame:
    forms = F.array(*[F.lit(text) for text, _ in FORMS])
    statements = table(spark, folder, "part").select(
        "p_partkey",
        F.replace(
            F.element_at(forms, (F.col("p_size") % len(FORMS) + 1).cast("int")), F.lit("{}"), F.col("p_name")
        ).alias("sql"),
    )
    return audit_statements(statements).select("p_partkey", "verdict")


# --- ingest -----------------------------------------------------------------

FILLED_SQL = f"""
    SELECT coalesce(kunnr, 'Unknown') AS kunnr, coalesce(name1, 'Unknown') AS name1,
           coalesce(ort01, 'Unknown') AS ort01, coalesce(land1, 'Unknown') AS land1, source_row
    FROM ({ORDER_RECORDS_SQL})
"""
FIRSTS_SQL = f"""
    SELECT * EXCLUDE (place) FROM (
      SELECT *, row_number() OVER (PARTITION BY kunnr ORDER BY source_row) AS place FROM ({FILLED_SQL})
    ) WHERE place = 1
"""


@query("i1_default_unknown", FILLED_SQL)
def i1(spark: SparkSession, folder: str) -> DataFrame:
    return default_unknown(order_records(spark, folder))


@query("i2_render_sentence", f"SELECT source_row, {SENTENCE_SQL} AS sentence FROM ({FILLED_SQL})")
def i2(spark: SparkSession, folder: str) -> DataFrame:
    return render_sentence(default_unknown(order_records(spark, folder))).select("source_row", "sentence")


@query("i3_dedup_first", FIRSTS_SQL)
def i3(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_first(default_unknown(order_records(spark, folder)), ["source_row"])


@query(
    "i4_find_existing",
    f"""
    SELECT DISTINCT k.kunnr FROM ({ORDER_RECORDS_SQL}) r JOIN ({CORPUS_SQL}) k ON r.kunnr = k.kunnr
    """,
)
def i4(spark: SparkSession, folder: str) -> DataFrame:
    return find_existing(order_records(spark, folder), corpus(spark, folder))


@query(
    "i4_find_in_buckets",
    f"""
    SELECT DISTINCT k.kunnr FROM ({ORDER_RECORDS_SQL}) r JOIN ({CORPUS_SQL}) k ON r.kunnr = k.kunnr
    """,
)
def i4_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """The same lookup in a corpus in buckets, written in two commits."""
    path, rows = new_path(spark, "corpus"), corpus(spark, folder)
    even = F.col("kunnr").cast("bigint") % 2 == 0
    merge_keyed(rows.filter(even), path)
    merge_keyed(rows.filter(~even), path)
    return find_existing(order_records(spark, folder), open_keyed(spark, path))


@query(
    "i4_new_records",
    f"SELECT r.* FROM ({FILLED_SQL}) r WHERE NOT EXISTS (SELECT 1 FROM ({CORPUS_SQL}) k WHERE r.kunnr = k.kunnr)",
)
def i4_new(spark: SparkSession, folder: str) -> DataFrame:
    return new_records(default_unknown(order_records(spark, folder)), corpus(spark, folder))


# The stored corpus is the customers with a given vector; then all customers arrive.
MERGED_SQL = f"""
    SELECT kunnr, sentence FROM ({CORPUS_SQL})
    UNION ALL
    SELECT f.kunnr, 'late: ' || f.name1 FROM ({KNA1_SQL}) f
    WHERE NOT EXISTS (SELECT 1 FROM ({CORPUS_SQL}) k WHERE f.kunnr = k.kunnr)
"""


@query("i5_merge_insert", MERGED_SQL)
def i5(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "corpus")
    write_corpus(corpus(spark, folder), path)
    late = kna1(spark, folder).withColumn("sentence", F.concat(F.lit("late: "), "name1"))
    rows = corpus_columns(late, F.array(F.lit(1.0).cast("float")).alias("vector"))
    merge_insert(rows, path)
    merge_insert(rows, path)  # again: inserts nothing
    return read_corpus(spark, path).select("kunnr", "sentence")


def unit_letters_sql(text: str) -> str:
    """SQL for the unit-length letter counts of a text: what ``letter_counts`` and ``embed`` give."""
    counts = (
        "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''),"
        f" lambda c: CAST(length({text}) - length(replace({text}, c, '')) AS DOUBLE))"
    )
    norm = "(list_max(v) * sqrt(list_sum(list_transform(v, lambda x: pow(x / list_max(v), 2)))))"
    return (
        f"(SELECT CASE WHEN list_max(v) = 0 THEN list_transform(v, lambda x: CAST(x AS FLOAT))"
        f" ELSE list_transform(v, lambda x: CAST(x / {norm} AS FLOAT)) END FROM (SELECT {counts} AS v))"
    )


@query(
    "i6_embed",
    f"""
    SELECT doc_id, i - 1 AS place, round(CAST(vector[i] AS DOUBLE), 5) AS element
    FROM (SELECT doc_id, {unit_letters_sql("text")} AS vector FROM documents), unnest(range(1, 27)) AS r(i)
    """,
)
def i6(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", F.col("text").alias("sentence"))
    vectors = embed(documents, letter_counts).select("doc_id", F.posexplode("vector").alias("place", "element"))
    return vectors.select(
        "doc_id",
        F.col("place").cast("bigint").alias("place"),
        F.round(F.col("element").cast("double"), 5).alias("element"),
    )


@query(
    "i7_l2_normalize",
    """
    WITH scaled AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(x * (vec_id + label) AS FLOAT)) AS v FROM embeddings
    ), peaks AS (
      SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(CAST(x AS DOUBLE)))) AS peak FROM scaled
    ), norms AS (
      SELECT vec_id, v, peak,
             peak * sqrt(list_sum(list_transform(v, lambda x: pow(CAST(x AS DOUBLE) / peak, 2)))) AS norm FROM peaks
    )
    SELECT vec_id, i - 1 AS place,
           round(CAST(CASE WHEN peak = 0 THEN v[i] ELSE CAST(v[i] / norm AS FLOAT) END AS DOUBLE), 5) AS element
    FROM norms, unnest(range(1, 65)) AS r(i)
    """,
)
def i7(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(
        "vec_id",
        F.transform(
            "embedding", lambda x: (x * (F.col("vec_id") + F.col("label"))).cast("float")
        ).alias("v"),
    )
    return vectors.select(
        "vec_id", F.posexplode(l2_normalize(F.col("v"))).alias("place", "element")
    ).select(
        "vec_id", F.col("place").cast("bigint").alias("place"), F.round(F.col("element").cast("double"), 5).alias("element")
    )


@query(
    "i8_check_vectors",
    """
    SELECT vec_id, CASE WHEN label = 1 THEN 'NULL_VECTOR' WHEN label = 2 THEN 'BAD_DIMENSION'
                        WHEN label = 3 THEN 'NULL_ELEMENT' ELSE 'OK' END AS verdict
    FROM embeddings
    """,
)
def i8(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors damaged by label: missing, too short, with a hole, and whole ones."""
    damaged = (
        F.when(F.col("label") == 1, F.lit(None))
        .when(F.col("label") == 2, F.slice("embedding", 1, 63))
        .when(F.col("label") == 3, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(None).cast("float"))))
        .otherwise(F.col("embedding"))
    )
    return table(spark, folder, "embeddings").select("vec_id", vector_verdict(damaged, 64).alias("verdict"))


@query("i9_batch_bounds", "SELECT 2 AS dim, count(*) AS n FROM customer")
def i9(spark: SparkSession, folder: str) -> DataFrame:
    """Every record embedded by a model that fails if it is shown more than 100 texts at once."""

    def seen(texts: list[str]) -> np.ndarray:
        if len(texts) > 100:
            raise ValueError("batch bound broken")
        return np.ones((len(texts), 2))

    records = render_sentence(kna1(spark, folder))
    embedded = embed(records, seen, batch_size=100)
    return embedded.select(F.size("vector").alias("dim")).groupBy("dim").agg(F.count(F.lit(1)).alias("n"))


class Killed(Exception):
    """Stands for a writer that dies."""


@query("i5_commit_log", f"SELECT kunnr, sentence, CAST(1 AS BIGINT) AS version FROM ({MERGED_SQL})")
def i5_log(spark: SparkSession, folder: str) -> DataFrame:
    """All customers arrive in a corpus in buckets: the writer dies ahead of its commit, is run again, and comes twice."""
    path = new_path(spark, "corpus")
    merge_keyed(corpus(spark, folder), path, batch="given")
    late = kna1(spark, folder).withColumn("sentence", F.concat(F.lit("late: "), "name1"))
    rows = corpus_columns(late, F.array(F.lit(1.0).cast("float")).alias("vector"))

    def die() -> None:
        raise Killed

    try:
        merge_keyed(rows, path, batch="late", before_commit=die)
    except Killed:
        merge_keyed(rows, path, batch="late")
    merge_keyed(rows, path, batch="late")
    stored = open_keyed(spark, path)
    return stored.rows().select("kunnr", "sentence", F.lit(stored.version).cast("bigint").alias("version"))


INGESTED_SQL = f"""
    SELECT kunnr, name1 AS name, ort01 AS city, {SENTENCE_SQL} AS sentence, 64 AS dim FROM ({FIRSTS_SQL})
"""


def show_corpus(spark: SparkSession, path: str) -> DataFrame:
    return read_corpus(spark, path).select(
        "kunnr", "name", "city", "sentence", F.size("vector").alias("dim")
    )


@query("i10_ingest", INGESTED_SQL)
def i10(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "corpus")
    records = order_records(spark, folder)
    ingest(records, path, HashingEmbedder(), order=["source_row"], overwrite=True, dim=64)
    ingest(records, path, HashingEmbedder(), order=["source_row"])  # again: inserts nothing
    return show_corpus(spark, path)


@query(
    "i11_stream_ingest",
    f"SELECT kunnr, name1 AS name, ort01 AS city, {SENTENCE_SQL} AS sentence, 64 AS dim FROM ({KNA1_SQL})",
)
def i11(spark: SparkSession, folder: str) -> DataFrame:
    """Customer records arrive as a stream of files, each of them twice."""
    source, path = new_path(spark, "arrivals"), new_path(spark, "corpus")
    records = kna1(spark, folder).withColumn("source_row", F.col("kunnr").cast("bigint"))
    records.write.parquet(source)
    records.write.mode("append").parquet(source)
    arriving = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 2).parquet(source)
    running = stream_ingest(
        arriving, path, HashingEmbedder(), new_path(spark, "progress"), order=["source_row"]
    )
    running.awaitTermination()
    return show_corpus(spark, path)


@query(
    "i11_stream_in_buckets",
    f"SELECT kunnr, name1 AS name, ort01 AS city, {SENTENCE_SQL} AS sentence, 64 AS dim FROM ({KNA1_SQL})",
)
def i11_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Customer records arrive twice as a stream, into a corpus in buckets; then the stream loses its progress."""
    source, path = new_path(spark, "arrivals"), new_path(spark, "corpus")
    records = kna1(spark, folder).withColumn("source_row", F.col("kunnr").cast("bigint"))
    records.write.parquet(source)
    records.write.mode("append").parquet(source)
    for _ in range(2):
        arriving = spark.readStream.schema(records.schema).parquet(source)
        stream_ingest(
            arriving, path, HashingEmbedder(), new_path(spark, "progress"), order=["source_row"], buckets=8
        ).awaitTermination()
    return show_corpus(spark, path)


@query(
    "i12_key_layout",
    f"SELECT kunnr, sentence FROM ({INGESTED_SQL}) WHERE kunnr >= '20' AND kunnr < '30'",
)
def i12(spark: SparkSession, folder: str) -> DataFrame:
    """A key range read back from the corpus: files hold narrow key ranges, so most are skipped."""
    path = new_path(spark, "corpus")
    ingest(order_records(spark, folder), path, HashingEmbedder(), order=["source_row"])
    return read_corpus(spark, path).filter("kunnr >= '20' AND kunnr < '30'").select("kunnr", "sentence")


# The customers of the ten dearest orders, each in the bucket that its key's digest names.
DEAREST_SQL = f"""
    SELECT DISTINCT kunnr, CAST('0x' || substr(md5(kunnr), 1, 8) AS BIGINT) % {BUCKETS} AS bucket FROM (
        SELECT CAST(o_custkey AS VARCHAR) AS kunnr FROM orders WHERE o_orderstatus <> 'P'
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 10
    )
"""


@query(
    "i12_files_for_keys",
    f"""
    SELECT kunnr, sentence, (SELECT count(DISTINCT bucket) FROM ({DEAREST_SQL})) AS buckets_read, true AS fewer_files
    FROM ({INGESTED_SQL}) WHERE kunnr IN (SELECT kunnr FROM ({DEAREST_SQL}))
    """,
)
def i12_files(spark: SparkSession, folder: str) -> DataFrame:
    """The records of ten keys, with how many buckets were read for them and whether these are not all files."""
    path = new_path(spark, "corpus")
    ingest(order_records(spark, folder), path, HashingEmbedder(), order=["source_row"], buckets=BUCKETS)
    orders = table(spark, folder, "orders").filter("o_orderstatus <> 'P'")
    dearest = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
    keys = stage(dearest.select(F.col("o_custkey").cast("string").alias("kunnr")).distinct(), "keys")
    stored = open_keyed(spark, path)
    found = stored.holding(keys)
    read = found.inputFiles()
    buckets = {part for name in read for part in name.split("/") if part.startswith("key_bucket=")}
    return found.join(keys, "kunnr", "left_semi").select(
        "kunnr",
        "sentence",
        F.lit(len(buckets)).cast("bigint").alias("buckets_read"),
        F.lit(len(read) < stored.files().count()).alias("fewer_files"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """All given vectors: kunnr, vector."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("kunnr"), F.col("embedding").alias("vector")
    )


def indexed(spark: SparkSession, folder: str, cells: int | None = 16) -> tuple[DataFrame, DataFrame]:
    path = new_path(spark, "index")
    build_vector_index(vectors(spark, folder), path, cells)
    return read_vector_index(spark, path)


@query(
    "i13_vector_index",
    "SELECT CAST(vec_id AS VARCHAR) AS kunnr, len(embedding) AS dim, true AS in_a_cell FROM embeddings",
)
def i13(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector is in the index once, in one of the cells."""
    rows, _ = indexed(spark, folder)
    return rows.select(
        "kunnr", F.size("vector").cast("bigint").alias("dim"), F.col("cell").between(0, 15).alias("in_a_cell")
    )
