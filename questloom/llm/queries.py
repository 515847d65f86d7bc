"""The registered queries of this subpackage: each operator over its whole table, as the contracts have it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questloom.llm import checks, collocations, exact_dedup, merkle, mixing, ngram_join, packing, pieces, quality_net, quality_rules, secrets, site_style, token_counts, url_filter
from questloom.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_site_style(spark: SparkSession, folder: str) -> DataFrame:
    return site_style.extract(read(spark, folder, "pages"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_classes(read(spark, folder, "documents"))


#: Fixed: the rules of the contract.
URL_RULES = (
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
)


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The list: the addresses of pages whose transfer broke off, so that no form of them is fetched again."""
    pages = read(spark, folder, "pages")
    broken = pages.where(~F.col("html").contains("</html>")).select("url")
    return url_filter.judge_urls(pages, broken, URL_RULES).drop("checked")


#: Public vocabularies, by name.
RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    initial, inside = token_counts.rank_file_pieces(public_tokenizers.path(RANKS))
    return token_counts.count_tokens(read(spark, folder, "documents"), initial, inside)


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_classes(read(spark, folder, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mix(read(spark, folder, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.judge(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return found.drop("stratum")


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = secrets.scan_all(read(spark, folder, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in ("assign", "access", "hex")],
        F.sha2(secrets.digest_text(base), 256).alias("base_sha256"),
        secrets.digest_text(F.col("spans")).alias("spans"),
    )


def op9_quality_net(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from four fifths of the labels, told by a checksum of the id, and scores all documents."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    found = quality_net.classify(read(spark, folder, "documents"), read(spark, folder, "labels"), fold != 0)
    return found.select(
        "doc_id", (fold == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path(PIECES)
    encoded = pieces.encode(read(spark, folder, "documents"), model)
    encoded = encoded.select("doc_id", "ids", F.try_element_at("ends", F.lit(-1)).cast("long").alias("n_bytes"))
    return pieces.decode(encoded, model).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_bytes",
    )


#: A public byte-level vocabulary for the tokenizers library.
BYTES = "byte_bpe_50k.json"


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    found = packing.pack(read(spark, folder, "documents"), public_tokenizers.path(BYTES), capacity=2048, end_id=1)
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read(spark, folder, "documents"), longest=5, least=100, top=2000)


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Of every seventh checksum of an id the document is checked with a wrong number of characters."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    n_chars = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.manifest(read(spark, folder, "documents"), altered={"n_chars": n_chars})


QUERIES: dict[str, Query] = {
    "op1_site_style": op1_site_style,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_token_counts": op4_token_counts,
    "op5_ngram_join": op5_ngram_join,
    "op6_mixing": op6_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_secrets": op8_secrets,
    "op9_quality_net": op9_quality_net,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_packing": op11_packing,
    "op12_collocations": op12_collocations,
    "op13_merkle_manifest": op13_merkle_manifest,
}

CHECKS: dict[str, str] = {
    "op2_exact_dedup": checks.OP2,
    "op3_url_filter": checks.OP3,
    "op6_mixing": checks.OP6,
    "op7_quality_rules": checks.OP7,
    "op8_secrets": checks.OP8,
    "op13_merkle_manifest": checks.OP13,
}
