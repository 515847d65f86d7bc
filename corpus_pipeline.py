"""The pipeline from documents to token ids, made of the operators of ``questloom.llm``.

Each stage takes the documents that the one before kept and returns those that it keeps, with the columns of
``documents``; the last returns their token ids.  Stages are written to the shared folder between each other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questloom.llm import exact_dedup, mixing, ngram_join, pieces, quality_rules
from questloom.llm.common import read
from questloom.llm.queries import PIECES
from questloom.session import stage


def pass_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the fixed rules and the proven cutoffs of their language let pass."""
    return quality_rules.good_documents(docs, read(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts connected by similarity the one with the smallest id."""
    return ngram_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source so often that the sources have their shares of words."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, packed ids, and the digest of the text decoded from them."""
    model = public_tokenizers.path(PIECES)
    decoded = pieces.decode(pieces.encode(docs, model).select("doc_id", "ids"), model)
    return decoded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality rules", pass_quality_rules),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL can't express the near copies' groups nor the encoding; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
