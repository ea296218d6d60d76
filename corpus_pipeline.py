"""A corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept: low quality goes, one of
each group of near duplicates stays, repeated passages go from later documents, documents with
benchmark passages go, and what is left is tokenised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import bpe, decontaminate, quality, registry, simhash, suffix
from driftwell.llm.common import stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.read(spark, sf_dir, "documents").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among docs, accepts."""
    weights = quality.train(docs, registry.read(spark, sf_dir, "labels"))
    return quality.accepted(docs.select(*COLUMNS), weights)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of documents whose five-word shingles are 0.8 similar or more."""
    return simhash.keep_similar_one(docs.select(*COLUMNS), words=5, similarity=0.8)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that start in an earlier document; n_chars counts what is left."""
    return suffix.without_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), registry.read(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return bpe.encode_digests(docs, registry.vocabulary_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", tokenise),
]

#: No stage can be stated in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs)
    return docs
