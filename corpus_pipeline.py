"""A training-corpus pipeline over `documents`: each stage works on what the one before it kept.

The quality classifier drops documents that it rejects, exact and near duplicates leave one
document of each group, the mix takes documents of each source as often as its target asks for,
and the last stage encodes them. Each stage takes (spark, docs, sf_dir) and returns a DataFrame;
all but the last return the columns of docs. run() writes every stage's rows into the shared
folder and reads them again, so a lost executor costs no more than the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellflow.llm import bpe, exact_dedup, mixing, quality_classifier, simhash
from cellflow.llm.common import documents, labels, stored
from cellflow.llm.queries import vocabulary


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier accepts; it is trained on those of docs that have labels."""
    model = quality_classifier.train(docs.select("doc_id", "text"), quality_classifier.graded(labels(spark, sf_dir)))
    return quality_classifier.accepted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest doc_id."""
    return exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's tokens and of the text decoded from them."""
    return bpe.digests(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", classify_quality),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The classifier and the tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents in sf_dir."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{number}")
    return docs
