"""Corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, decontamination, packing.

Every stage works on all that its predecessor kept; all but the last return
the columns of ``documents``, whatever their names and number.

In all stages a null text counts as empty, texts may have any length, a row
with a null doc_id is a document like any other, and empty tables give empty
results. Rows repeated with one doc_id and text are one document from the
second stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity
from tracelake.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 stay; the model learns from the labels of the documents given.

    Empty and null texts have no toxic passage and stay; without labels of
    both kinds all documents stay. Rows are judged one by one, so repeated ones alike.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.clean(docs, toxicity.train(docs.select("doc_id", "text"), labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, the one with the largest doc_id; null ids rank lowest.

    All null and empty texts are one text. Of rows repeated with one doc_id and
    text the least by the hash of the whole row stays.
    """
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at similarity 0.8 stays, the one with the least doc_id.

    Texts without words are linked with nothing and stay, as do rows with a null doc_id.
    """
    return jaccard_join.keep_one(docs, n=5, num=80, den=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item go; null and empty texts and items match nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece of a document; an empty or null text is the end token alone."""
    return packing.pack(docs.select("doc_id", "text"), keep_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]

#: Learned scores, signatures and a linear program: no SQL expresses the rows; tests/llm/test_pipeline.py checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``: the rows of the last one. Between stages documents are written to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
