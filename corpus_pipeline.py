"""A corpus pipeline: language ID, toxicity, near duplicates, packing, each over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notelake.llm import jaccard, langid, packing, toxicity
from notelake.llm.common import stash, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null and empty texts and those without a letter go, repeated rows stay or go alike."""
    return langid.keep_identified(docs, langid.fit(docs, langid.learn_rows()))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.3; null and empty texts have the lowest score, repeated rows stay or go alike."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: 5-word shingles, Jaccard 0.8 or more.

    Operator 5's fingerprints and vantage-point trees, then min-hash keys, give the candidates. Texts without a word
    are copies of each other, of repeated rows one stays, and documents without an id come last.
    """
    return jaccard.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 1024 tokens; a null or empty text is its end token, repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Learned scores, components and the packing plan can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
