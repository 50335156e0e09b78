"""From raw documents to packed training sequences: quality, near duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return
the columns of documents. ``run`` writes each stage's rows to the shared folder and reads them again, so a lost
executor never costs more than the stage at work.

Defined results of all stages: an empty table gives an empty one, null ids, sources and texts pass as the operators say, further columns stay, also those with names
that the operators use themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import common, mixing, packing, quality, secret_scan, simhash_wide
from marlstone.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is high enough, by a model fitted to the rated ones among them. Without ratings all stay; a null or
    empty text has the probability of a document without features; repeated rows stay or go together."""
    return quality.selected(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): that with the least id, a null id being the last. Documents without words are
    one group; a repeated row stays once."""
    return simhash_wide.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found in them (encoded ones too) masked; null texts stay null."""
    return secret_scan.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture of their sources takes them, equal rows together as often as that many different ones. Documents without words, null texts
    with them, are left out; null sources are one source."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, repetitions included, with their places in the training sequences. A null text is the single id 0."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained weights, fingerprints and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = common.written(docs)
    return docs
