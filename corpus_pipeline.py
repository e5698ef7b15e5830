"""The corpus pipeline over documents: good prose, one of each group of near copies, no repeated passages, no personal
data, packed token sequences.

Each stage gets what its predecessor kept, written as Parquet and read back; all but the last return the columns of
``documents``. Nulls, empty and repeated texts and empty tables are handled as the operators say; documents without an id
are kept by the near-duplicate and passage stages, and extra columns pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forewarn.llm import near_dedup, packing, pii, substring_dedup, weak_labels
from forewarn.llm.common import stage_table, table


def _counted(docs: DataFrame, before: DataFrame) -> DataFrame:
    """``n_chars`` brought up to date after a change of texts, in its old type."""
    if "n_chars" not in before.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(before.schema["n_chars"].dataType))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer accepts."""
    scorers = weak_labels.fit_scorers(docs, table(spark, sf_dir, "labels"))
    return weak_labels.keep_good(docs, scorers)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the least id."""
    groups = near_dedup.near_duplicate_groups(docs)
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    return _counted(substring_dedup.without_passages(docs), docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _counted(pii.redact(docs, pii.pattern_table(docs)), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("substring dedup", substring_dedup_stage),
    ("PII", pii_stage),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Fitting, tokenising and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
