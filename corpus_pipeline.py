"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet to the shared folder and
gives the next stage what it reads back. All stages but the last return the columns that came in, whatever their names. Nulls, repeated rows
and doc_ids, empty and very long texts and empty tables are handled as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import decontam, mixing, neardup, quality_rules, queries, tokens
from folioflow.llm.common import Scratch, free_names, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without the lines that fail; null and empty texts go."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest doc_id; rows with null texts all stay."""
    return neardup.keep_one_per_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``; null and empty texts stay, a null or empty item finds nothing."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """About as many rows as documents come in, at the target weights of their sources; a document stands once for each copy.

    A null or unnamed source counts as ``*``. A document whose count is 0 has no row.
    """
    names = tuple(free_names(docs, "copy", "n_copies"))
    return mixing.mix(docs, queries.WEIGHTS, seed=queries.MIX_SEED, named=names).drop(*names)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files in ascending doc_id order, read back: every copy's ids and where they start. A null text is the end id alone."""
    path = tokens.encode_to_files(spark, docs, keep=("source",))
    return tokens.read_token_files(spark, path).select("doc_id", "source", "start", "n_tokens", "tokens")


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("token_files", token_files)]

#: Order MinHash candidates, random walks and the vocabulary's merges have no SQL form; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    tables = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tables.save(stage(spark, docs, sf_dir), name)
    return docs
