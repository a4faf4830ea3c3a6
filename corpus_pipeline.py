"""A training-data pipeline over the documents table: classify, deduplicate, decontaminate, mask, tokenise.

Every stage takes rows as they come: a null text counts as empty (and stays null), rows that repeat a doc_id or
have none are judged each by itself, other columns are passed on, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, decontam, near_dedup, pii, quality_gam
from tessera.llm.common import durable, table
from tessera.llm.queries import tokenizer
from tessera.session import documents, scratch, shared_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels table, does not reject. Rows of one text fare alike; empty texts are scored too."""
    return quality_gam.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id in each group of near-duplicates (five-word shingles, similarity 0.8 or more).

    Of equal ids the lesser text stays, null ids come first. Texts without words are near nothing and all stay.
    """
    return near_dedup.dedup_documents(docs, words=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item. Texts without words stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked in text and n_chars counted anew. Null texts stay null."""
    return pii.mask_documents(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of every document; a null or empty text has no tokens."""
    return byte_bpe.bpe_round_trip(docs, *tokenizer())


STAGES = [("quality classifier", good_quality), ("near-dedup", one_of_each_group), ("decontamination", without_benchmark), ("pii", masked), ("byte bpe", tokenised)]

#: SQL cannot express the classifier, the model spans or the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written and read again; what a stage wrote besides goes when it is done."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        kept = shared_dir(spark)
        with scratch(spark):
            docs = durable(stage(spark, docs, sf_dir), f"stage{i}", kept)
