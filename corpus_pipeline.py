"""A corpus made ready for training: quality rules, language, near duplicates, repeated passages, packing.

Each stage takes what the one before kept and returns it with the columns of `documents`; the last returns pieces. An
empty table gives an empty result in every stage, and columns beside doc_id, text, lang and n_chars go through
untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import langid, packing, quality, rlindex, simhash
from lattica.llm.common import crc_rest, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts have too few words and go; equal texts go or stay together."""
    return quality.keep_clean(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose words' languages are clear, in one language or several; the model learns from labelled ones among them.

    Null and empty texts have no letter and go; without any label there is nothing to learn and every document stays.
    """
    return langid.keep_identified(docs, langid.train(docs, crc_rest("doc_id", 4) != 2))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id, of each group of near duplicates. Texts without a word are such a group; rows that repeat a doc_id are one document, of which one row stays; rows without doc_id stay."""
    return simhash.keep_first(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller doc_id holds. Null texts stay null; a text that is all such passages stays, empty. n_chars follows the text."""
    return rlindex.cleaned(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences. A null or empty text is its end id alone; each row is packed, also where doc_ids repeat."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs


#: Models and fuzzy links can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
