"""The corpus pipeline: documents through five operators, each stage written and read again.

Every stage takes null in any column, empty and very long texts, repeated rows, extra columns and empty tables; an
empty table stays empty, and all but the last return the columns of the documents they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import bpe, lines, mixing, simhash, toxicity
from shelfmark.llm.queries import vocabulary
from shelfmark.plans.registry import table
from shelfmark.session import cut


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar does not find toxic; it learns from those of them that have labels.

    Null and empty texts stay; rows equal in text go or stay together.
    """
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; ``n_chars`` is that of the text left.

    Every document stays, also one without lines; null texts stay null.
    """
    return lines.dedup(docs, length="n_chars")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints, of three-word shingles, link at two bits or fewer.

    That with the smallest id stays, null last, of rows equal in id one. Null and empty texts are one group.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Rows of a null source are a source; texts without words have no size.
    """
    return mixing.mixed(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the documents: their number, their digest and that of the text that they decode to.

    A row for each row; null counts as empty.
    """
    return bpe.digests(docs, vocabulary())


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("encode_bpe", encode_bpe),
]

# Learned scores and XXH64 have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
