"""From raw documents to packed training windows, in five stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bidspan.llm import lines, mixing, packing, quality, simhash
from bidspan.llm.common import Settled, table
from bidspan.llm.queries import vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the model is fitted on the labelled ones that are there."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that 5 documents share stay in one of them only."""
    return lines.without_shared_lines(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest id."""
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix reads it; the row in which a source meets its target is cut there."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in windows of 1024 token ids."""
    return packing.pack_documents(docs, **vocabulary())


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", without_shared_lines),
    ("simhash_near_dedup", without_near_copies),
    ("mix_sources", mixed),
    ("packing", packed),
]

#: A learned classifier has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is settled in the shared folder."""
    settle = Settled(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
