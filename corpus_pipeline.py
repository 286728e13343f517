"""From raw documents to packed training bins, by five operators of ``loam.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loam.llm.exact import drop_exact_duplicates
from loam.llm.langid import keep_identified
from loam.llm.mixing import mixed
from loam.llm.packing import pack
from loam.llm.simhash import drop_near_duplicates
from loam.session import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told from their text.

    Null and empty texts, and those without a letter, go; where nothing is labelled, all do. Long texts
    are read whole. Of labels that fit equally well the first counts. Repeated rows are judged
    each. Columns of other names pass; an empty table stays empty.
    """
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, A-Z in either case: that with the largest id, a null id being the least.

    Null texts count as empty. Long texts are compared whole. Of rows that repeat id and text one stays. Columns
    of other names pass; an empty table stays empty.
    """
    return drop_exact_duplicates(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least id: shingles of five words, similarity 0.8.

    Texts without words, null ones included, are one class. Long texts count whole. Ids may be null or
    repeat. Columns of other names pass; an empty table stays empty.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for, by hashes of their ids.

    A null source is a source of its own, a null id hashes as an empty text, a null text has no words.
    Rows that repeat an id are taken equally often. Columns of other names pass; an empty table
    stays empty.
    """
    return mixed(docs, weights=(5, 2, 1), share=1.5, cap=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document, and of each part of a long one, in bins of 4096 words.

    Null and empty texts take a place of size 0, null sources are one source, null ids come last among
    their size, rows that repeat a text don't share a bin. An empty table has no bins.
    """
    return pack(docs, capacity=4096, per_source=4)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: A trained model, a similarity search and a sequential packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over all documents; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
