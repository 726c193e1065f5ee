"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept; its decisions take effect: what it rejects is gone, what the mix
repeats is there as often. All but the last return the columns of documents, whatever other columns there are and
whatever their names. Ids may be null or repeated: rows are told apart by their place in the table. Each stage gives
an empty table for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm import exact, langid, mixing, packing, simhash
from corpuscle.llm.common import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a probability of 0.4 or more. Null and empty texts and those without a letter
    go; long texts are read whole; a null language is not learned from. Repeated rows stay or go together. Where no row
    has a language nothing can be told, and all that have a letter stay."""
    return langid.accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space, the longest, of equals the one with the smallest
    id, null ids last, of wholly repeated rows any one. Null counts as empty."""
    return exact.without_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of five-word shingles: the one with the smallest id,
    null ids last. Rows equal in id and text stay or go together. Null counts as empty; texts without words are alike, and
    of fewer than five words the whole sequence is the shingle."""
    return simhash.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream by position: rows as often as their source's target takes them, each repeated row on its own. Null
    and empty texts have no word and are never taken; a null source is a source of its own."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words, a row for each piece. Copies of a document that the mix repeats never share a bin; two null sources
    don't conflict; longer documents are cut; texts without a word get no bin."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: SQL expresses neither the classifier nor best fit; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
