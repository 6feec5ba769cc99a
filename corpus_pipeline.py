"""The corpus pipeline: documents through five stages of the operators in ``lipika.llm``.

Each stage works on all that the one before kept; its result is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lipika.llm import langid, lines, mixing, packing, queries, simhash
from lipika.llm.common import materialize, small_batches, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents whose language cannot be told go."""
    small_batches(spark)
    return langid.keep_identified(docs)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that are boilerplate of a source go; the documents stay."""
    return lines.drop_boilerplate_lines(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup over five-word shingles, at a similarity of 0.8: one document of each group stays."""
    small_batches(spark)
    return simhash.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: three quarters of the tokens stay, each document at most once."""
    return mixing.keep_mixed(docs, queries.MIX, queries.source_domain(), 0.75, queries.MIX_SEED)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Harmonic packing into sequences of 2048 tokens; pieces have their ids."""
    small_batches(spark)
    return packing.pack_pieces(docs, queries.vocabulary()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", identify),
    ("line_dedup", clean_lines),
    ("simhash_near_dedup", deduplicate),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Language ID and SimHash have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages.

    A null or empty text has no language and goes in the first stage; documents with a null key stay if they are alike to no other; repeated rows are
    alike in key and text and stay together; an empty table gives an empty result; other columns are carried to the last stage and ignored, whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
