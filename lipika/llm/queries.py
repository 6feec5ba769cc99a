"""The registered queries of the ten operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lipika.llm import langid, lines, lzprint, media, mixing, packing, sharding, simhash, substrings, toxicity
from lipika.llm.common import new_dir, small_batches, table

#: Name of the vocabulary file; the folder is the installed package's.
VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "media")
    media.write_archives(table(small_batches(spark), sf_dir, "documents"), path)
    return media.media_features(media.read_archives(spark, path))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(small_batches(spark), sf_dir, "documents"), vocabulary())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_page_lines(table(spark, sf_dir, "pages"))


def op4_lempel_ziv_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.fingerprints(table(small_batches(spark), sf_dir, "documents"))


def source_domain() -> Column:
    """Sources up to number 11 are the web, the others the library; a source without number is neither."""
    n = F.regexp_extract(F.coalesce("source", F.lit("")), r"^src(\d{1,6})$", 1)
    return F.when(n == "", "other").when(n.cast("int") < 12, "web").otherwise("library")


SOURCE_DOMAIN_SQL = r"""CASE WHEN regexp_extract(coalesce(source, ''), '^src(\d{1,6})$', 1) = '' THEN 'other'
  WHEN CAST(regexp_extract(coalesce(source, ''), '^src(\d{1,6})$', 1) AS INTEGER) < 12 THEN 'web' ELSE 'library' END"""


#: Weights of the training mix: English first, the library above its size, the largest source below its own.
MIX = mixing.Node(
    children={
        "web": mixing.Node(0.6, {"en": mixing.Node(0.55, {"src0": mixing.Node(0.5)}), "de": mixing.Node(0.15, {"src0": mixing.Node(0.5)}), "fr": mixing.Node(0.15), "es": mixing.Node(0.15)}, 0.05),
        "library": mixing.Node(0.4, {"en": mixing.Node(0.5), "de": mixing.Node(0.2), "fr": mixing.Node(0.15), "es": mixing.Node(0.15)}, 0.05),
        "other": mixing.Node(0.05),
    }
)
MIX_SEED = 20_240_607


def op5_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(small_batches(spark), sf_dir, "documents"), MIX, source_domain(), 0.75, 4, MIX_SEED)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(small_batches(spark), sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(small_batches(spark), sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(small_batches(spark), sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(small_batches(spark), sf_dir, "documents"))


def op10_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(small_batches(spark), sf_dir, "documents"), 40)


QUERIES = (
    op1_media_columns,
    op2_harmonic_packing,
    op3_line_dedup,
    op4_lempel_ziv_fingerprints,
    op5_hierarchical_mixing,
    op6_toxicity,
    op7_language_id,
    op8_substring_dedup,
    op9_simhash_near_dedup,
    op10_jump_sharding,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": lines.PAGES_SQL, "op5_hierarchical_mixing": mixing.mix_sql(MIX, SOURCE_DOMAIN_SQL, 0.75, 4, MIX_SEED)}
