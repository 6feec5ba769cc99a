"""Alphabets as tables, and readers for test corpora and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lipika.functions import alphabets as A, kernel


def script_catalog(spark: SparkSession) -> DataFrame:
    """(name, script, kind, is_vedic, is_alias): scripts, aliases and the source ``indic``."""
    rows = [(n, s.name, s.kind, s.vedic, n != s.name) for n in A.supported_names() if n != "indic" for s in [A.find(n)]]
    return spark.createDataFrame([*rows, ("indic", "indic", "indic", True, False)], "name string, script string, kind string, is_vedic boolean, is_alias boolean")


def alphabet(spark: SparkSession) -> DataFrame:
    """(script, class, idx, glyph) of all scripts."""
    rows = [(s.name, A.CLASSES[c], i, g) for s in A.scripts().values() for c, row in enumerate(s.glyphs) for i, g in enumerate(row)]
    return spark.createDataFrame(rows, "script string, class string, idx int, glyph string")


def spellings(spark: SparkSession, source: str) -> DataFrame:
    """(spelling, sub, class, idx, kind): what a source's reader knows; compounds have several tokens."""
    rows = [(k, n, A.CLASSES[t[0]], t[1], t[2]) for k, ts in kernel.reader(source).spellings.items() for n, t in enumerate(ts)]
    return spark.createDataFrame(rows, "spelling string, sub int, class string, idx int, kind string")


CASE = "description string, type string, script string, text string, targets array<struct<script:string,text:string,options:string>>"


def test_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON corpus (an array of objects, comments allowed), one row each."""
    return spark.read.option("multiLine", True).option("allowComments", True).schema(CASE).json(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row for each file."""
    from pyspark.sql import functions as F

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
