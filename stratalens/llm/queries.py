"""Queries over the text corpus, by name, and the SQL that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import bpe, langid, lookalikes, mixing, validity
from stratalens.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows whose texts only look the same."""
    return lookalikes.found(table(spark, sf_dir, "path_entry"), table(spark, sf_dir, "subsystem"))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every text, with its mixed and whole-script words."""
    return lookalikes.forms(table(spark, sf_dir, "path_entry"), table(spark, sf_dir, "subsystem"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files that are not valid or no form."""
    return validity.found(table(spark, sf_dir, "source_file"))


def p3_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both flags of every file, and its first error."""
    return validity.flags(table(spark, sf_dir, "source_file"))


def p3_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error of every file."""
    return validity.errors(table(spark, sf_dir, "source_file"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of flagged files per repo and language."""
    return validity.rates(table(spark, sf_dir, "source_file"))


def p3_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted files per language."""
    return validity.acceptance(table(spark, sf_dir, "source_file"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the public vocabulary."""
    return bpe.encode(table(spark, sf_dir, "documents"), ["doc_id"])


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the number of times each is used in the mix."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target")).documents


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in the mix."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target")).shares()


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document (segment 0) and of the paragraphs of mixed ones."""
    return langid.identify(table(spark, sf_dir, "documents"), ["doc_id"]).drop("mixed")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of mixed documents, and documents whose label is missing or wrong."""
    label = langid.label_language("lang").alias("label")
    found = langid.identify(table(spark, sf_dir, "documents"), ["doc_id", label])
    wrong = ~F.col("mixed") & F.col("lang").isNotNull() & ~F.col("label").eqNullSafe(F.col("lang"))
    return found.where(wrong | (F.col("segment_no") > 0)).select("doc_id", "segment_no", "lang")


def queries() -> dict[str, Query]:
    """Every query of this subpackage."""
    own = (p1_found, p1_forms, p3_found, p3_flags, p3_errors, p3_rates, p3_acceptance, p6_ids, p7_mix, p7_shares, p8_found, p8_segments)
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {}
