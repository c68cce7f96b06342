"""All queries of the core, by name, with the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalens.operators import forms, orphans, snapshots
from stratalens.plans import reference
from stratalens.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of files between consecutive snapshots."""
    return snapshots.diff(table(spark, sf_dir, "manifest"))


def p2_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the changed fields of modified files."""
    return snapshots.changes(table(spark, sf_dir, "manifest"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of elements and handlers of forms."""
    return forms.found(table(spark, sf_dir, "form_info"))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of the latest deliveries."""
    return forms.forms(table(spark, sf_dir, "form_info"))


def p4_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of forms with their parents."""
    return forms.elements(table(spark, sf_dir, "form_info"))


def p4_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands and dynamic lists of forms."""
    return forms.commands(table(spark, sf_dir, "form_info"))


def _references(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, name) for name in ("membership", "universe", "subsystem", "metadata_kind")]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to what is not there."""
    return orphans.found(*_references(spark, sf_dir))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Such references per table, month and reason."""
    return orphans.counts(*_references(spark, sf_dir))


def queries() -> dict[str, Query]:
    """Every query of the core."""
    own = (p2_found, p2_changes, p4_found, p4_forms, p4_elements, p4_commands, p5_found, p5_counts)
    return {q.__name__: q for q in own} | reference.QUERIES


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {
        "p2_found": f"select repo, gen, rel_path, diff_kind from ({snapshots.diff_sql()})",
        "p2_changes": snapshots.diff_sql(),
        "p4_found": forms.FOUND_SQL,
        "p4_forms": forms.FORMS_SQL,
        "p4_elements": forms.ELEMENTS_SQL,
        "p4_commands": forms.COMMANDS_SQL,
        "p5_found": orphans.orphans_sql(orphans.FOUND_SQL),
        "p5_counts": orphans.orphans_sql(orphans.COUNTS_SQL),
    } | reference.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query behind ``entry``: ranked search over the corpus."""
    return reference.search_smart_topk(spark, sf_dir)
