"""Problem 3: source files that are not valid for their language, or are no form.

Each file is read whole by the reader of its language, which goes on after
errors. All errors are kept with line, column and cause; the first one is the
file's cause.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm import bslreader, jsonreader, xmlreader

PARSE_INCOMPLETE, NO_FORM_ROOT = "parse_incomplete", "no_form_root"

_ERRORS = pa.list_(pa.struct([("line", pa.int64()), ("col", pa.int64()), ("cause", pa.string())]))
_ROWS = 500


def read(lang: str, content: str) -> tuple[str | None, list[tuple[int, int, str]]]:
    """(reason, all errors) of one file; a leading byte order mark is no error."""
    text = content.removeprefix("﻿")
    if lang == "xml":
        report, form = xmlreader.read(text)
    else:
        report, form = (bslreader if lang == "bsl" else jsonreader).read(text), True
    return (None if form else NO_FORM_ROOT) if report.accepted else PARSE_INCOMPLETE, report.placed()


LANGUAGES = ("bsl", "json", "xml")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(at, _ROWS)
            found = [read(lang, content.as_py()) for lang, content in zip(batch.column("lang").to_pylist(), batch.column("content"))]
            errors = pa.array([[{"line": a, "col": b, "cause": c} for a, b, c in e] for _, e in found], _ERRORS)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [pa.array([r for r, _ in found], pa.string()), errors], names=["file_id", "repo", "lang", "reason", "errors"])


def reports(source_file: DataFrame) -> DataFrame:
    """(file_id, repo, lang, reason, errors) of each file; lang is that of the extension.

    ``errors`` holds line, col and cause of every error, by place. ``reason`` is
    parse_incomplete where there is one, no_form_root for markup without any and
    without an element Form, else null.

    Defined results: null contents and other extensions give no row; an empty
    module or a form without text is read like others; a repeated row is read
    again and counts once in what is made of it. Other columns are not read.
    """
    lang = F.lower(F.regexp_extract("rel_path", r"\.([^./\\]+)$", 1)).alias("lang")
    rows = source_file.select("file_id", "repo", lang, "content").where(F.col("lang").isin(*LANGUAGES) & F.col("content").isNotNull())
    return rows.mapInArrow(_read, "file_id bigint, repo string, lang string, reason string, errors array<struct<line:bigint,col:bigint,cause:string>>")


def found(source_file: DataFrame) -> DataFrame:
    """p3_found: the flagged files."""
    return reports(source_file).where("reason is not null").select("file_id", "reason").distinct()


def flags(source_file: DataFrame) -> DataFrame:
    """One row a file: both flags, the number of errors, and place and cause of the first."""
    first = F.get("errors", F.lit(0))
    read = reports(source_file).select(
        "file_id", "repo", "lang", F.col("reason").eqNullSafe(PARSE_INCOMPLETE).alias(PARSE_INCOMPLETE), F.col("reason").eqNullSafe(NO_FORM_ROOT).alias(NO_FORM_ROOT),
        F.size("errors").alias("errors"), first["line"].alias("line"), first["col"].alias("col"), first["cause"].alias("first_cause"),
    )
    return read.distinct()


def errors(source_file: DataFrame) -> DataFrame:
    """One row an error of a file: its number by place, line, column and cause."""
    listed = reports(source_file).where(F.size("errors") > 0).select("file_id", "repo", "lang", "errors").distinct()
    return listed.select("file_id", "repo", "lang", F.posexplode("errors").alias("n", "e")).select("file_id", "repo", "lang", (F.col("n") + 1).alias("error_no"), "e.line", "e.col", "e.cause")


def _rate(name: str):
    return F.avg(F.col(name).cast("double")).alias(f"{name}_rate")


def rates(source_file: DataFrame) -> DataFrame:
    """Files and the rate of each flag per repo and language."""
    return flags(source_file).groupBy("repo", "lang").agg(F.count("*").alias("files"), _rate(PARSE_INCOMPLETE), _rate(NO_FORM_ROOT))


def acceptance(source_file: DataFrame) -> DataFrame:
    """Files, accepted ones, their share and all errors per language."""
    accepted = (~F.col(PARSE_INCOMPLETE)).cast("bigint")
    return flags(source_file).groupBy("lang").agg(F.count("*").alias("files"), F.sum(accepted).alias("accepted"), F.avg(accepted.cast("double")).alias("acceptance"), F.sum("errors").alias("errors"))
