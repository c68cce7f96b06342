"""The tools a client calls, one function each, over a catalog of tables.

A Workspace names the tables of one dump or configuration. Offline tables come
first; what they don't have may come from a second source (``fallback``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import catalog, text
from stratalens.operators import eventlog, modules, search, subsystems
from stratalens.operators import forms as form_tables
from stratalens.plans import sqlfront
from stratalens.sources import tree

MODES = ("smart", "regex", "exact")


@dataclass
class Workspace:
    """Tables by name, as DataFrames; ``fallback`` gives those that are not there."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    fallback: Callable[[str], DataFrame | None] | None = None
    #: Dotted names of a configuration's tables, for queries.
    names: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str) -> Workspace:
        """The Parquet tables of a folder."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        names = [n.removesuffix(".parquet") for s in found if (n := s.getPath().getName()).endswith(".parquet")]
        return cls(spark, {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names})

    def table(self, name: str) -> DataFrame:
        found = self.tables.get(name)
        if found is None and self.fallback:
            found = self.fallback(name)
        if found is None:
            raise KeyError(f"no table {name}")
        return found


def metadata_tree(w: Workspace, category: str | None = None) -> DataFrame:
    """Objects of a category, or the number of objects of each."""
    own = w.table("universe")
    return modules.metadata_summary(own) if not category else modules.metadata_tree(own).where(F.col("category") == category)


def object_structure(w: Workspace, name: str) -> DataFrame:
    """(part, name, type): columns of a table, and those of its nested parts below them."""
    rows, waiting = [], [("", w.table(name).schema)]
    while waiting:
        part, schema = waiting.pop(0)
        for column in schema.fields:
            inner = getattr(column.dataType, "elementType", column.dataType)
            rows.append((part, column.name, column.dataType.simpleString()))
            if hasattr(inner, "fields"):
                waiting.append((f"{part}.{column.name}".strip("."), inner))
    return w.spark.createDataFrame(rows, "part string, name string, type string")


def form_structure(w: Workspace, object_name: str, form_name: str | None = None, main: dict[str, str] | None = None) -> DataFrame:
    """Elements, events and commands of one form of an object.

    Without a name it is the main form where the caller knows it, else the first
    one by name: two rules that differ.
    """
    own = w.table("form_info").where(F.col("object") == object_name)
    chosen = form_name or (main or {}).get(object_name)
    if chosen is None:
        first = own.agg(F.min("form_name").alias("f")).first()
        chosen = first.f if first else None
    return form_tables.flatten(own.where(F.col("form_name") == F.lit(chosen)))


def configuration_info(w: Workspace) -> DataFrame:
    """(property, value) of the engine and the workspace."""
    rows = [("engine", "Apache Spark"), ("version", w.spark.version), ("time_zone", w.spark.conf.get("spark.sql.session.timeZone")), ("tables", str(len(w.tables)))]
    return w.spark.createDataFrame(rows, "property string, value string")


@dataclass
class Found:
    """Hits, all matches before the limit, and what is counted."""

    hits: DataFrame
    total: DataFrame


def search_code(w: Workspace, query: str, mode: str = "smart", limit: int | None = None, namespace: str = "", category: str = "", module: str = "") -> Found:
    """Search modules: by relevance, by an RE2 pattern or by text in any case."""
    if not query:
        raise ValueError("a query is required")
    if mode not in MODES:
        raise ValueError(f"no mode {mode}; there are {', '.join(MODES)}")
    if namespace not in ("", "ext"):
        raise ValueError(f"no namespace {namespace}")
    own, ids = modules.modules(w.table("source_file")), ["doc_id", "file_id"]
    within = {"namespace": namespace, "category": category, "module_type": module}
    if mode == "smart":
        return Found(search.smart_hits(own, query, ids, limit, **within), search.smart_total(own, query, ids, **within))
    match = search.pattern(w.spark, query) if mode == "regex" else search.exact(query)
    return Found(search.first_lines(own, match, ids, limit, **within), search.line_total(own, match, ids, **within))


def reload_dump(w: Workspace, root: str, folder: str) -> dict:
    """Scan a dump anew and publish it if it changed."""
    return tree.reload(w.spark, root, folder)


def function_help(w: Workspace, query: str) -> DataFrame:
    """Functions of the library by a part of either name."""
    return catalog.function_help(w.spark, query)


def _views(w: Workspace) -> dict[str, str]:
    for name, df in w.tables.items():
        df.createOrReplaceTempView(name)
    return w.names


def execute_query(w: Workspace, query: str, limit: int | None = None, parameters: dict | None = None) -> sqlfront.Result:
    """Run a read-only query over the tables."""
    return sqlfront.execute(w.spark, query, limit, parameters, _views(w))


def validate_query(w: Workspace, query: str) -> tuple[bool, list[str]]:
    """Whether a query could be run, and what is wrong with it."""
    return sqlfront.validate(w.spark, query, None, _views(w))


def event_log(w: Workspace, start: str | None = None, end: str | None = None, level: str | None = None, user: int | None = None, limit: int | None = None, now: dt.datetime | None = None) -> DataFrame:
    """A page of events with the number of all."""
    return eventlog.page_with_total(eventlog.filtered(w.table("events"), start, end, level, user, now), limit)


def analyze_subsystems(w: Workspace, action: str, name: str = "", object_type: str = "", cross_branch: bool = False) -> DataFrame:
    """Objects in no subsystem, subsystems that hold an object, or objects in several ones."""
    if action == "orphans":
        return subsystems.orphans(w.table("universe"), w.table("membership"))
    if action == "containing":
        if not name.strip():
            raise ValueError("an object is required")
        return subsystems.containing(w.table("membership"), name, object_type)
    if action == "intersections":
        return subsystems.intersections(w.table("membership"), cross_branch)
    raise ValueError(f"no action {action}")


def clamp(limit: int | None) -> int:
    """A limit as searches take it."""
    return text.clamp_limit(limit, search.DEFAULT_LIMIT, search.MOST_LIMIT)


def register_functions(spark: SparkSession) -> None:
    """Expressions of the library as SQL functions: a token filter, and lines as a table."""

    @F.udtf(returnType="line_no int, line string")
    class LinesOf:
        def eval(self, content: str):
            if content is not None:
                yield from enumerate(content.split("\n"), 1)

    spark.udtf.register("lines_of", LinesOf)

    @F.arrow_udf("array<string>")
    def with_synonyms(words):
        import pyarrow as pa

        return pa.array([None if ws is None else [x for w in ws for x in (w, catalog.SYNONYMS.get(w)) if x] for ws in words.to_pylist()], pa.list_(pa.string()))

    spark.udf.register("with_synonyms", with_synonyms)
