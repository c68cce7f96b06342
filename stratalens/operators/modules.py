"""Modules with keys and their parts, from a table of source files; facets and counts over an index of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalens.functions import keys, kinds

PARTS = ("namespace", "category", "object_name", "module_type")


def keyed(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """``files`` with doc_id, its four parts and wrap_depth; of any case of .bsl alone.

    Defined results: rows without path are left out; a path of one segment is
    its own key.
    """
    clean = keys.forward(F.col(path))
    own = files.where(F.lower(F.col(path)).endswith(".bsl")).withColumn("__path", clean)
    own = own.withColumns({"doc_id": keys.module_key(F.col("__path")), "wrap_depth": keys.wrap_depth(F.col("__path"))})
    return own.withColumn("__s", keys.slots(F.col("doc_id"))).select(*files.columns, "doc_id", "wrap_depth", *[F.col(f"__s.{p}").alias(p) for p in PARTS])


def modules(source_file: DataFrame) -> DataFrame:
    """(file_id, repo, doc_id, namespace, category, object_name, module_type, content) of readable modules, without byte order marks."""
    own = source_file.where("content is not null").select("file_id", "repo", "rel_path", F.regexp_replace("content", "^﻿", "").alias("content"))
    return keyed(own).drop("rel_path", "wrap_depth")


def modules_sql() -> str:
    """The same in DuckDB's SQL."""
    source = f"select file_id, repo, {keys.sql_forward('rel_path')} as path, regexp_replace(content, '^﻿', '') as content from source_file where content is not null and lower(rel_path) like '%.bsl'"
    return keys.sql_slots(f"select * exclude (key, path, wrap_depth), key as doc_id, key from ({keys.sql_keys(source)})").replace("select * exclude (parts)", "select * exclude (parts, key)")


def narrowed(df: DataFrame, namespace: str = "", category: str = "", object_name: str = "", module_type: str = "") -> DataFrame:
    """Rows of exactly these parts; an empty one doesn't narrow."""
    for part, value in zip(PARTS, (namespace, category, object_name, module_type)):
        if value:
            df = df.where(F.col(part) == keys.composed(F.lit(value)))
    return df


def entries(path_entry: DataFrame) -> DataFrame:
    """(repo, doc_id and its parts) of every entry; a repeated row counts once, a null namespace is ''."""
    own = path_entry.where("doc_id is not null").select("entry_id", "repo", F.col("doc_id").alias("doc_id")).distinct()
    return own.withColumn("s", keys.slots(keys.composed(F.col("doc_id")))).select("entry_id", "repo", "doc_id", *[F.col(f"s.{p}").alias(p) for p in PARTS])


ENTRIES_SQL = keys.sql_slots(f"select entry_id, repo, doc_id, {keys.sql_composed('doc_id')} as key from (select distinct entry_id, repo, doc_id from path_entry where doc_id is not null)").replace("exclude (parts)", "exclude (parts, key)")


def facet(df: DataFrame, part: str, **within: str) -> DataFrame:
    """The distinct values of a part, in order, of rows of the given parts."""
    return narrowed(df, **within).select(part).distinct().orderBy(part)


def facet_counts(df: DataFrame) -> DataFrame:
    """Entries, objects and module types of each namespace and category."""
    return df.groupBy("namespace", "category").agg(F.count("*").alias("entries"), F.count_distinct("object_name").alias("objects"), F.count_distinct("module_type").alias("module_types"))


def counts(df: DataFrame) -> DataFrame:
    """All entries and the distinct keys among them, in one row."""
    return df.agg(F.count("*").alias("modules"), F.count_distinct("repo", "doc_id").alias("slots"))


def contains(df: DataFrame, doc_id: str) -> bool:
    """Whether a key is there."""
    return not df.where(F.col("doc_id") == keys.composed(F.lit(doc_id))).isEmpty()


def content(df: DataFrame, doc_id: str) -> DataFrame:
    """The contents under a key."""
    return df.where(F.col("doc_id") == keys.composed(F.lit(doc_id)))


def collapsed(df: DataFrame) -> DataFrame:
    """Of each repo: how many entries lost their key to another one, how many keys are shared, and the first five.

    The five are found by a top-k of the shared keys, not by collecting them all.
    """
    shared = df.groupBy("repo", "doc_id").agg(F.count("*").alias("n")).where("n > 1")
    totals = shared.groupBy("repo").agg(F.sum(F.col("n") - 1).alias("lost"), F.count("*").alias("shared_keys"))
    first = shared.withColumn("rank", F.row_number().over(W.partitionBy("repo").orderBy("doc_id"))).where("rank <= 5")
    return totals.join(first.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), "|").alias("sample")), "repo")


def wrapped(df: DataFrame) -> DataFrame:
    """Paths below further folders, and all paths, in one row."""
    return df.agg(F.count_if(F.col("wrap_depth") > 0).alias("wrapped"), F.count("*").alias("paths"))


def smaller_first(left: DataFrame, right: DataFrame, on: Column | str) -> DataFrame:
    """Rows of ``left`` that are in ``right``: the intersection of two lists of entries."""
    return left.join(right, on, "left_semi")


def metadata_tree(universe: DataFrame) -> DataFrame:
    """(repo, category, ord, title, object) of objects that live, noise left out.

    Known categories come in a fixed order, unknown ones behind them by name.
    """
    living = universe.where("object is not null and deleted_at is null").select("repo", keys.canonical_reference(F.col("object")).alias("object")).where("object != ''").distinct()
    named = living.where(~keys.is_noise(F.col("object"))).withColumn("kind", keys.kind_prefix(F.col("object")))
    category = F.coalesce(kinds.looked_up(kinds.TREE_OF, F.col("kind")), F.col("kind"))
    order = kinds.looked_up({c: f"{i:02}" for i, c in enumerate(kinds.TREE, 1)}, F.col("category"))
    out = named.withColumn("category", category).withColumn("ord", F.coalesce(order.cast("int"), F.lit(len(kinds.TREE) + 1)))
    title = F.coalesce(kinds.looked_up(kinds.TREE_TITLES, F.col("category")), F.col("category"))
    return out.select("repo", "category", "ord", title.alias("title"), keys.short_name(F.col("object")).alias("name"))


def metadata_summary(universe: DataFrame) -> DataFrame:
    """Objects of each category; empty categories don't show."""
    return metadata_tree(universe).groupBy("category", "ord", "title").agg(F.count("*").alias("objects")).withColumn("known", F.col("ord") <= len(kinds.TREE))
