"""Analyses of subsystem trees: membership, orphans, containing and intersecting subsystems, and the tree itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalens.functions import keys, kinds
from stratalens.session import lookup_join


def memberships(membership: DataFrame) -> DataFrame:
    """(repo, object, name, root, path) of every reference, once; objects with their kind in Russian.

    Defined results: null, empty and undotted references are none; a null root
    is that of a root.
    """
    own = membership.select("repo", keys.canonical_reference(F.col("object")).alias("object"), "name", F.coalesce("root", "name").alias("root"), "path")
    return own.where("object != ''").distinct()


def refs(membership: DataFrame) -> DataFrame:
    """(repo, object, name, root, path): one row for each distinct (name, root) of an object; the first path stands for it."""
    return memberships(membership).groupBy("repo", "object", "name", "root").agg(F.min("path").alias("path"))


def _objects(universe: DataFrame) -> DataFrame:
    return universe.select("repo", keys.canonical_reference(F.col("object")).alias("object")).where("object != ''").distinct()


def orphans(universe: DataFrame, membership: DataFrame) -> DataFrame:
    """(repo, object) of objects no subsystem of their repo holds, noise left out.

    Both sides are distinct before they meet, so that hot objects are one row.
    """
    held = membership.select("repo", keys.canonical_reference(F.col("object")).alias("object")).distinct()
    return _objects(universe).where(~keys.is_noise(F.col("object"))).join(held, ["repo", "object"], "left_anti")


def orphan_status(universe: DataFrame, membership: DataFrame) -> DataFrame:
    """(repo, objects, orphans, status): an empty universe is unavailable, and not wholly covered."""
    all_objects = _objects(universe).groupBy("repo").agg(F.count("*").alias("objects"))
    alone = orphans(universe, membership).groupBy("repo").agg(F.count("*").alias("orphans"))
    repos = membership.select("repo").unionByName(universe.select("repo")).distinct()
    out = repos.join(all_objects, "repo", "left").join(alone, "repo", "left").na.fill(0, ["objects", "orphans"])
    return out.withColumn("status", F.when(F.col("objects") == 0, "unavailable").when(F.col("orphans") == 0, "covered").otherwise("orphans"))


def containing(membership: DataFrame, name: str, object_type: str = "") -> DataFrame:
    """(repo, object, name, root) of subsystems that hold an object.

    The whole name in any case; only where a repo has no such object, the short
    name in any case, and then of several objects only those of the type, if any
    is. Types are given in English or Russian.
    """
    wanted = name.strip().lower()
    own = refs(membership).select("repo", "object", "name", "root")
    whole, short = F.lower("object") == wanted, F.lower(keys.short_name(F.col("object"))) == wanted
    hits = own.where(whole | short).withColumns({"whole": whole, "typed": _of_type(F.col("object"), object_type)})
    by = W.partitionBy("repo")
    hits = hits.withColumns({"any_whole": F.max("whole").over(by), "any_typed": F.max(~F.col("whole") & F.col("typed")).over(by)})
    chosen = F.when(F.col("any_whole"), F.col("whole")).otherwise(~F.col("any_typed") | F.col("typed"))
    return hits.where(chosen).select("repo", "object", "name", "root")


def _of_type(full: Column, object_type: str) -> Column:
    """Whether an object is of a type; none is of no type."""
    wanted = object_type.strip().lower()
    if not wanted:
        return F.lit(False)
    russian = {k.lower(): v for k, v in kinds.APPLIED.items()}.get(wanted, "")
    return F.lower(keys.kind_prefix(full)).isin(wanted, russian.lower())


def containing_total(membership: DataFrame, name: str, object_type: str = "") -> DataFrame:
    """Objects found and subsystems that hold them, in one row."""
    return containing(membership, name, object_type).agg(F.count_distinct("repo", "object").alias("objects"), F.count("*").alias("total"))


def intersections(membership: DataFrame, cross_branch: bool = False) -> DataFrame:
    """(repo, object, refs, roots) of objects in at least two subsystems, or in at least two branches.

    Subsystems count by (name, root): two that share both are one.
    """
    own = refs(membership).where(~keys.is_noise(F.col("object"))).groupBy("repo", "object").agg(F.count("*").alias("refs"), F.count_distinct("root").alias("roots"))
    return own.where((F.col("refs") >= 2) & (F.lit(not cross_branch) | (F.col("roots") >= 2)))


def intersection_refs(membership: DataFrame, cross_branch: bool = False) -> DataFrame:
    """(repo, object, ref_no, name, root): the subsystems of each such object in order of name, root and path."""
    chosen = intersections(membership, cross_branch).select("repo", "object")
    own = lookup_join(refs(membership), chosen, ["repo", "object"], "left_semi", "path")
    order = W.partitionBy("repo", "object").orderBy("name", "root", "path")
    return own.select("repo", "object", F.row_number().over(order).alias("ref_no"), "name", "root")


def coverage_warnings(membership: DataFrame, universe: DataFrame) -> DataFrame:
    """(repo, kind): kinds that subsystems refer to and the universe of the repo has no object of."""
    own = memberships(membership).select("repo", keys.kind_prefix(F.col("object")).alias("kind")).where(F.col("kind").isin(*kinds.UNIVERSE.values())).distinct()
    present = _objects(universe).select("repo", keys.kind_prefix(F.col("object")).alias("kind")).distinct()
    return own.join(present, ["repo", "kind"], "left_anti")


def ambiguous_names(subsystem: DataFrame) -> DataFrame:
    """(repo, name, path, namesakes) of nodes whose short name others of the repo bear."""
    own = subsystem.where("path is not null").select("repo", keys.short_name(F.col("path")).alias("name"), "path").distinct()
    many = own.groupBy("repo", "name").agg(F.count("*").alias("namesakes")).where("namesakes > 1")
    return lookup_join(own, many, ["repo", "name"], "inner", "path")


def resolve(subsystem: DataFrame, name: str) -> DataFrame:
    """(repo, path) of nodes with a full name or, where a repo has none, a short name; all that bear it."""
    own = subsystem.where("path is not null").select("repo", "path").distinct()
    hits = own.where((F.col("path") == name) | (keys.short_name(F.col("path")) == name)).withColumn("whole", F.col("path") == name)
    return hits.withColumn("any_whole", F.max("whole").over(W.partitionBy("repo"))).where("whole = any_whole").select("repo", "path")


def tree(subsystem: DataFrame) -> DataFrame:
    """(repo, path, depth, parents): nodes with their level, parents that are there counted.

    The order of ``path`` by its parts is that of the tree: parents before
    children, children by name. Levels come from the path itself; no recursion.
    """
    own = subsystem.where("path is not null").select("repo", "path", "parent_path").distinct()
    there = own.select("repo", F.col("path").alias("parent_path")).distinct().withColumn("there", F.lit(1))
    joined = lookup_join(own, there, ["repo", "parent_path"], "left", "path")
    return joined.select("repo", "path", (F.size(F.split("path", r"\.")) - 2).alias("depth"), F.coalesce("there", F.lit(0)).alias("parents"))


def flattened(subsystem: DataFrame, depth: int = 64) -> DataFrame:
    """(repo, path, root, level) by walking from the roots along parent paths, level by level, as a recursive query.

    A node whose parent is not there isn't reached. A path that repeats on its
    own way ends the walk at ``depth`` levels at the latest.
    """
    spark = subsystem.sparkSession
    subsystem.where("path is not null").select("repo", "path", "parent_path", "name").distinct().createOrReplaceTempView("__node")
    return spark.sql(
        f"""
        with recursive walk(repo, path, root, level) max recursion level {depth} as (
            select repo, path, name, 0 from __node where parent_path is null
            union all
            select n.repo, n.path, w.root, w.level + 1 from walk w join __node n on n.repo = w.repo and n.parent_path = w.path where w.level < {depth - 1})
        select distinct repo, path, root, level from walk
        """
    )


# --- the same in DuckDB's SQL


def reference_sql(raw: str) -> str:
    """A canonical reference."""
    text = keys.sql_composed(raw)
    lower = {k.lower(): v for k, v in kinds.SERVICE.items()}
    kind = f"split_part({text}, '.', 1)"
    name = f"case when list_contains({kinds.sql_list(kinds.APPLIED.values())}, {kind}) then {kind} else coalesce({kinds.sql_map(kinds.APPLIED)}[{kind}], {kinds.sql_map(lower)}[lower({kind})], {kind}) end"
    return f"case when not contains({text}, '.') then '' else ({name}) || substr({text}, len({kind}) + 1) end"


_NOISE = " and ".join(f"not ends_with(object, '{n}')" for n in kinds.NOISE)
_HELD = f"""
    held as (select distinct repo, object, name, root, path from (select repo, {reference_sql('object')} as object, name, coalesce(root, name) as root, path from membership) where object != ''),
    ref as (select repo, object, name, root, min(path) as path from held group by all),
    alive as (select distinct repo, object from (select repo, {reference_sql('object')} as object from universe) where object != '')
"""


def sql(last: str) -> str:
    """A query over ``held`` (memberships), ``ref`` (distinct subsystems of objects) and ``alive`` (the universe)."""
    return f"with {_HELD} {last}"


ORPHANS_SQL = sql(f"select * from alive anti join held using (repo, object) where {_NOISE}")
INTERSECTIONS_SQL = f"select repo, object, count(*) as refs, count(distinct root) as roots from ref where {_NOISE} group by all having count(*) >= 2"
