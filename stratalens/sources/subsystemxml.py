"""Subsystem trees and universes of objects in the files of a dump."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import keys, kinds
from stratalens.sources.formxml import localized, tree

#: Bounds of a file and of a tree; what is beyond gives a warning.
MOST_BYTES, MOST_XML_DEPTH, MOST_TREE_DEPTH = 16 << 20, 256, 64

_SCHEMA = "path string, name string, synonym string, content array<string>, children array<struct<path:array<string>,name:string,synonym:string,content:array<string>>>, warning string"
_CHILD = pa.struct([("path", pa.list_(pa.string())), ("name", pa.string()), ("synonym", pa.string()), ("content", pa.list_(pa.string()))])
_ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("synonym", pa.string()), ("content", pa.list_(pa.string())), ("children", pa.list_(_CHILD)), ("warning", pa.string())])


def _described(node) -> dict:
    own = node.first("Properties")
    content = [i.text.strip() for i in own.first("Content").children] if own and own.first("Content") else []
    return {"name": own.has("Name").strip() if own else "", "synonym": localized(own.first("Synonym"), "ru") if own else "", "content": [c for c in content if c]}


def read_subsystem(text: str) -> dict:
    """One file's subsystem and those nested in it, or why it is left out."""
    if len(text.encode()) > MOST_BYTES:
        return {"warning": "the file is too large"}
    top, whole, depth = tree(text, MOST_XML_DEPTH)
    if depth > MOST_XML_DEPTH:
        return {"warning": "the markup is nested too deep"}
    node = next((n for n in top.walk() if n.name == "Subsystem"), None)
    if not whole or node is None or not (own := _described(node))["name"]:
        return {"warning": "the file can't be read"}
    children, waiting = [], [([own["name"]], node)]
    while waiting:
        path, above = waiting.pop()
        inner = above.first("ChildObjects")
        for child in inner.all("Subsystem") if inner else []:
            found = _described(child)
            if found["name"]:
                children.append({"path": [*path, found["name"]]} | found)
                waiting.append(([*path, found["name"]], child))
    return own | {"children": children, "warning": None}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield pa.RecordBatch.from_pylist([{"path": path} | read_subsystem(content.as_py().decode("utf-8", "replace"))], schema=_ARROW)


def _relative(spark: SparkSession, root: str, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    # behind the root, whatever scheme the reader puts before it
    tail = root.split("://")[-1].rstrip("/") + "/"
    return files.select(F.substring_index(F.col("path"), tail, -1).alias("path"), "length", "content")


def forest(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, warnings) of a dump.

    Nodes: (path, parent_path, root, name, synonym, content). Files lie in
    Subsystems/<Name>.xml with children in Subsystems/<Name>/Subsystems, or in
    Subsystems/<Name>/Ext/Subsystem.xml with children inside; any file directly
    in Subsystems tells the first layout. Content is sorted, in Russian kinds.
    """
    files = _relative(spark, root, "*.xml").where(F.col("path").startswith("Subsystems/"))
    tree_files = files.where(F.col("path").rlike(r"^Subsystems/[^/]+\.xml$|^Subsystems/.*/Subsystems/[^/]+\.xml$"))
    by_tree = not files.where(F.col("path").rlike(r"^Subsystems/[^/]+\.xml$")).isEmpty()
    chosen = tree_files if by_tree else files.where(F.col("path").rlike(r"^Subsystems/[^/]+/Ext/Subsystem\.xml$"))
    read = chosen.select("path", "content").mapInArrow(_read, _SCHEMA)
    stem = F.regexp_extract("path", r"([^/]+?)(?:/Ext/Subsystem)?\.xml$", 1)
    warnings = read.where("warning is not null").select(stem.alias("subsystem"), "warning")
    good = read.where("warning is null")
    above = F.filter(F.split("path", "/"), lambda x: ~x.endswith(".xml"))
    # folders of the ancestors stand between the Subsystems folders
    folders = F.when(F.lit(by_tree), F.filter(above, lambda x, i: i % 2 == 1)).otherwise(F.array().cast("array<string>"))
    deep = F.size(folders) > MOST_TREE_DEPTH
    warnings = warnings.unionByName(good.where(deep).select(stem.alias("subsystem"), F.lit("the tree is nested too deep").alias("warning")))
    good = good.where(~deep)
    own = good.select(F.concat(folders, F.array("name")).alias("names"), "name", "synonym", "content")
    nested = good.select(folders.alias("above"), F.inline("children")).select(F.concat("above", "path").alias("names"), "name", "synonym", "content")
    nodes = own.unionByName(nested)
    joined = lambda names: F.concat(F.lit("Подсистема."), F.array_join(names, "."))
    content = F.array_sort(F.filter(F.transform("content", keys.canonical_reference), lambda c: c != ""))
    parent = F.when(F.size("names") > 1, joined(F.slice("names", 1, F.size("names") - 1)))
    return nodes.select(joined(F.col("names")).alias("path"), parent.alias("parent_path"), F.get("names", F.lit(0)).alias("root"), "name", "synonym", content.alias("content")), warnings


def membership(nodes: DataFrame) -> DataFrame:
    """(object, name, root, path) of all nodes' contents."""
    return nodes.select(F.explode("content").alias("object"), "name", "root", "path")


def universe(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(objects, kinds): the distinct objects of a dump in order, and the kinds whose folders hold any file.

    An object is <Folder>/<Name>.xml or <Folder>/<Name>/Ext/<Name>.xml of a known kind.
    """
    paths = _relative(spark, root, "*").select("path")
    folder = kinds.looked_up(kinds.UNIVERSE, F.substring_index("path", "/", 1))
    own = paths.withColumn("kind", folder).where("kind is not null")
    flat, nested = F.regexp_extract("path", r"^[^/]+/([^/]+)\.xml$", 1), F.regexp_extract("path", r"^[^/]+/([^/]+)/Ext/\1\.xml$", 1)
    name = F.when(flat != "", flat).when(nested != "", nested)
    objects = own.withColumn("name", name).where("name is not null").select(F.concat("kind", F.lit("."), keys.composed(F.col("name"))).alias("object")).distinct()
    return objects.orderBy("object"), own.select("kind").distinct()
