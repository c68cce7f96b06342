"""Module files of a dump as tables: scans, contents, snapshots and generations."""

from __future__ import annotations

import datetime as dt
import errno
import json
import os
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from stratalens.functions import keys
from stratalens.operators import modules, upserts
from stratalens.sources.layout import Layout

_BSL = "*.[bB][sS][lL]"
#: A snapshot's table.
MANIFEST = StructType([StructField("rel_path", StringType()), StructField("mtime_ms", LongType()), StructField("size", LongType()), StructField("doc_id", StringType())])


def within(root: str, path: str) -> bool:
    """Whether a path, its links followed, lies in the root."""
    real, base = os.path.realpath(path), os.path.realpath(root)
    return real == base or real.startswith(base.rstrip(os.sep) + os.sep)


#: Failures that say something about the file and not about the machine at the moment.
_OF_THE_FILE = {errno.EACCES, errno.EPERM, errno.ENOENT, errno.EISDIR, errno.ENOTDIR, errno.ELOOP, errno.EIO, errno.ENXIO}


def failure_is_of_the_file(error: BaseException) -> bool:
    """Whether a failure to read is worth remembering; lacks of descriptors or memory and stale handles are not."""
    return isinstance(error, UnicodeError) or isinstance(error, OSError) and error.errno in _OF_THE_FILE


def _paths(spark: SparkSession, root: str) -> DataFrame:
    """(path, modificationTime, length, content, rel_path) of all module files, empty ones too.

    Spark's reader leaves out files of no bytes; they come from its own listing,
    which the driver holds in any case.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _BSL).load(root)
    plain = lambda p: F.regexp_replace(p, "^([a-z0-9]+):/+", "$1:/")
    listed = spark.createDataFrame([(unquote(p),) for p in files.inputFiles()], "listed string")
    fs, path = _file_system(spark, root)
    empty = []
    for row in listed.join(files.select("path"), plain(F.col("listed")) == plain(F.col("path")), "left_anti").toLocalIterator():
        status = fs.getFileStatus(path(row.listed))
        empty.append((row.listed, dt.datetime.fromtimestamp(status.getModificationTime() / 1000, dt.UTC), 0, b""))
    if empty:
        files = files.unionByName(spark.createDataFrame(empty, files.schema))
    tail = root.split("://")[-1].rstrip("/") + "/"
    return files.withColumn("rel_path", F.substring_index(F.col("path"), tail, -1))


def _escaping(root: str) -> list[str]:
    """Linked module files and folders that lead out of a local root."""
    out = []
    for folder, folders, files in os.walk(root):
        for name in [*folders, *files]:
            path = os.path.join(folder, name)
            if os.path.islink(path) and not within(root, path):
                out.append(os.path.relpath(path, root))
    return out


def scan_paths(spark: SparkSession, root: str, layout: Layout | None = None) -> DataFrame:
    """(rel_path, mtime_ms, size, doc_id and its parts) of all module files; contents aren't read.

    Links out of a local root are left out.
    """
    own = _paths(spark, root).select("rel_path", F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"))
    for path in _escaping(root) if "://" not in root and os.path.isdir(root) else []:
        own = own.where((F.col("rel_path") != path) & ~F.col("rel_path").startswith(path + "/"))
    return _keyed(own, layout)


def _keyed(files: DataFrame, layout: Layout | None) -> DataFrame:
    key = keys.layout_key(F.col("rel_path"), layout.own if layout else None, layout.children if layout else {})
    out = files.withColumns({"doc_id": key, "wrap_depth": keys.wrap_depth(F.col("rel_path"))}).withColumn("__s", keys.slots(F.col("doc_id")))
    return out.select(*files.columns, "doc_id", "wrap_depth", *[F.col(f"__s.{p}").alias(p) for p in modules.PARTS])


def scan(spark: SparkSession, root: str, layout: Layout | None = None) -> DataFrame:
    """The same with ``content``, without byte order marks. Names in order come by ``orderBy('doc_id')``."""
    own = _paths(spark, root).select("rel_path", F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"), F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("content"))
    for path in _escaping(root) if "://" not in root and os.path.isdir(root) else []:
        own = own.where((F.col("rel_path") != path) & ~F.col("rel_path").startswith(path + "/"))
    return _keyed(own, layout)


def content_of(spark: SparkSession, root: str, rel_path: str) -> str | None:
    """One file's text, if it lies in the root and can be read."""
    path = os.path.join(root, rel_path)
    if not within(root, path) or not os.path.isfile(path):
        return None
    found = spark.read.format("binaryFile").load(path).select(F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("c")).first()
    return found.c if found else None


# --- snapshots as JSON and as tables


def manifest_json(manifest: DataFrame) -> str:
    """A snapshot in the form other tools read; one of above a million files is refused, as it is one text."""
    v, sv, zv = upserts.VERSIONS
    if manifest.count() > 1_000_000:
        raise ValueError("too many files for one text")
    files = {r.rel_path: {"m": r.mtime_ms, "s": r.size, "d": r.doc_id} for r in manifest.select(*MANIFEST.names).toLocalIterator()}
    return json.dumps({"v": v, "sv": sv, "zv": zv, "f": files}, ensure_ascii=False, sort_keys=True)


def manifest_from_json(spark: SparkSession, text: str | None) -> DataFrame | None:
    """The snapshot of such a text; none of an absent, broken or otherwise versioned one."""
    try:
        found = json.loads(text or "")
        if not isinstance(found, dict) or (found.get("v"), found.get("sv"), found.get("zv")) != upserts.VERSIONS:
            return None
        return spark.createDataFrame([(p, f["m"], f["s"], f["d"]) for p, f in found["f"].items()], MANIFEST)
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def signature(manifest: DataFrame) -> str:
    """The content signature of one snapshot."""
    own = manifest.select(F.lit("").alias("repo"), F.lit("").alias("gen"), "rel_path", "mtime_ms", "size", "doc_id", F.lit(None).cast("timestamp").alias("loaded_at"))
    found = upserts.signatures(own).first()
    return found.signature if found else "empty"


# --- generations: immutable folders with a pointer


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path


def build_generation(modules_: DataFrame, folder: str) -> str:
    """Write a generation named by its signature; of several builders the first to finish wins.

    It is written beside and renamed whole, so that no reader sees a part.
    """
    spark = modules_.sparkSession
    name = signature(modules_)
    files, path = _file_system(spark, folder)
    goal = path(f"{folder}/gen={name}")
    if not files.exists(path(f"{folder}/gen={name}/_SUCCESS")):
        beside = f"{folder}/.building-{name}-{os.getpid()}"
        modules_.write.mode("overwrite").parquet(beside)
        if files.exists(goal) or not files.rename(path(beside), goal):
            files.delete(path(beside), True)
    return name


def publish(spark: SparkSession, folder: str, name: str) -> bool:
    """Point readers at a generation; an empty one doesn't take the place of a filled one."""
    files, path = _file_system(spark, folder)
    held = current(spark, folder)
    if held is not None and open_generation(spark, folder, name).isEmpty() and not open_generation(spark, folder, held).isEmpty():
        return False
    beside = path(f"{folder}/CURRENT.{os.getpid()}")
    out = files.create(beside, True)
    out.write(bytearray(name.encode()))
    out.close()
    files.delete(path(f"{folder}/CURRENT"), False)
    return files.rename(beside, path(f"{folder}/CURRENT"))


def current(spark: SparkSession, folder: str) -> str | None:
    """The generation that readers are pointed at."""
    files, path = _file_system(spark, folder)
    where = path(f"{folder}/CURRENT")
    return spark.read.text(where.toString()).first().value if files.exists(where) else None


def open_generation(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """A ready generation; the current one without a name."""
    name = name or current(spark, folder)
    files, path = _file_system(spark, folder)
    if name is None or not files.exists(path(f"{folder}/gen={name}/_SUCCESS")):
        raise FileNotFoundError(f"no ready generation {name} in {folder}")
    return spark.read.parquet(f"{folder}/gen={name}")


def reload(spark: SparkSession, root: str, folder: str, layout: Layout | None = None) -> dict:
    """Scan a dump, and build and publish its generation if its signature is new: the report of that."""
    held = current(spark, folder)
    found = scan(spark, root, layout)
    name = signature(found)
    if name == held:
        count = open_generation(spark, folder).count()
        return {"changed": False, "before": count, "after": count, "accepted": True, "generation": name}
    build_generation(found, folder)
    new = open_generation(spark, folder, name)
    old = open_generation(spark, folder) if held else new.limit(0)
    report = upserts.reload_report(old, new, ["rel_path"], ["mtime_ms", "size"]).first().asDict()
    return report | {"accepted": publish(spark, folder, name), "generation": name}


def reap(spark: SparkSession, folder: str, older_than_ms: int, now_ms: int) -> list[str]:
    """Delete builds nobody wrote to since, and ready generations but the current one; their names."""
    files, path = _file_system(spark, folder)
    held, gone = current(spark, folder), []
    for status in files.listStatus(path(folder)):
        name = status.getPath().getName()
        stale = now_ms - status.getModificationTime() > older_than_ms
        if stale and (name.startswith(".building-") or name.startswith("gen=") and name != f"gen={held}"):
            files.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def info(spark: SparkSession, folder: str, root: str) -> dict:
    """What a folder of generations is of."""
    name = current(spark, folder)
    return {"root": root, "path_hash": spark.range(1).select(F.substring(F.sha2(F.lit(os.path.abspath(root)), 256), 1, 16)).first()[0], "generation": name, "modules": open_generation(spark, folder).count() if name else 0}
