"""Structured Streaming: module files as they change, and events as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalens.functions import keys
from stratalens.operators import modules, upserts
from stratalens.session import lookup_join


def module_stream(spark: SparkSession, root: str, files_a_batch: int = 1000) -> DataFrame:
    """Module files of a folder as they appear: (rel_path, mtime_ms, size, content, doc_id and its parts)."""
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[bB][sS][lL]").option("maxFilesPerTrigger", files_a_batch)
    files = raw.schema("path string, modificationTime timestamp, length bigint, content binary").load(root)
    tail = root.split("://")[-1].rstrip("/") + "/"
    own = files.select(F.substring_index(F.col("path"), tail, -1).alias("rel_path"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"), F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("content"))
    own = own.withColumn("doc_id", keys.module_key(F.col("rel_path"))).withColumn("__s", keys.slots(F.col("doc_id")))
    return own.select("rel_path", "mtime_ms", "size", "content", "doc_id", *[F.col(f"__s.{p}").alias(p) for p in modules.PARTS])


def upsert_into(stream: DataFrame, table: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Add each batch to a folder of versions; a batch writes its own rows alone, however large the table is.

    Of equal keys in a batch the latest file counts. A batch that is run again
    after a failure writes the same version again.
    """

    def write(batch: DataFrame, number: int) -> None:
        upserts.first_of(batch, key, [F.desc("mtime_ms"), F.desc("size")]).write.mode("overwrite").parquet(f"{table}/version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, table: str) -> list[tuple[int, bool, str]]:
    """(number, whether it is a base, folder) of all versions that were written whole, in order."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = jvm.Path(table)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    found = [(int(n.split("=")[1]), n.startswith("base="), f"{table}/{n}") for n in names if n.startswith(("version=", "base="))]
    return sorted(p for p in found if files.exists(jvm.Path(f"{p[2]}/_SUCCESS")))


def latest(spark: SparkSession, table: str, key: list[str], until: int | None = None) -> DataFrame | None:
    """The rows of such a folder after a version (the last one without ``until``): of each key its last delivery.

    Which delivery that is comes from the keys alone; contents are not sorted or
    grouped. Versions before the last base aren't read.
    """
    parts = [p for p in _parts(spark, table) if until is None or p[0] <= until]
    if not parts:
        return None
    base = max((n for n, (_, is_base, _) in enumerate(parts) if is_base), default=0)
    # a base stands for its number and all before, its own version included
    kept = [p for p in parts[base:] if not (parts[base][1] and p[0] <= parts[base][0] and not p[1])]
    if len(kept) == 1:
        return spark.read.parquet(kept[0][2])
    whole = None
    for number, is_base, folder in kept:
        part = spark.read.parquet(folder).withColumn("__version", F.lit(-1 if is_base else number))
        whole = part if whole is None else whole.unionByName(part)
    last = whole.groupBy(*key).agg(F.max("__version").alias("__last"))
    joined = lookup_join(whole, last, key, "inner", key[0])
    return joined.where("__version = __last").drop("__version", "__last")


def compact(spark: SparkSession, table: str, key: list[str]) -> int | None:
    """Write the latest rows as a base, from which readers begin; its number. Older versions may be deleted then."""
    parts = _parts(spark, table)
    if not parts:
        return None
    number = parts[-1][0]
    latest(spark, table, key).write.mode("overwrite").parquet(f"{table}/base={number}")
    return number


def event_stream(spark: SparkSession, folder: str, schema, files_a_batch: int = 100) -> DataFrame:
    """Events of the Parquet files of a folder as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def _watermarked(events: DataFrame, late: str | None) -> DataFrame:
    return events.withWatermark("ts", late) if late else events


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """Events of each window and type; those that come later than ``late`` behind the latest are left out.

    ``late`` is None where the events have their watermark already.
    """
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = _watermarked(events, late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """Sessions of users."""
    out = _watermarked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run over what is there: into a function of batches, or a Parquet folder."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(sink).start() if callable(sink) else writer.format("parquet").option("path", sink).start()
