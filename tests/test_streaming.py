"""Streams over files and events."""

import datetime as dt
import os

from pyspark.sql import functions as F

from stratalens.streaming import ingest


def put(root, path, text):
    where = root / path
    where.parent.mkdir(parents=True, exist_ok=True)
    where.write_text(text)


def test_modules(spark, tmp_path):
    root, table, check = tmp_path / "dump", str(tmp_path / "table"), str(tmp_path / "check")
    put(root, "CommonModules/А/Ext/Module.bsl", "one")
    put(root, "CommonModules/Б/Ext/Module.bsl", "two")
    run = lambda: ingest.upsert_into(ingest.module_stream(spark, str(root)), table, check, ["rel_path"]).awaitTermination()
    held = lambda until=None: sorted((r.doc_id, r.content) for r in ingest.latest(spark, table, ["rel_path"], until).collect())
    run()
    first = [("ОбщийМодуль.А.Модуль", "one"), ("ОбщийМодуль.Б.Модуль", "two")]
    assert held() == first
    put(root, "CommonModules/В/Ext/Module.bsl", "three")
    run()
    assert held() == [*first, ("ОбщийМодуль.В.Модуль", "three")] and held(0) == first
    again = spark.read.parquet(f"{table}/version=0").withColumn("content", F.concat("content", F.lit("!")))
    again.write.parquet(f"{table}/version=7")  # a later delivery of both
    assert [c for _, c in held()] == ["one!", "two!", "three"] and held(1) == [*first, ("ОбщийМодуль.В.Модуль", "three")]
    assert ingest.compact(spark, table, ["rel_path"]) == 7 and [c for _, c in held()] == ["one!", "two!", "three"]
    again.where("content = 'one!'").withColumn("content", F.lit("1")).write.parquet(f"{table}/version=8")
    assert [c for _, c in held()] == ["1", "two!", "three"]
    assert ingest.latest(spark, str(tmp_path / "none"), ["rel_path"]) is None and ingest.compact(spark, str(tmp_path / "none"), ["rel_path"]) is None


def test_events(spark, tmp_path):
    start = dt.datetime(2025, 1, 1)
    rows = [(n, start + dt.timedelta(minutes=20 * n), n % 2, "view", 1.0) for n in range(12)] + [(3, start + dt.timedelta(minutes=60), 1, "view", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    folder = str(tmp_path / "events")
    df.write.parquet(folder)
    stream = lambda: ingest.event_stream(spark, folder, df.schema)
    out = str(tmp_path / "windows")
    ingest.run(ingest.windowed(ingest.once(stream()), late=None), out, str(tmp_path / "c1")).awaitTermination()
    late = spark.createDataFrame([(100, start + dt.timedelta(hours=9), 1, "view", 1.0)], df.schema)
    late.write.mode("append").parquet(folder)
    ingest.run(ingest.windowed(ingest.once(stream()), late=None), out, str(tmp_path / "c1")).awaitTermination()
    got = spark.read.parquet(out).groupBy().agg(F.sum("events").alias("n"), F.count("*").alias("w")).first()
    assert (got.n, got.w) == (12, 4)
    held = []
    ingest.run(ingest.sessions(stream(), gap="30 minutes"), lambda batch, _: held.extend(batch.collect()), str(tmp_path / "c2"), "append").awaitTermination()
    assert held and all(r.events == 1 or r.events == 2 for r in held)
    assert os.path.isdir(tmp_path / "c2")
