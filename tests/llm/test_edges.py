"""Further columns with the names the operators use, empty tables and nulls everywhere."""

from pyspark.sql import functions as F

from stratalens.llm import langid, lookalikes, mixing, validity

NAMES = ("k", "t", "id", "form", "field_name", "f", "errors", "reason", "source2", "shard", "stop", "blocks", "quota", "uses", "n_tokens", "segment_no", "confidence", "mixed", "__text", "a", "b", "id_a", "id_b")


def clashing(df):
    for name in NAMES:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_further_columns_change_nothing(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    entry, node, source, docs, target = (read(n) for n in ("path_entry", "subsystem", "source_file", "documents", "mix_target"))
    assert rows(lookalikes.found(clashing(entry), clashing(node))) == rows(lookalikes.found(entry, node))
    assert rows(validity.flags(clashing(source))) == rows(validity.flags(source))
    assert rows(mixing.mix(clashing(docs), clashing(target)).documents) == rows(mixing.mix(docs, target).documents)
    assert rows(langid.identify(clashing(docs), ["doc_id"])) == rows(langid.identify(docs, ["doc_id"]))


def test_repeated_rows_count_once(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    entry, node, source = (read(n) for n in ("path_entry", "subsystem", "source_file"))
    assert rows(lookalikes.found(entry.unionAll(entry), node.unionAll(node))) == rows(lookalikes.found(entry, node))
    assert rows(validity.rates(source.unionAll(source))) == rows(validity.rates(source))
    assert rows(validity.errors(source.unionAll(source))) == rows(validity.errors(source))


def test_nulls_and_empty_tables(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    for name, run in (
        ("path_entry", lambda d: lookalikes.found(d, read("subsystem").limit(0))),
        ("source_file", validity.flags), ("source_file", validity.errors), ("source_file", validity.acceptance),
        ("documents", lambda d: mixing.mix(d, read("mix_target")).shares().where("mixed_tokens > 0")),
        ("documents", lambda d: langid.identify(d, ["doc_id"])),
    ):
        df = read(name)
        null = df.limit(3).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
        assert run(df.limit(0)).count() == 0 and run(null).count() == 0
        assert run(df.limit(20).unionAll(null)).count() >= 0


def test_blank_and_long_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \r\n \t\n"), (4, "Остаток товаров на складе проверяется в конце месяца. " * 20_000), (5, "The balance of the warehouse is checked at the end of the month.\r\n\r\nОстаток товаров на складе проверяется в конце каждого месяца.")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    got = {(r.doc_id, r.segment_no): r.lang for r in langid.identify(df, ["doc_id"]).collect()}
    assert {k for k in got if k[0] < 4} == set() and got[4, 0] == "ru" and (got[5, 1], got[5, 2]) == ("en", "ru")
