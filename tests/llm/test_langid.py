"""Training sample, prose and rejection of language identification."""

import unicodedata

from pyspark.sql import functions as F

from stratalens.llm import langid


def test_copies_of_one_text_leave_room_for_others(spark):
    texts = spark.range(3000).select(F.concat(F.lit("some text "), "id").alias("text"))
    first = texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < 70_000).orderBy(F.xxhash64("text")).first().text
    copies = spark.range(5000).select(F.lit(first).alias("text"), F.lit("en").alias("lang"))
    few = spark.range(20).select(F.concat(F.lit("ein Text "), "id").alias("text"), F.lit("de").alias("lang"))
    others = spark.range(20).select(F.concat(F.lit("a text "), "id").alias("text"), F.lit("en").alias("lang"))
    got = langid.sample_rows(copies.unionAll(few).unionAll(others), "text", "lang")
    assert len(got) == len(set(got)) == 41 and sum(lang == "de" for lang, _ in got) == 20


def _words(text):
    return [[unicodedata.normalize("NFC", w.decode()) for w in langid.prose(langid.pa.array([t])).words.to_pylist()] for t in ([text] if isinstance(text, str) else text)]


def test_long_quotations_are_prose():
    long = "the stock of the warehouse is counted anew at the end of each month and then written down by the clerk"
    for a, b in ("«»", "„“", "“”", '""', "''", "{}", "<>"):
        assert _words(f"Здесь {a}{long}{b} и {a}short one{b} всё") == [["здесь", *long.split(), "и", "всё"]]
    assert _words(f'экран 5" {long} 7" всё') == [["экран", *long.split(), "всё"]]


def test_a_document_of_quotations_alone_keeps_them():
    assert _words(["«Остаток не найден»", "# Общее описание", "(см. раздел)", "`code` «да»"]) == [["остаток", "не", "найден"], ["общее", "описание"], ["см", "раздел"], ["да"]]
    assert _words(["`code`", "&НаСервере", "#Область Код", "|\tИЗ Таблица", "Запись «нет» готова"]) == [[], [], [], [], ["запись", "готова"]]
    found = langid.prose(langid.pa.array(["«да»\n\nтекст", None, "«нет»"]))
    assert [w.decode() for w in found.words.to_pylist()] == ["текст", "нет"] and found.row.tolist() == [0, 0, 2]


def test_rejection_reaches_documents_and_is_calibrated(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = langid.fit(langid.sample_rows(df, "text", "lang"))
    assert own.scale != langid.Identifier.scale and own.worst < 8
    texts = ["Il saldo del magazzino viene controllato alla fine di ogni mese e poi registrato", "在仓库中查看所有货物的余额并记录每月的结果", "Остаток товаров на складе проверяется в конце каждого месяца", "Да"]
    got = own.segments(langid.pa.array(texts))
    assert got["lang"].tolist() == [-1, -1, langid.LANGUAGES.index("ru"), -1]
    rows = langid.identify(df.unionByName(spark.createDataFrame([(-1, texts[1])], "doc_id long, text string"), allowMissingColumns=True), ["doc_id"]).where("doc_id = -1").collect()
    assert [(r.segment_no, r.lang) for r in rows] == [(0, None)]


def test_short_and_apart_texts():
    plain = langid.fit([])
    for text in ("x", "я", "e", "", "ab", "\n\n", "1", None):
        plain.segments(langid.pa.array([text], langid.pa.string()))
    apart = langid.pa.array(["чай", unicodedata.normalize("NFD", "чай ёж"), "é"])
    assert langid._composed(apart).to_pylist() == ["чай", "чай ёж", "é"]
    assert langid.prose(apart).letters.tolist() == [3, 3, 2, 1]
    assert langid.prose(apart.slice(1)).words.to_pylist()[0].decode() == "чай"
