"""Problem 1: forms and pairs, against a plain pairwise comparison."""

import datetime as dt
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from stratalens.llm import lookalikes
from stratalens.llm.scripts import scripts

ENTRY = "entry_id long, repo string, doc_id string, category string, object_name string, module_type string, indexed_at timestamp"
NODE = "subsystem_id long, repo string, name string"


@pytest.fixture(scope="module")
def form(spark):
    known = scripts(spark)
    return lambda text: lookalikes.consistent(text, known).text


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tables(spark):
    known = scripts(spark)
    assert len(known.members) > 100
    assert known.names[known.mask("я").bit_length() - 1] == "Cyrl" and known.mask("1") == 0
    same = lambda a, b: known.look.get(a, a) == known.look.get(b, b)
    for a, b in ("АA", "аa", "ΟO", "оo", "сc", "Үб", "гr", "пn", "З3", "О0", "кk", "вb", "иu", "Il", "лл"):
        assert same(a, b) == ((a + b) in {"АA", "аa", "ΟO", "оo", "сc", "лл"}), (a, b)


@pytest.mark.parametrize(
    "a, b",
    [
        ("Cклад", "Склад"), ("Ｃклад", "Склад"), ("С​к­лад", "Склад"), ("Учëт", "Учёт"), ("Учёт", "Учёт"), ("УчетЙ", "УчетЙ"), ("а б", "а б"), ("а　б", "а б"),
        ("ΟБМЕН", "ОБМЕН"), ("TOP", "ТОР"), ("СкладAPI", "СкладАРІ"), ("Gebühren", "Gebühren"), ("ОНИ", "OHИ"), ("﻿Прода⁠жи", "Продажи"), ("ext.WMS_Bridge.Склад", "ext.WМS_Bridge.Cклaд"),
    ],
)
def test_meet(form, a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize("a, b", [("Учёт", "Учет"), ("Рейсов", "Реисов"), ("Учёт", "учёт"), ("а б", "аб"), ("а б", "а_б"), ("Gebühren", "Gebuhren"), ("О1", "01"), ("З", "3"), ("Il", "ll"), ("гора", "rора"), ("к", "k"), ("а-б", "а—б")])
def test_stay_apart(form, a, b):
    assert form(a) != form(b)


def test_spelling(spark, form):
    assert form("Cклaд") == "Склад" and form("Salеs") == "Sales" and form("НТТР") == "HTTP" and form("ОбменTOP") == "ОбменTOP"
    got = lookalikes.consistent("CкладTOP", scripts(spark))
    assert (got.text, got.mixed, got.whole) == ("СкладTOP", 1, 1)
    assert lookalikes.consistent("ЖwЖ", scripts(spark)).mixed == 1
    assert form("") == "" and form("a" * 100_000 + "а") == "a" * 100_001


def test_pairs(spark):
    entry = [
        (1, "r", "Склад", "К", "Склад", "М"), (2, "r", "Cклад", "К", "Cклад", "Н"), (3, "q", "Cклад", "К", "x", "М"), (4, "r", "склад", "К", "Cклaд", "М"), (2, "r", "Cклад", "К", "Cклад", "Н"),
        (5, "r", None, None, "Oпт", None), (6, "r", "", None, "Опт", None), (7, None, "TOP", "К", None, "М"), (8, None, "ТОР", "К", "", "М"),
    ]
    entry = spark.createDataFrame([(*r, dt.datetime(2025, 1, 1)) for r in entry], ENTRY)
    nodes = spark.createDataFrame([(7, "r", "Oпт"), (5, "r", "Опт"), (6, "r", "Опт"), (8, "r", None)], NODE)
    assert rows(lookalikes.found(entry, nodes)) == [("doc_id", 1, 2), ("doc_id", 7, 8), ("name", 5, 7), ("name", 6, 7), ("object_name", 1, 4), ("object_name", 5, 6)]
    assert lookalikes.found(entry.limit(0), nodes.limit(0)).count() == 0
    assert lookalikes.forms(entry, nodes).count() == 7 + 8 + 3 - 1


def test_brute_force(spark, form):
    entry = spark.read.parquet("/root/testdata/sf0.001/path_entry.parquet")
    nodes = spark.read.parquet("/root/testdata/sf0.001/subsystem.parquet")
    own = [(r.entry_id, r.repo, r.doc_id, form(r.doc_id)) for r in entry.distinct().collect() if r.doc_id is not None]
    expected = {(a[0], b[0]) for a in own for b in own if a[0] < b[0] and a[1] == b[1] and a[2] != b[2] and a[3] == b[3]}
    assert {r[1:] for r in rows(lookalikes.found(entry, nodes)) if r[0] == "doc_id"} == expected


def test_coarse_forms_are_equal_wherever_forms_are(spark, form):
    rng = random.Random(8)
    known = scripts(spark)
    alphabet = list("АаЕеСсОоХхРрЙйЁёЖжABCOXaceoxpyäöüéÅ 1_.-") + ["\u0306", "\u0308", "\u200b", "\ufeff", "\u00a0", "\u3000", "Ａ", "ｅ", "Ο", "ο", "ﬁ", "fi", "각", "가", "\U0001d400", "\u212b", "Ӏ", "I", "l"]
    sames = {}
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 6)))
        sames.setdefault(form(text), set()).add(text)
        other = "".join(rng.choice([c, *known.members[known.look[c]].values()]) if c in known.look else c for c in text)
        sames.setdefault(form(other), set()).add(unicodedata.normalize(rng.choice(["NFC", "NFD"]), other))
    df = spark.createDataFrame([(f, t) for f, ts in sames.items() for t in ts], "f string, t string")
    assert df.select("f", lookalikes._coarse("t", spark).alias("c")).distinct().groupBy("f").count().where("count > 1").count() == 0


def test_many_rows_of_one_spelling(spark):
    rows = spark.range(20_000).select(F.col("id").alias("subsystem_id"), F.lit("r").alias("repo"), F.when(F.col("id") == 7, "Cклад").otherwise("Склад").alias("name"))
    assert lookalikes.found(spark.createDataFrame([], ENTRY), rows).count() == 19_999
