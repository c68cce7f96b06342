"""Keys of modules, references and names."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratalens.functions import keys

FIXTURES = (Path(__file__).parent.parent / "FIXTURES.md").read_text()
PAIRS = re.findall(r"^\| `([^`]+)` \| `([^`]+)` \|", FIXTURES.split("## 2. Key derivation pairs")[1].split("## 3.")[0], re.M)
WRAPS = ["a/", "src/cf/", "выгрузка/2024/", "Catalogs_old/x/y/"]


def test_fixture_pairs(spark):
    assert len(PAIRS) == 56
    got = spark.createDataFrame(PAIRS, "path string, expected string").withColumn("key", keys.module_key(F.col("path"))).collect()
    assert [(r.path, r.key) for r in got] == PAIRS


def test_wrapping_changes_no_key(spark):
    rooted = [(p, k) for p, k in PAIRS if k.split(".")[0] not in ("foo", "dump_bsl", "Ext", "ExternalDataProcessors", "Расширения", "Module") and not p.startswith("ext/") and p != "Catalogs/Ном/Ext/ManagedApplicationModule.bsl" and p != "Catalogs/Расширения/Y/Catalogs/Ном/Ext/ObjectModule.bsl" and "Constants/КурсВалюты/V" not in p]
    df = spark.createDataFrame([(w + p, k, w.count("/")) for p, k in rooted for w in WRAPS], "path string, expected string, depth int")
    bad = df.where((keys.module_key(F.col("path")) != F.col("expected")) | (keys.wrap_depth(F.col("path")) != F.col("depth"))).collect()
    assert bad == []


@pytest.mark.parametrize(
    "key, parts",
    [
        ("Справочник.Н.МодульОбъекта", ("", "Справочник", "Н", "МодульОбъекта")), ("Документ.Д.Форма.Ф.МодульФормы", ("", "Документ", "Д", "МодульФормы")),
        ("ext.Д.Справочник.Н.МодульОбъекта", ("ext", "Справочник", "Н", "МодульОбъекта")), ("ext.Р.Служба.id", ("ext", "ext", "Р", "id")), ("ext.Н.Форма.Ф.МодульФормы", ("ext", "ext", "Н", "МодульФормы")),
        ("а.б", ("", "а", "б", "")), ("один", ("", "", "один", "")), ("", ("", "", "", "")), ("ext", ("", "", "ext", "")),
    ],
)
def test_slots(spark, key, parts):
    assert tuple(spark.createDataFrame([(key,)], "k string").select(keys.slots(F.col("k")).alias("s")).first().s) == parts


def test_references(spark):
    given = {"Catalog.Н": "Справочник.Н", "catalog.Н": "catalog.Н", "Справочник.Н": "Справочник.Н", "commonmodule.М": "ОбщийМодуль.М", "CONSTANT.К": "Константа.К", "X.Y": "X.Y", "нет": "", "Document.й": "Документ.й", "Report.А.Б": "Отчет.А.Б", "": ""}
    df = spark.createDataFrame([(k,) for k in given], "r string")
    assert {r.r: r.c for r in df.select("r", keys.canonical_reference(F.col("r")).alias("c")).collect()} == given
    one = spark.createDataFrame([("А.Б.В",), ("А",)], "r string").select(keys.short_name(F.col("r")), keys.kind_prefix(F.col("r"))).collect()
    assert [tuple(r) for r in one] == [("В", "А"), ("А", "")]


def test_names_and_layout(spark):
    names = {"Доработки3D": True, "_x": True, "3D": False, "a-b": False, "a" * 128: True, "a" * 129: False, "aㅤ": False, "": False}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.ok for r in df.select("n", keys.is_extension_name(F.col("n")).alias("ok")).collect()} == names
    path = spark.createDataFrame([("child/Catalogs/Н/Ext/ObjectModule.bsl",), ("Catalogs/Н/Ext/ObjectModule.bsl",)], "p string")
    got = path.select(keys.layout_key(F.col("p"), "Own", {"child": "Kid"})).collect()
    assert [r[0] for r in got] == ["ext.Kid.Справочник.Н.МодульОбъекта", "ext.Own.Справочник.Н.МодульОбъекта"]
    assert path.select(keys.layout_key(F.col("p"), None, {})).collect()[0][0] == "Справочник.Н.МодульОбъекта"
    assert path.select(keys.module_key(F.lit(None).cast("string"))).first()[0] is None
