"""Queries in two languages, registers, the event log, the API and rendering."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratalens.operators import eventlog, modules, registers, subsystems, upserts
from stratalens.plans import api, render, sqlfront

DAY = lambda n: dt.datetime(2025, 1, n)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- queries


@pytest.mark.parametrize(
    "given, expected",
    [
        ("ВЫБРАТЬ ПЕРВЫЕ 5 Т.Имя КАК Имя ИЗ Справочник.Товары КАК Т ГДЕ Т.Цена > &Цена", "select  `Т`.`Имя` as `Имя` from goods as `Т` where `Т`.`Цена` > :p_d0a6d0b5d0bdd0b0 limit 5"),
        ('ВЫБРАТЬ "ИЗ ""ГДЕ""" // ИЗ ГДЕ\n', "select 'ИЗ \"ГДЕ\"'"),
        ("select 'из' from x where a = &p", "select 'из' from x where a = :p"),
        ("ВЫБРАТЬ РАЗЛИЧНЫЕ а ИЗ б УПОРЯДОЧИТЬ   ПО а УБЫВ", "select distinct `а` from `б` order by `а` desc"),
        ("ВЫБРАТЬ а ИЗ (ВЫБРАТЬ ПЕРВЫЕ 2 а ИЗ б) КАК в ГДЕ а = ЗНАЧЕНИЕ(Перечисление . Цвет.Красный)", "select `а` from (select  `а` from `б` limit 2) as `в` where `а` = '7'"),
        ("ВЫБРАТЬ х.из ИЗ х", "select `х`.`из` from `х`"),
    ],
)
def test_translation(given, expected):
    assert " ".join(sqlfront.translate(given, {"Справочник.Товары": "goods"}, {"Перечисление.Цвет.Красный": "7"}).split()) == " ".join(expected.split())


def test_execute(spark):
    spark.range(30).createOrReplaceTempView("numbers")
    got = sqlfront.execute(spark, "ВЫБРАТЬ id ИЗ numbers ГДЕ id >= &С УПОРЯДОЧИТЬ ПО id", 10, {"С": 5})
    assert got.columns == ["id"] and got.rows[0] == (5,) and got.total == 10 and got.truncated
    assert not sqlfront.execute(spark, "select * from numbers limit 3", 10).truncated
    assert sqlfront.execute(spark, "select &d as d", None, {"d": "2025-01-02"}).rows == [(dt.datetime(2025, 1, 2),)]
    assert sqlfront.parameter("2025-01-02T03:04:05") == dt.datetime(2025, 1, 2, 3, 4, 5) and sqlfront.parameter("2025-13-02") == "2025-13-02" and sqlfront.parameter(5) == 5


@pytest.mark.parametrize("text", ["drop view numbers", "SELECTX 1", "insert into x select 1", "select 1; drop view numbers", "select * from nowhere", "select (", "select 1) limit 0; drop view numbers --", "ВЫБРАТЬ ЗНАЧЕНИЕ(Нет.Такого)", "select Reflect('java.lang.Math', 'abs', 1)", "select `java_method`('java.lang.Math', 'abs', 1)", ""])
def test_refused(spark, text):
    spark.range(3).createOrReplaceTempView("numbers")
    with pytest.raises(sqlfront.QueryError):
        sqlfront.execute(spark, text)
    assert spark.table("numbers").count() == 3
    valid, errors = sqlfront.validate(spark, text)
    assert not valid and errors


def test_batch(spark):
    assert sqlfront.batch("select ';' ; // a;b\n select 2;") == ["select ';'", "// a;b\n select 2"]
    assert sqlfront.validate(spark, "select &x + 1") == (True, [])


# --- registers


def test_registers(spark):
    df = spark.createDataFrame([("a", DAY(1), 5.0, "N"), ("a", DAY(2), 5.0, "R"), ("a", DAY(9), 3.0, "N"), ("b", DAY(3), 2.0, "N"), ("b", None, 9.0, "N"), ("b", DAY(4), None, "N"), ("c", DAY(20), 1.0, None)], "k string, at timestamp, q double, f string")
    own = registers.Accumulation("at", ("k",), "q", "f <=> 'R'")
    show = lambda d: sorted(tuple(float(x) if hasattr(x, "quantize") else x for x in r) for r in d.collect())
    assert show(registers.balance(df, own, "2025-01-02")) == [] and show(registers.balance(df, own, "2025-01-31")) == [("a", 3.0), ("b", 2.0), ("c", 1.0)]
    assert show(registers.turnovers(df, own, "2025-01-02", "2025-01-09")) == [("a", DAY(1), 3.0, 5.0, -2.0), ("b", DAY(1), 2.0, 0.0, 2.0)]
    got = show(registers.balance_and_turnovers(df, own, "2025-01-02", "2025-01-10", "day"))
    assert got == [("a", DAY(2), 5.0, 0.0, 5.0, -5.0, 0.0), ("a", DAY(9), 0.0, 3.0, 0.0, 3.0, 3.0), ("b", DAY(3), 0.0, 2.0, 0.0, 2.0, 2.0)]
    filled = show(registers.balance_and_turnovers(df, own, "2025-01-02", "2025-01-04", "day", fill=True))
    assert len(filled) == 6 and filled[1] == ("a", DAY(3), 0.0, 0.0, 0.0, 0.0, 0.0) and filled[5] == ("b", DAY(4), 2.0, 0.0, 0.0, 0.0, 2.0)
    assert rows(registers.slice_last(df, "at", ["k"], ["q"], [], "2025-01-05")) == [("a", DAY(2), 5.0), ("b", DAY(4), None)]
    assert rows(registers.slice_first(df, "at", ["k"], ["q"], [], "2025-01-03"))[0] == ("a", DAY(9), 3.0)
    assert registers.balance(df.limit(0), own, "2025-01-02").count() == 0
    with pytest.raises(ValueError):
        registers.turnovers(df, own, "2025-01-02", "2025-01-09", "fortnight")


# --- event log


def test_event_log(spark):
    df = spark.createDataFrame([(n, DAY(n), 1 + n % 2, "error" if n % 3 else "view") for n in range(1, 29)], "event_id long, ts timestamp, user_id long, event_type string")
    assert eventlog.total(eventlog.filtered(df, "2025-01-05", "2025-01-10")).first().total == 6
    assert eventlog.total(eventlog.filtered(df, "2025-01-05", "2025-01-10", level="view", user=1)).first().total == 1
    assert eventlog.total(eventlog.filtered(df, now=dt.datetime(2025, 1, 20))).first().total == 16
    page = eventlog.page_with_total(eventlog.filtered(df, "2025-01-01"), 3).collect()
    assert [(r.event_id, r.total) for r in page] == [(1, 28), (2, 28), (3, 28)]
    for bad in ({"start": "yesterday"}, {"start": "2025-01-05", "end": "2025-01-01"}, {"start": "2025-01-01", "level": "none"}, {"start": "2025-01-01", "user": 99}):
        with pytest.raises(ValueError):
            eventlog.filtered(df, **bad)


# --- subsystems, facets and changes


def test_subsystems(spark):
    member = [("r", "Catalog.А", "Розница", "Продажи", "П.П.Р"), ("r", "Справочник.А", "Закупки", "Закупки", "П.З"), ("r", "Справочник.А", "Розница", "Продажи", "П.П.Х"), ("r", "Документ.А", "Закупки", "Закупки", "П.З"), ("r", "Документ.ЧекПрисоединенныеФайлы", "Розница", "Продажи", "П"), ("r", "Документ.ЧекПрисоединенныеФайлы", "Закупки", "Закупки", "П"), ("r", None, "x", "x", "x")]
    m = spark.createDataFrame(member * 2, "repo string, object string, name string, root string, path string")
    u = spark.createDataFrame([("r", "Catalog.А"), ("r", "Справочник.Валюты"), ("r", "РегистрСведений.ВалютПрисоединённыеФайлы"), ("q", "Отчет.О"), ("r", "Справочник.Валюты")], "repo string, object string")
    assert rows(subsystems.orphans(u, m)) == [("q", "Отчет.О"), ("r", "Справочник.Валюты")]
    assert rows(subsystems.orphan_status(u.where("repo = 'q'"), m)) == [("q", 1, 1, "orphans"), ("r", 0, 0, "unavailable")]
    assert rows(subsystems.containing(m, " СПРАВОЧНИК.а ")) == [("r", "Справочник.А", "Закупки", "Закупки"), ("r", "Справочник.А", "Розница", "Продажи")]
    assert {r[1] for r in rows(subsystems.containing(m, "а"))} == {"Справочник.А", "Документ.А"}
    assert {r[1] for r in rows(subsystems.containing(m, "а", "document"))} == {"Документ.А"} and {r[1] for r in rows(subsystems.containing(m, "а", "Отчет"))} == {"Справочник.А", "Документ.А"}
    assert subsystems.containing(m, "нет").count() == 0
    assert rows(subsystems.intersections(m)) == [("r", "Справочник.А", 2, 2)] == rows(subsystems.intersections(m, True))
    assert rows(subsystems.coverage_warnings(m, u)) == [("r", "Документ")]
    assert subsystems.orphans(u.limit(0), m).count() == 0 and subsystems.intersections(m.limit(0)).count() == 0


def test_collapsed(spark):
    df = spark.createDataFrame([("r", f"k{n % 7}") for n in range(15)] + [("q", "x")], "repo string, doc_id string")
    assert rows(modules.collapsed(df)) == [("r", 8, 7, "k0|k1|k2|k3|k4")]
    assert rows(modules.counts(df)) == [(16, 8)] and modules.contains(df, "k3") and modules.content(df, "k3").count() == 2 and not modules.contains(df, "k9")


def test_changes(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 1, 1), ("c", 1, 1)], "p string, m long, s long")
    new = spark.createDataFrame([("a", 1, None), ("b", 1, 2), ("d", 1, 1)], "p string, m long, s long")
    diff = upserts.file_diff(old, new, ["p"], ["m", "s"])
    assert rows(diff) == [("b", "modified"), ("c", "deleted"), ("d", "added")]
    assert rows(upserts.apply_changes(old, diff.join(new, "p", "left"), ["p"])) == rows(new)
    assert rows(upserts.reload_report(old, new, ["p"], ["m", "s"])) == [(3, 3, 1, 1, 1, True, True)]
    assert not upserts.reload_report(old, new.limit(0), ["p"], ["m", "s"]).first().accepted
    assert rows(upserts.overlay(old, new.where("p = 'b'"), ["p"])) == [("a", 1, None, "base"), ("b", 1, 2, "overlay"), ("c", 1, 1, "base")]
    assert rows(upserts.delete(old, new, ["p"])) == [("c", 1, 1)]


# --- the API


@pytest.fixture(scope="module")
def workspace(spark):
    return api.Workspace.of_folder(spark, "/root/testdata/sf0.001")


def test_api(workspace):
    w = workspace
    assert api.metadata_tree(w).where("known").count() > 3 and api.metadata_tree(w, "Нет такой").count() == 0
    assert ("", "doc_id", "bigint") in rows(api.object_structure(w, "documents"))
    assert dict(rows(api.configuration_info(w)))["tables"] == str(len(w.tables))
    found = api.search_code(w, "Возврат", "exact", 5)
    assert found.hits.count() == 5 < found.total.first().total
    assert api.search_code(w, r"(?i)возврат\s", "regex").total.first().unit == "lines" and api.search_code(w, "возврат").total.first().unit == "modules"
    for bad in ({"query": ""}, {"query": "x", "mode": "fuzzy"}, {"query": "x", "namespace": "y"}):
        with pytest.raises(ValueError):
            api.search_code(w, **bad)
    assert api.function_help(w, "strlen").count() == 1
    assert api.execute_query(w, "ВЫБРАТЬ КОЛИЧЕСТВО(*) КАК n ИЗ nation").rows == [(25,)]
    assert api.validate_query(w, "select * from nation")[0] and not api.validate_query(w, "delete from nation")[0]
    assert api.event_log(w, "2024-01-01", limit=3).count() == 3
    assert api.analyze_subsystems(w, "orphans").count() > 0 and api.analyze_subsystems(w, "intersections", cross_branch=True).count() > 0
    for bad in (("nothing",), ("containing", " ")):
        with pytest.raises(ValueError):
            api.analyze_subsystems(w, *bad)
    one = w.table("form_info").where("payload like '%handler%'").orderBy("form_id").first()
    assert api.form_structure(w, one.object).where("record = 'form'").count() >= 0
    with pytest.raises(KeyError):
        w.table("none")
    assert api.Workspace(w.spark, {}, lambda name: w.table(name)).table("nation").count() == 25
    assert api.clamp(0) == 50


def test_functions(spark):
    api.register_functions(spark)
    assert rows(spark.sql("select * from lines_of('a\nb')")) == [(1, "a"), (2, "b")]
    assert spark.sql("select with_synonyms(array('если', 'x')) as w").first().w == ["если", "if", "x"]


def test_render(spark):
    df = spark.createDataFrame([(1.0, "a|b", None), (1.5, "c\nd", [1, 2])], "x double, y string, z array<int>")
    assert render.table(df, "T") == "## T (2)\n\n| x | y | z |\n| --- | --- | --- |\n| 1 | a\\|b |  |\n| 1.5 | c d | 1, 2 |\n" and "No rows" in render.table(df.limit(0), "T")
    assert render.fenced("a```b") == "````\na```b\n````" and render.inline("`a\nb") == "`` `a�b ``"
    assert render.tree(spark.createDataFrame([("П.А.Б",), ("П.А",)], "path string")) == "- А\n  - Б\n"
    assert "k:2" in render.hits(spark.createDataFrame([("k", 2, "ctx")], "doc_id string, line_no int, context string"), 1, "lines") and render.counted_list(df, "L", "y").startswith("# L (2)")
    assert [r[0] for r in df.select(render.cell(F.col("x"))).collect()] == ["1", "1.5"]
