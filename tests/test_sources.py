"""Files of a dump: scans, generations, forms, subsystems, layout and HTTP."""

import errno
import http.server
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from stratalens.sources import formxml, http as http_source, layout, subsystemxml, tree


def put(root, path, text):
    where = root / path
    where.parent.mkdir(parents=True, exist_ok=True)
    where.write_bytes(text if isinstance(text, bytes) else text.encode())


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def dump(tmp_path):
    root = tmp_path / "dump src"
    put(root, "Catalogs/Номенклатура/Ext/ObjectModule.bsl", "﻿Процедура А()\r\nКонецПроцедуры\n")
    put(root, "CommonModules/Общий/Ext/Module.BSL", "x = 1;")
    put(root, "CommonModules/Общий/Ext/Module.bsl", "x = 1;")
    put(root, "Documents/Д/Forms/Ф/Ext/Form/Module.bsl", "")
    put(root, "Documents/Д/readme.txt", "no module")
    put(tmp_path, "outside/secret.bsl", "secret")
    os.symlink(tmp_path / "outside" / "secret.bsl", root / "Documents" / "link.bsl")
    return root


def test_scan(spark, dump):
    found = {r.rel_path: r for r in tree.scan(spark, str(dump)).collect()}
    assert set(found) == {"Catalogs/Номенклатура/Ext/ObjectModule.bsl", "CommonModules/Общий/Ext/Module.BSL", "CommonModules/Общий/Ext/Module.bsl", "Documents/Д/Forms/Ф/Ext/Form/Module.bsl"}
    one = found["Catalogs/Номенклатура/Ext/ObjectModule.bsl"]
    assert one.content == "Процедура А()\r\nКонецПроцедуры\n" and one.doc_id == "Справочник.Номенклатура.МодульОбъекта" and one.category == "Справочник" and one.size == len("﻿Процедура А()\r\nКонецПроцедуры\n".encode())
    assert found["CommonModules/Общий/Ext/Module.bsl"].doc_id == "ОбщийМодуль.Общий.Модуль"
    paths = tree.scan_paths(spark, str(dump))
    assert "content" not in paths.columns and paths.count() == 4
    assert tree.content_of(spark, str(dump), "CommonModules/Общий/Ext/Module.bsl") == "x = 1;"
    assert tree.content_of(spark, str(dump), "../outside/secret.bsl") is None and tree.content_of(spark, str(dump), "Documents/link.bsl") is None
    assert tree.within(str(dump), str(dump / "a")) and not tree.within(str(dump), str(dump.parent))


def test_failures():
    assert tree.failure_is_of_the_file(PermissionError(errno.EACCES, "x")) and not tree.failure_is_of_the_file(OSError(errno.EMFILE, "x")) and not tree.failure_is_of_the_file(OSError(errno.ENOMEM, "x"))


def test_manifest_and_generations(spark, dump, tmp_path):
    folder = str(tmp_path / "index")
    first = tree.reload(spark, str(dump), folder)
    assert first["accepted"] and first["after"] == 4 and first["added"] == 4
    again = tree.reload(spark, str(dump), folder)
    assert not again["changed"] and again["generation"] == first["generation"]
    put(dump, "CommonModules/Новый/Ext/Module.bsl", "y")
    os.remove(dump / "CommonModules/Общий/Ext/Module.BSL")
    third = tree.reload(spark, str(dump), folder)
    assert (third["added"], third["deleted"], third["before"], third["after"]) == (1, 1, 4, 4)
    assert tree.open_generation(spark, folder).count() == 4 and tree.current(spark, folder) == third["generation"]
    assert tree.info(spark, folder, str(dump))["modules"] == 4
    empty = tree.build_generation(tree.open_generation(spark, folder).limit(0), folder)
    assert not tree.publish(spark, folder, empty) and tree.current(spark, folder) == third["generation"]
    assert len(tree.reap(spark, folder, 0, 1 << 50)) == 2 and tree.open_generation(spark, folder).count() == 4
    with pytest.raises(FileNotFoundError):
        tree.open_generation(spark, folder, "none")
    text = tree.manifest_json(tree.open_generation(spark, folder))
    assert rows(tree.manifest_from_json(spark, text)) == rows(tree.open_generation(spark, folder).select(*tree.MANIFEST.names))
    assert tree.manifest_from_json(spark, text.replace('"sv": 6', '"sv": 7')) is None and tree.manifest_from_json(spark, "{") is None and tree.manifest_from_json(spark, None) is None


FORM = """﻿<?xml version="1.0" encoding="UTF-8"?>
<Form xmlns="urn:lf" xmlns:v8="urn:core" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">
 <Title><v8:item><v8:lang>en</v8:lang><v8:content>Title</v8:content></v8:item></Title>
 <Events><Event name="OnOpen">ПриОткрытии</Event></Events>
 <AutoCommandBar name="Bar"><ChildItems><Button name="ignored"/></ChildItems></AutoCommandBar>
 <ChildItems>
  <UsualGroup name="Группа"><ExtendedTooltip name="x"><Events><Event name="no">no</Event></Events></ExtendedTooltip>
   <ChildItems><InputField name="Поле"><DataPath>Объект.Поле</DataPath><Events><Event name="OnChange">ПриИзм</Event></Events><ContextMenu name="m"><ChildItems><Button name="no"/></ChildItems></ContextMenu></InputField></ChildItems>
  </UsualGroup>
  <Table name="Список"><AutoCommandBar name="c"><ChildItems><Button name="Кнопка"/></ChildItems></AutoCommandBar></Table>
  <Unknown name="skipped"><ChildItems><Button name="no"/></ChildItems></Unknown>
 </ChildItems>
 <Attributes>
  <Attribute name="Список"><Settings xsi:type="DynamicList"><ManualQuery>true</ManualQuery><QueryText>ВЫБРАТЬ 1</QueryText><MainTable>Catalog.X</MainTable></Settings></Attribute>
  <Attribute name="Другой"><Settings xsi:type="v8:DynamicList"/></Attribute>
  <Attribute name="Иной"><Settings xmlns:q="urn:lf" xsi:type="q:DynamicList"/></Attribute>
  <Attribute name="Нет"><Settings xsi:type="none:DynamicList"/></Attribute>
 </Attributes>
 <Commands><Command name="К"><Action>Действие</Action></Command></Commands>
</Form>"""


def test_form():
    found = formxml.read_form(FORM)
    assert found["title"] == "Title" and found["handlers"] == [{"event": "OnOpen", "handler": "ПриОткрытии"}] and found["commands"] == [{"name": "К", "action": "Действие"}]
    assert [(e["name"], e["type"]) for e in found["elements"]] == [("Группа", "UsualGroup"), ("Поле", "InputField"), ("Список", "Table"), ("Кнопка", "Button")]
    assert found["elements"][1] == {"name": "Поле", "type": "InputField", "title": "", "data_path": "Объект.Поле", "events": [{"event": "OnChange", "handler": "ПриИзм"}]} and found["elements"][0]["events"] == []
    assert [(d["name"], d["manual_query"], d["main_table"]) for d in found["dynamic_lists"]] == [("Список", True, "Catalog.X"), ("Иной", False, "")]
    assert (found["parse_incomplete"], found["no_form_root"]) == (False, False)
    part = formxml.read_form(FORM[: FORM.index("<Table")])
    assert part["parse_incomplete"] and [e["name"] for e in part["elements"]] == ["Группа", "Поле"] and part["title"] == "Title"
    assert formxml.read_form("<a/>")["no_form_root"] and formxml.read_form("")["no_form_root"]


def test_form_files(spark, tmp_path):
    root = tmp_path / "d"
    put(root, "Catalogs/Товары/Forms/Б/Ext/Form.xml", FORM)
    put(root, "Catalogs/Товары/Forms/А/Ext/Form.xml", "<Form>")
    put(root, "CommonForms/Общая/Ext/Form.xml", FORM)
    files = formxml.form_files(spark, str(root), "Catalog", "Товары")
    assert sorted(r.form_name for r in files.select("form_name").collect()) == ["А", "Б"]
    read = {r.path.split("/")[-3]: r for r in formxml.parsed(files).collect()}
    assert len(read["Б"].elements) == 4 and read["А"].parse_incomplete
    assert formxml.form_files(spark, str(root), "CommonForm", "Общая").first().form_name == "Общая"
    assert formxml.form_files(spark, str(root), "Document", "Нет").count() == 0
    for bad in ("", "..", "a/b", "a\\b", "a\x00"):
        with pytest.raises(ValueError):
            formxml.form_files(spark, str(root), "Catalog", bad)
    with pytest.raises(ValueError):
        formxml.form_files(spark, str(root), "Nothing", "Товары")


def test_form_merge(spark):
    schema = "object string, name string, elements array<string>, handlers array<string>, commands array<string>, dynamic_lists array<string>"
    live = spark.createDataFrame([("a", "Ф", ["l"], ["l"], [], None), ("b", "Ф", ["l"], [], [], []), ("c", "Ф", ["l"], [], [], []), ("e", "Ф", ["l"], [], [], [])], schema)
    dump = spark.createDataFrame([("a", "Ф", ["d"], [], ["d"], None), ("b", "Другая", ["d"], [], [], []), ("d", "Ф", ["d"], [], [], []), ("e", "Другая", [], None, [], [])], schema)
    assert rows(formxml.merged(live, dump, ["object"])) == [("a", "Ф", ["d"], ["l"], ["d"], None), ("b", "Другая", ["d"], [], [], []), ("c", "Ф", ["l"], [], [], []), ("d", "Ф", ["d"], [], [], []), ("e", "Ф", ["l"], [], [], [])]


def test_live_forms(spark):
    df = spark.createDataFrame([({"ОсновнаяФорма": "Ф2", "ОсновнаяФормаСписка": "Ф1", "ПриОткрытии": "А", "ПередЗаписью": " ", "Иное": "x"}, ["Ф3"]), ({}, ["Ф3", "Ф4"]), ({}, [])], "p map<string,string>, f array<string>")
    got = df.select(formxml.main_form(F.col("p"), F.col("f")).alias("m"), formxml.live_handlers(F.col("p")).alias("h")).collect()
    assert [r.m for r in got] == ["Ф1", "Ф3", None] and [[tuple(h) for h in r.h] for r in got] == [[("ПриОткрытии", "А")], [], []]


def subsystem_xml(name, content=(), inner="", synonym="С"):
    items = "".join(f"<v:Item>{c}</v:Item>" for c in content)
    return f'<MetaDataObject xmlns:v="urn:v"><Subsystem><Properties><Name>{name}</Name><Synonym><v:item><v:lang>en</v:lang><v:content>E</v:content></v:item><v:item><v:lang>ru</v:lang><v:content>{synonym}</v:content></v:item></Synonym><Content>{items}</Content></Properties><ChildObjects>{inner}</ChildObjects></Subsystem></MetaDataObject>'


def test_subsystems(spark, tmp_path):
    a = tmp_path / "a"
    put(a, "Subsystems/Продажи.xml", subsystem_xml("Продажи", ["Document.Б", "Catalog.А", "nodot"]))
    put(a, "Subsystems/Продажи/Subsystems/Розница.xml", subsystem_xml("Розница", ["Report.В"]))
    put(a, "Subsystems/Сбой.xml", "<MetaDataObject>")
    nodes, warnings = subsystemxml.forest(spark, str(a))
    assert rows(nodes) == [("Подсистема.Продажи", None, "Продажи", "Продажи", "С", ["Документ.Б", "Справочник.А"]), ("Подсистема.Продажи.Розница", "Подсистема.Продажи", "Продажи", "Розница", "С", ["Отчет.В"])]
    assert rows(warnings) == [("Сбой", "the file can't be read")]
    assert subsystemxml.membership(nodes).count() == 3
    b = tmp_path / "b"
    inner = subsystem_xml("Дочь", ["Role.Р"]).split("<MetaDataObject xmlns:v=\"urn:v\">")[1].split("</MetaDataObject>")[0]
    put(b, "Subsystems/Мать/Ext/Subsystem.xml", subsystem_xml("Мать", [], inner))
    nodes, warnings = subsystemxml.forest(spark, str(b))
    assert [r[:2] + (r[5],) for r in rows(nodes)] == [("Подсистема.Мать", None, []), ("Подсистема.Мать.Дочь", "Подсистема.Мать", ["Роль.Р"])] and warnings.count() == 0
    deep = "<a>" * 300 + "</a>" * 300
    assert subsystemxml.read_subsystem(deep)["warning"] == "the markup is nested too deep"


def test_universe(spark, tmp_path):
    put(tmp_path, "Catalogs/Товары.xml", "x")
    put(tmp_path, "Catalogs/Товары/Ext/Predefined.xml", "x")
    put(tmp_path, "Document/Заказ/Ext/Заказ.xml", "x")
    put(tmp_path, "Subsystems/С.xml", "x")
    put(tmp_path, "Roles/readme.txt", "x")
    objects, present = subsystemxml.universe(spark, str(tmp_path))
    assert rows(objects) == [("Документ.Заказ",), ("Справочник.Товары",)] and rows(present) == [("Документ",), ("Роль",), ("Справочник",)]


def manifest(name="Расш", extra="<ObjectBelonging>Adopted</ObjectBelonging>"):
    return f"<?xml version='1.0'?><!-- <Properties> --><M><Properties>{extra}<Name>{name}</Name></Properties></M>"


@pytest.mark.parametrize(
    "head, complete, expected",
    [
        (manifest(), True, ("extension", "Расш")), (manifest(extra=""), True, ("not_extension", "")), (manifest("3D"), True, ("undecided", "name_rejected")), ("<M>", True, ("not_extension", "")), ("<M>", False, ("undecided", "truncated")),
        ("<!DOCTYPE x>" + manifest(), True, ("undecided", "unscannable")), ("<M><!-- ", True, ("undecided", "malformed")), ("<M><!-- ", False, ("undecided", "truncated")), ("<Properties><ObjectBelonging>", False, ("undecided", "truncated")),
    ],
)
def test_classify(head, complete, expected):
    assert layout.classify(head, complete) == expected


def test_layout(spark, tmp_path):
    put(tmp_path, "ext1/Configuration.xml", manifest("Первое"))
    put(tmp_path, "ext1/Catalogs/Н/Ext/ObjectModule.bsl", "x")
    put(tmp_path, "bad/Configuration.xml", manifest("a-b"))
    put(tmp_path, "Catalogs/Н/Ext/ObjectModule.bsl", "x")
    found = layout.detect(str(tmp_path))
    assert found.children == {"ext1": "Первое"} and found.doubts == [("bad", "name_rejected")] and found.summary() == {"self_named": False, "extensions": 1, "folders": ["ext1"], "name_rejected": 1}
    keys = {r.rel_path: r.doc_id for r in tree.scan_paths(spark, str(tmp_path), found).collect()}
    assert keys == {"ext1/Catalogs/Н/Ext/ObjectModule.bsl": "ext.Первое.Справочник.Н.МодульОбъекта", "Catalogs/Н/Ext/ObjectModule.bsl": "Справочник.Н.МодульОбъекта"}
    assert layout.detect(str(tmp_path / "ext1")).own == "Первое" and layout.detect(str(tmp_path / "none")).summary()["extensions"] == 0
    assert layout.inspect_root(str(tmp_path))["nested_roots"] == ["bad", "ext1"]
    (tmp_path / "Documents").mkdir()
    assert layout.inspect_root(str(tmp_path))["is_root"]


@pytest.fixture
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        def _answer(self, body):
            if self.path == "/away":
                self.send_response(302)
                self.send_header("Location", "http://127.0.0.2:1/x")
                self.end_headers()
                return
            self.send_response(200 if self.headers.get("Authorization") else 401)
            self.end_headers()
            self.wfile.write(b"no json" if self.path == "/bad" else json.dumps({"data": {"rows": [{"a": 1, "got": body}, {"a": 2}]}}).encode())

        def do_GET(self):
            self._answer(None)

        def do_POST(self):
            self._answer(self.rfile.read(int(self.headers["Content-Length"])).decode())

        def log_message(self, *_):
            pass

    held = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield f"127.0.0.1:{held.server_port}"
    held.shutdown()


def test_http(spark, server):
    spark.dataSource.register(http_source.JsonHttp)
    df = spark.read.format("jsonhttp").option("records", "data.rows").option("user", "u").option("password", "p").option("body", "{}").option("urls", json.dumps([f"http://{server}/1", f"http://{server}/2"])).load()
    assert rows(df.select(F.from_json("record", "a int, got string").alias("r")).select("r.*")) == [(1, "{}"), (1, "{}"), (2, None), (2, None)]
    assert http_source.fetch(f"http://u:secret@{server}/x")["data"]["rows"][1] == {"a": 2}
    for path, message in (("/bad", "no JSON"), ("/away", "another host")):
        with pytest.raises(http_source.HttpError, match=message) as error:
            http_source.fetch(f"http://u:secret@{server}{path}")
        assert "secret" not in str(error.value)
    with pytest.raises(http_source.HttpError, match="401"):
        http_source.fetch(f"http://{server}/x")
    with pytest.raises(http_source.HttpError, match="above"):
        http_source.fetch(f"http://u:p@{server}/x", most=5)
