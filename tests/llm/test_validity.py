"""Problem 3: verdicts, errors and rates of the readers, and agreement with the C readers of JSON and XML."""

import json
import random
from xml.parsers import expat

import pytest

from stratalens.llm import bslreader, jsonreader, validity, xmlreader

GOOD = [
    "", "// only <<<<<<< remarks", "Перем А Экспорт;\n\n&НаСервере\nПроцедура П(Знач А = -1, Б)\n\tЕсли А <> 1 Тогда\n\t\tБ.В(, А)[1].Г = ?(А > 0, А, -А);\n\tИначеЕсли Не А Тогда Возврат\n\tКонецЕсли\nКонецПроцедуры",
    'A = "SELECT\n// remark\n|<<<<<<< ""x""";\nВыполнить("x");', "#If Server Then\nFunction F() Export\nFor Each X In Y Do Break EndDo;\nTry Raise; Except EndTry;\nReturn '20250101';\nEndFunction\n#EndIf", "~М: А = Новый Массив(1); Перейти ~М",
    "А = 1 + -2 * (3 - Не Б) = В И Г Или Д;", "А = " + "(" * 5000 + "1" + ")" * 5000 + ";", "\r\nА();\r\n",
]
BAD = ["Процедура П()", "Если А Тогда Б();", "А = (1;", 'А = "x', "А + 1;", "<<<<<<< HEAD\nА = 1;", "# Readme", "#Область А", "А() Б();", "Процедура П()\nКонецФункции", "А = 1 +;", "Для А = 1 Цикл КонецЦикла;", '{"a": 1}', "КонецЕсли;", "Б(); Процедура П() КонецПроцедуры", "Процедура П() КонецПроцедуры Перем А;", "А = 1 2;", "А = 12х;"]


@pytest.mark.parametrize("text", GOOD)
def test_valid_modules(text):
    assert bslreader.read(text).placed() == []


@pytest.mark.parametrize("text", BAD)
def test_invalid_modules(text):
    assert not bslreader.read(text).accepted


def test_reader_goes_on_after_errors():
    text = "Процедура А()\n\tБ = ;\n\tВ();\n\tЕсли Г Тогда\n\t\tД = (1;\n\tКонецЕсли;\nКонецПроцедуры\nПроцедура Е(\nКонецПроцедуры\nЖ = 1 +;\n"
    assert [(line, col) for line, col, _ in bslreader.read(text).placed()] == [(2, 6), (5, 9), (9, 1), (10, 8)]
    assert bslreader.read("Б = ;").placed() == [(1, 5, "expected a value, found ;")]
    assert [e[:2] for e in jsonreader.read('{"a": , "b": [1 2], "c": tru}').placed()] == [(1, 7), (1, 17), (1, 26)]
    assert [e[2] for e in xmlreader.read('<a x="1" x="2">&nbsp;<b></a></a>')[0].placed()] == ["attribute x twice", "undefined reference nbsp", "</a> closes <b>", "</a> closes nothing"]
    for name in ("bsl", "json", "xml"):
        rng = random.Random(2)
        for _ in range(300):  # any text comes to an end
            validity.read(name, "".join(rng.choices(["Если", "КонецЕсли", "Процедура", "КонецПроцедуры", "А", "=", "(", ")", ";", "\n", "<", ">", "</", "&", "{", "}", "[", '"', ",", ":", "1", "#", "~", "[CDATA[", "!--", "Возврат", "."], k=rng.randint(1, 30))))


def _mutated(rng, text, junk):
    at = rng.randrange(len(text) + 1)
    return rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice(junk) + text[at:], text[:at]])


def _no_constant(name):
    raise ValueError(name)


def _json_ok(text):
    try:
        json.loads(text, parse_constant=_no_constant)
        return True
    except ValueError:
        return False


def test_json_agrees():
    rng = random.Random(4)
    whole = json.dumps({"v": 1, "f": {"a\\\"é": [-1.5e3, True, None, ""], "b": []}, "n": " <<<"})
    texts = [whole, "", " ", "1", '"a', "[1,]", "{,}", "01", "1.", "[NaN]", '"\t"', "[" * 3000 + "]" * 3000, " 1"]
    texts += [_mutated(rng, _mutated(rng, whole, list('{}[]:,"\\ 1tn\x01')), list('{}[]:,"\\ 1tn\x01')) for _ in range(2000)]
    for text in texts:
        assert jsonreader.read(text).accepted == _json_ok(text), text


def _xml_ok(text):
    parser = expat.ParserCreate("utf-8")
    try:
        parser.Parse(text.encode(), True)
        return True
    except expat.ExpatError:
        return False


def test_xml_agrees():
    rng = random.Random(5)
    whole = "<Form a='1' b=\"&amp;&#1071;\"><!-- x --><v:b><![CDATA[<&]]></v:b><?p q?>t<c/></Form>"
    for _ in range(3000):
        text = f"<r>{_mutated(rng, _mutated(rng, whole, ['<', '>', '&', '&lt;', ']]>', '--', '\x01', '/', '=', ' ']), ['<', '>', '<d>', '</d>', '?', '!', chr(39)])}</r>"
        assert xmlreader.read(text)[0].accepted == _xml_ok(text), text


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tables(spark):
    texts = {
        ("a.XML", '﻿<?xml version="1.0" encoding="windows-1251"?><!-- c --><a><v:Form/></a>tail'): None, ("b.xml", "plain text"): "no_form_root", ("c.xml", ""): "no_form_root", ("d.xml", "<a/><b/>"): "no_form_root",
        ("e.xml", "<Form><a></Form>"): "parse_incomplete", ("f.xml", "<Form>"): "parse_incomplete", ("g.json", "[NaN]"): "parse_incomplete", ("h.json", '﻿{"a": [1, "\\u0430"]}'): None,
        ("i.json", ""): "parse_incomplete", ("j.bsl", "Процедура"): "parse_incomplete", ("k.bsl", "﻿// x"): None, ("l.xml", None): None, ("m.txt", "<"): None, (None, "x"): None,
    }
    df = spark.createDataFrame([(n, "r", p, t, "x") for n, (p, t) in enumerate(texts)] + [(1, "r", "b.xml", "plain text", "x")], "file_id long, repo string, rel_path string, content string, lang string")
    assert rows(validity.found(df)) == [(n, why) for n, why in enumerate(texts.values()) if why]
    assert rows(validity.rates(df))[1] == ("r", "json", 3, 2 / 3, 0.0)
    assert rows(validity.acceptance(df)) == [("bsl", 2, 1, 0.5, 2), ("json", 3, 1, 1 / 3, 2), ("xml", 6, 4, 2 / 3, 2)]
    assert rows(validity.errors(df))[0] == (4, "r", "xml", 1, 1, 10, "</Form> closes <a>")
    assert validity.flags(df).where("file_id = 6").first().first_cause == "unexpected NaN"
    assert validity.found(df.limit(0)).count() == 0
