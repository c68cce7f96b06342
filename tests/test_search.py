"""Search by lines and by relevance, and the patterns and words behind it."""

import math
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stratalens.functions import catalog, keys, text
from stratalens.operators import search

MODULE = "file_id long, doc_id string, namespace string, category string, object_name string, module_type string, content string"


def module(spark, *contents, category="К"):
    return spark.createDataFrame([(n, f"d{n:02}", "", category, "о", "т", c) for n, c in enumerate(contents, 1)], MODULE)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_ranked(spark):
    df = spark.createDataFrame([(3, "A b"), (1, "a B"), (2, "a a, c"), (4, None), (5, "d")], "doc_id long, text string")
    score = math.log1p(2.5 / 2.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 2))
    assert rows(search.ranked(df, "B b")) == [(1, round(score, 6)), (3, round(score, 6))]
    assert search.ranked(df, "?").count() == 0 and search.ranked(df.limit(0), "a").count() == 0


def test_lines(spark):
    m = module(spark, "а\nобновление цен\nОбновитьЦены\r\nб\nв\n", None, "", "обновитьцены обновитьцены").unionByName(module(spark, "а\nобновление цен\nОбновитьЦены\r\nб\nв\n"))
    ids = ["doc_id", "file_id"]
    assert rows(search.first_lines(m, search.exact("ОБНОВИТЬЦЕНЫ"), ids)) == [("d01", 1, 3, "ОбновитьЦены\r", "а\nобновление цен\nОбновитьЦены\r\nб\nв"), ("d04", 4, 1, "обновитьцены обновитьцены", "обновитьцены обновитьцены")]
    assert rows(search.line_total(m, search.exact("обновить"), ids)) == [(2, "lines")]
    assert rows(search.line_total(m, search.pattern(spark, "^$"), ids)) == [(2, "lines")]  # the empty text, and behind the last line feed
    assert rows(search.line_total(m, search.pattern(spark, "Обнов"), ids)) == [(1, "lines")]
    assert rows(search.first_lines(m, search.exact("обн"), ids, 1, category="К"))[0][:3] == ("d01", 1, 2)
    assert search.first_lines(m, search.exact("обн"), ids, category="Нет").count() == 0
    assert rows(search.line_total(m.limit(0), search.exact("a"), ids)) == [(0, "lines")]
    long = module(spark, "x" * 1_000_000 + "\n" + "y" * 1_000_000)
    assert rows(search.line_total(long, search.exact("Y"), ids)) == [(1, "lines")]


def test_smart_lines(spark):
    m = module(spark, "procedure\nx процедура возврат\nвозврат", "function х()", "процедура.возврат()", "other")
    got = {r[0]: r[2:] for r in rows(search.smart_hits(m, "Процедура Процедура возврат", ["file_id"]))}
    assert {k: (v[0], v[2]) for k, v in got.items()} == {1: (2, 2), 3: (1, 1)}
    found = {r[0]: r for r in rows(search.smart_hits(m, "функция", ["file_id"]))}
    assert found[2][2:] == (1, "function х()", 1) and set(found) == {2}
    assert rows(search.smart_hits(module(spark, "a_b, c"), "c.", ["file_id"]))[0][2:] == (0, "", 0)
    assert rows(search.smart_total(m, "процедура", ["file_id"])) == [(2, "modules")]


def test_ties_come_by_id(spark):
    m = module(spark, *["one and the same"] * 12)
    assert [r[0] for r in rows(search.smart_hits(m, "same", ["file_id"], 5))] == [1, 2, 3, 4, 5]


def test_postings(spark):
    df = spark.createDataFrame([(1, "Если если x"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(rows(search.postings(df, "doc_id", "text", catalog.SYNONYMS))) == [("if", 1, 2), ("x", 1, 1), ("если", 1, 2)]


@pytest.mark.parametrize("pattern", ["(a)\\1", "(?=a)", "(?<!a)b", "a++", "[a", "(?>a)", "a\\", "(", "(?U)a"])
def test_refused_patterns(spark, pattern):
    with pytest.raises(text.PatternError):
        text.checked_pattern(spark, pattern)


def test_patterns_agree_with_re2(spark):
    duckdb = pytest.importorskip("duckdb")
    lines = ["foo", "foo\r", "ПРОЦ", "проц", "дом", "end x", "a]b", "a&&b", "x{1", "12 aa", "", "a.b", "été", "\t", "ß", "_x1"]
    patterns = ["foo$", "foo.$", "(?i)проц", r"\bдом\b", r"\bend\b", r"\w+", r"^\W*$", "[]a]", "[a&&b]{2}", "x{1", "x{,1}", r"\d{2,}", "[[:alpha:]]+", "[^[:space:]]", r"\Qa.b\E", "(?P<n>a)b*?", r"\pL\d", "(?s).", "a|", r"[\w&]+$", r"\s", "a{0,2}"]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    con = duckdb.connect()
    for p in patterns:
        got = [r[0] for r in df.select(F.col("x").rlike(text.checked_pattern(spark, p))).collect()]
        assert got == [con.execute("select regexp_matches(?, ?)", [x, p]).fetchone()[0] for x in lines], p


def test_catalog(spark):
    assert len(catalog.FUNCTIONS) == 180 and len(catalog.SYNONYMS) == 454
    assert all(catalog.SYNONYMS[b] == a for a, b in catalog.SYNONYMS.items())
    assert catalog.SYNONYMS["стрнайти"] == "strfind" and catalog.SYNONYMS["procedure"] == "процедура"
    assert catalog.function_help(spark, "").count() == 180 and catalog.function_help(spark, "strfind").first().name_ru == "СтрНайти" and catalog.function_help(spark, "нет такой").count() == 0


def test_scalars(spark):
    one = spark.createDataFrame([("1.10", "1.9", "a|b", "x`y``z\n", "https://u:p:q@host/a?b=1#c")], "a string, b string, c string, d string, e string")
    r = one.select(text.newer_version(F.col("a"), F.col("b")), text.newer_version(F.col("b"), F.lit("1.9.0")), text.escape_pipe(F.col("c")), text.inline_code(F.col("d")), text.url_without_credentials(F.col("e")), text.url_without_credentials(F.lit("http://h/x"))).first()
    assert tuple(r[:4]) == (1, 0, "a\\|b", "```x`y``z�```") and tuple(r[4]) == ("u", "p:q", "https://host/a") and tuple(r[5]) == (None, None, "http://h/x")
    bad = spark.createDataFrame([('{"k": 1}',), ('{"k": "x"}',), ("{",), (None,)], "j string").select(text.json_record(F.col("j"), "k int").alias("r")).select("r.value.k", "r.mismatch").collect()
    assert [tuple(r) for r in bad] == [(1, None), (None, '{"k": "x"}'), (None, "{"), (None, None)]
    assert [keys.shard_count(n, 8) for n in (0, 4100, 10**9)] == [1, 2, 8]
    assert [text.clamp_limit(v, 50, 500) for v in (None, 0, -1, 7, 900)] == [50, 50, 50, 7, 500]
    assert re.findall(r"\w+", "a_b ё") == text.query_words("A_b Ё")
