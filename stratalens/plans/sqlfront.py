"""Read-only queries in Russian or English keywords, with named parameters, on Spark SQL.

The text is cut into tokens, so that words in quotes, comments and names behind
a dot are never touched. What is run must parse as a query: commands can't.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions.text import clamp_limit

DEFAULT_LIMIT, MOST_LIMIT = 100, 1000

# Keywords of queries. Some words mean something else in modules.
_PHRASES = {
    "сгруппировать по": "group by", "упорядочить по": "order by", "внутреннее соединение": "inner join", "левое соединение": "left join", "правое соединение": "right join",
    "полное соединение": "full join", "левое внешнее соединение": "left join", "правое внешнее соединение": "right join", "полное внешнее соединение": "full join", "объединить все": "union all", "есть null": "is null",
    "есть не null": "is not null", "не есть null": "is not null", "выбрать различные": "select distinct",
}
_WORDS = {
    "выбрать": "select", "различные": "distinct", "из": "from", "где": "where", "как": "as", "соединение": "join", "по": "on", "имеющие": "having", "объединить": "union", "выразить": "cast", "количество": "count",
    "сумма": "sum", "максимум": "max", "минимум": "min", "среднее": "avg", "и": "and", "или": "or", "не": "not", "в": "in", "между": "between", "подобно": "like", "выбор": "case", "когда": "when", "тогда": "then",
    "иначе": "else", "конец": "end", "истина": "true", "ложь": "false", "неопределено": "null", "возр": "asc", "убыв": "desc", "есть": "is", "естьnull": "coalesce", "isnull": "coalesce", "дата": "date", "число": "double",
    "строка": "string", "булево": "boolean", "год": "year", "месяц": "month", "день": "day", "подстрока": "substring",
}
_TOKEN = re.compile(r"""(?P<text>"(?:[^"]|"")*"|'(?:[^'\\]|\\.|'')*'|`[^`]*`)|(?P<remark>//[^\n]*|--[^\n]*|/\*.*?\*/)|(?P<param>&[^\W\d]\w*)|(?P<word>[^\W\d]\w*)|(?P<blank>\s+)|(?P<sign>.)""", re.S)


class QueryError(ValueError):
    """The text is no query that may be run."""


def _tokens(text: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m.group()) for m in _TOKEN.finditer(text)]


def _value(found: str, values: dict[str, str]) -> str:
    """A predefined value, by its name without white space."""
    name = re.sub(r"\s", "", found)
    if name not in values:
        raise QueryError(f"no predefined value {name}")
    return "'" + values[name].replace("'", "\\'") + "'"


def _name(word: str) -> str:
    """A name as Spark takes it: quoted where it isn't ASCII."""
    return word if word.isascii() else f"`{word}`"


def _parameter_name(name: str) -> str:
    """A parameter's name in ASCII."""
    return name if name.isascii() else "p_" + name.encode().hex()


def translate(text: str, tables: dict[str, str] | None = None, values: dict[str, str] | None = None) -> str:
    """Spark SQL of one query.

    ``tables`` names the views of dotted tables (``Справочник.X``), ``values``
    the predefined ones of VALUE(...). &Name becomes :Name, TOP n a LIMIT.
    """
    tables, values = {k.lower(): v for k, v in (tables or {}).items()}, values or {}
    tokens = [("blank", " ") if k == "remark" else (k, t) for k, t in _tokens(text)]
    out: list[str] = []
    limits: list[str | None] = [None]
    i = 0
    while i < len(tokens):
        kind, found = tokens[i]
        low = found.lower()
        if kind == "param":
            out.append(":" + _parameter_name(found[1:]))
        elif kind == "text" and found[0] == '"':
            out.append("'" + found[1:-1].replace('""', '"').replace("\\", "\\\\").replace("'", "\\'") + "'")
        elif kind == "sign" and found == "(":
            limits.append(None)
            out.append(found)
        elif kind == "sign" and found == ")":
            if len(limits) > 1 and (limit := limits.pop()):
                out.append(f" limit {limit}")
            out.append(found)
        elif kind != "word" or out and (out[-1] == "." or next((o for o in reversed(out) if o.strip()), "") == "as"):
            out.append(_name(found) if kind == "word" else found)
        else:
            dotted, j = [found], i + 1
            while j + 1 < len(tokens) and tokens[j][1] == "." and tokens[j + 1][0] == "word":
                dotted.append(tokens[j + 1][1])
                j += 2
            name = ".".join(dotted)
            if len(dotted) > 1:
                if name.lower() in tables:
                    out.append(tables[name.lower()])
                else:  # a column of a table or a part of it
                    out.append(".".join(map(_name, dotted)))
                i = j
                continue
            words, k = [low], i + 1
            phrase = None
            while k < len(tokens) and len(words) < 3:  # the longest phrase
                if tokens[k][0] == "blank":
                    k += 1
                    continue
                if tokens[k][0] != "word":
                    break
                words.append(tokens[k][1].lower())
                k += 1
                if " ".join(words) in _PHRASES:
                    phrase = (" ".join(words), k)
            if phrase:
                out.append(_PHRASES[phrase[0]])
                i = phrase[1]
                continue
            rest = [t for t in tokens[i + 1 :] if t[0] != "blank"]
            if low in ("первые", "top") and rest and rest[0][1].isdigit():
                digits = ""
                i += 1
                while tokens[i][0] == "blank" or tokens[i][1].isdigit():
                    digits += tokens[i][1].strip()
                    i += 1
                    if tokens[i][0] == "blank" and digits:
                        break
                limits[-1] = digits
                continue
            if low in ("значение", "value") and rest and rest[0][1] == "(":
                end = next((n for n in range(i, len(tokens)) if tokens[n][1] == ")"), None)
                if end is None:
                    raise QueryError("VALUE without end")
                start = next(n for n in range(i, end) if tokens[n][1] == "(")
                out.append(_value("".join(t for _, t in tokens[start + 1 : end]), values))
                i = end + 1
                continue
            if name.lower() in tables:
                out.append(tables[name.lower()])
            else:
                out.append(_WORDS.get(low) or _name(found))
        i += 1
    if limits[0]:
        out.append(f" limit {limits[0]}")
    return "".join(out).strip()


def batch(text: str) -> list[str]:
    """The queries of a text, parted by semicolons outside quotes and comments."""
    parts: list[list[str]] = [[]]
    for kind, found in _tokens(text):
        if kind == "sign" and found == ";":
            parts.append([])
        else:
            parts[-1].append(found)
    return [p for p in ("".join(x).strip() for x in parts) if p]


def begins_as_query(text: str) -> bool:
    """Whether the first word is SELECT or ВЫБРАТЬ; a longer word that begins so is not."""
    return re.match(r"(?:select|выбрать)(?!\w)", text.strip(), re.I) is not None


#: Functions that run code of their own, which no query needs.
_CODE = {"reflect", "try_reflect", "java_method", "ai_query"}


def parameter(value):
    """A parameter's value: ISO text becomes a moment, everything else stays."""
    if isinstance(value, str) and re.fullmatch(r"\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d:\d\d)?", value):
        try:
            return dt.datetime.fromisoformat(value)
        except ValueError:
            return value
    return value


def _analysed(spark: SparkSession, text: str, args: dict) -> DataFrame:
    """The query, parsed as a query first: SELECT * FROM (text) can't hold a command."""
    spark.sql(f"select * from (\n{text}\n) limit 0", args=args)
    return spark.sql(text, args=args)


def prepared(spark: SparkSession, text: str, parameters: dict | None = None, tables: dict[str, str] | None = None, values: dict[str, str] | None = None) -> DataFrame:
    """The query's result, whole; errors of the text or of names are QueryError."""
    if not begins_as_query(text):
        raise QueryError("a query begins with SELECT or ВЫБРАТЬ")
    if called := _CODE & {t.lower().strip("`") for k, t in _tokens(text) if k in ("word", "text")}:
        raise QueryError(f"{called.pop()} is not allowed")
    args = {_parameter_name(k): parameter(v) for k, v in (parameters or {}).items()}
    try:
        return _analysed(spark, translate(text, tables, values), args)
    except (ParseException, AnalysisException) as error:
        raise QueryError(str(error).split("\n")[0]) from error


@dataclass
class Result:
    """At most ``limit`` rows; ``total`` is how many came, ``truncated`` whether there were more."""

    columns: list[str]
    rows: list[tuple]
    total: int
    truncated: bool


def execute(spark: SparkSession, text: str, limit: int | None = None, parameters: dict | None = None, tables: dict[str, str] | None = None, values: dict[str, str] | None = None) -> Result:
    """Run a query; only its first rows come to the driver."""
    most = clamp_limit(limit, DEFAULT_LIMIT, MOST_LIMIT)
    df = prepared(spark, text, parameters, tables, values)
    found = [tuple(r) for r in df.limit(most + 1).collect()]
    return Result(df.columns, found[:most], min(len(found), most), len(found) > most)


def truncated(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows, each with whether there were more."""
    ahead = df.orderBy(*order).limit(limit + 1)
    more = ahead.agg(F.count("*") > limit)
    return ahead.orderBy(*order).limit(limit).withColumn("truncated", more.scalar())


def validate(spark: SparkSession, text: str, parameters: dict | None = None, tables: dict[str, str] | None = None, values: dict[str, str] | None = None) -> tuple[bool, list[str]]:
    """(valid, errors) of a query that isn't run; parameters without value are null."""
    names = {t[1:]: None for k, t in _tokens(text) if k == "param"}
    try:
        prepared(spark, text, names | (parameters or {}), tables, values)
    except QueryError as error:
        return False, [str(error)]
    return True, []
