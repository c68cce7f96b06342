"""Words, lines and patterns of texts, as expressions of built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters, digits and underscores.
WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """The words of a text in lower case; null of null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def query_words(query: str) -> list[str]:
    """The words of a query, as those of a text."""
    return [w for w in re.findall(r"\w+", query.lower())]


def blank_parted(query: str) -> list[str]:
    """The parts of a query between white space, in lower case; repeated ones stay."""
    return query.lower().split()


def lines(text: Column) -> Column:
    """The parts between line feeds; a last empty one and carriage returns stay."""
    return F.split(text, "\n", -1)


def context(all_lines: Column, line_no: Column, around: int = 2) -> Column:
    """A line with ``around`` lines on either side; lines count from 1."""
    first = F.greatest(line_no - around, F.lit(1))
    return F.array_join(F.slice(all_lines, first, line_no + around - first + 1), "\n")


class PatternError(ValueError):
    """A pattern that RE2 doesn't have."""


_BOUND = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
_NO_BOUND = r"(?:(?<![0-9A-Za-z_])(?![0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_]))"
# Classes that cover ASCII alone.
_ASCII = {"d": "0-9", "w": "0-9A-Za-z_", "s": r"\t\n\f\r "}


def re2_pattern(pattern: str) -> str:
    """A Java pattern that finds what RE2 finds for ``pattern``.

    Refused are back-references, looking around, atomic groups and possessive
    quantifiers, as RE2 refuses them, and what Java can't compile.
    """
    out, i, in_class, quantified = ["(?d)"], 0, False, False
    while i < len(pattern):
        c, pair = pattern[i], pattern[i : i + 2]
        was_quantified, quantified = quantified, False
        if c == "\\":
            if len(pair) < 2:
                raise PatternError("a backslash at the end")
            kind = pair[1]
            if kind.isdigit() and kind != "0" or kind in "kGZ":
                raise PatternError(f"{pair} is not supported")
            if kind == "Q":
                end = pattern.find("\\E", i)
                literal = pattern[i + 2 : end if end >= 0 else len(pattern)]
                out.append(re.escape(literal))
                i = end + 2 if end >= 0 else len(pattern)
                continue
            if kind in "bB" and not in_class:
                out.append(_BOUND if kind == "b" else _NO_BOUND)
            elif kind.lower() in _ASCII:
                inner = _ASCII[kind.lower()]
                if in_class:
                    out.append(inner if kind.islower() else pair)
                else:
                    out.append(f"[{'^' if kind.isupper() else ''}{inner}]")
            else:
                braced = re.match(r"\\[xpP]\{[^}]*\}", pattern[i:])
                out.append(braced[0] if braced else pair)
                i += len(out[-1])
                continue
            i += 2
            continue
        if in_class:
            if pattern.startswith("[:", i) and ":]" in pattern[i:]:
                name = pattern[i + 2 : pattern.index(":]", i)]
                out.append(("\\P" if name.startswith("^") else "\\p") + "{" + {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct", "xdigit": "XDigit"}.get(name.lstrip("^"), "?") + "}")
                i = pattern.index(":]", i) + 2
                continue
            in_class = c != "]"
            out.append("\\" + c if c in "[&" else c)  # Java nests and intersects classes, RE2 doesn't
        elif c == "[":
            in_class = True
            out.append(c)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i : i + 1] == "]":
                out.append("\\]")
                i += 1
            continue
        elif pair == "(?":
            m = re.match(r"\(\?(?:P?<[A-Za-z_]\w*>|([imsU]*)(?:-([imsU]+))?([:)]))", pattern[i:])
            if not m:
                raise PatternError(f"{pattern[i : i + 4]} is not supported")
            if m[3]:
                if "U" in (m[1] + (m[2] or "")):
                    raise PatternError("the flag U is not supported")
                on, off = m[1].replace("i", "iu"), (m[2] or "").replace("i", "iu")
                out.append("(?" + on + (f"-{off}" if off else "") + m[3])
            else:
                out.append("(")  # what a group is called decides nothing here
            i += m.end()
            continue
        elif c in "*+?":
            if was_quantified and c == "+":
                raise PatternError("possessive quantifiers are not supported")
            quantified = not (was_quantified and c == "?")
            out.append(c)
        elif c == "}" or c == "{":
            m = re.match(r"\{\d+(?:,\d*)?\}", pattern[i:])
            if m:
                out.append(m[0])
                quantified = True
                i += m.end()
                continue
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    if in_class:
        raise PatternError("a class without end")
    return "".join(out)


def checked_pattern(spark, pattern: str) -> str:
    """``re2_pattern``, compiled once so that a bad one is an error at once."""
    java = re2_pattern(pattern)
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except Exception as error:
        raise PatternError(f"not a pattern: {pattern}") from error
    return java


def clamp_limit(value: int | None, default: int, most: int) -> int:
    """A limit within bounds; none or a non-positive one is the default."""
    return default if not value or value <= 0 else min(value, most)


def version_parts(version: Column) -> Column:
    """The numbers of a dotted version; arrays of them compare as versions do. What is no number is 0."""
    return F.transform(F.split(version, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def newer_version(a: Column, b: Column) -> Column:
    """1, 0 or -1: whether ``a`` is after, equal to or before ``b``; missing parts are 0."""
    pad = lambda x, n: F.concat(x, F.array_repeat(F.lit(0), n - F.size(x)))
    x, y = version_parts(a), version_parts(b)
    size = F.greatest(F.size(x), F.size(y))
    x, y = pad(x, size), pad(y, size)
    return F.when(x > y, 1).when(x < y, -1).otherwise(0)


def json_record(text: Column, schema: str) -> Column:
    """(value, mismatch) of JSON text: its record by a schema, and the text itself where it doesn't fit."""
    read = F.from_json(text, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return F.struct(read.dropFields("_corrupt_record").alias("value"), read["_corrupt_record"].alias("mismatch"))


def escape_pipe(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def inline_code(text: Column) -> Column:
    """Text as code within a line: line breaks become U+FFFD, and the fence is longer than any run of backticks."""
    plain = F.regexp_replace(text, r"\r\n|[\n\r\x{0085}\x{2028}\x{2029}\x0B\f]", "�")
    runs = F.transform(F.regexp_extract_all(plain, F.lit("`+"), F.lit(0)), F.length)
    fence = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    space = F.when(plain.startswith("`") | plain.endswith("`"), " ").otherwise("")
    return F.concat(fence, space, plain, space, fence)


def url_without_credentials(url: Column) -> Column:
    """(user, password, base) of a URL; base is without credentials, query and fragment."""
    authority = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)@", 1)
    user = F.when(authority == "", None).otherwise(F.substring_index(authority, ":", 1))
    password = F.when(F.instr(authority, ":") > 0, F.substring(authority, F.instr(authority, ":") + 1, F.length(authority)))
    base = F.regexp_replace(F.regexp_replace(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/?#]*@", "$1"), r"[?#].*$", "")
    return F.struct(user.alias("user"), password.alias("password"), base.alias("base"))
