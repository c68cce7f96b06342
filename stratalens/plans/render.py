"""Results as Markdown text, for at most as many rows as a tool shows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 1000


def cell(value: Column) -> Column:
    """A number as a table shows it: whole ones without decimals, null as nothing."""
    whole = F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string"))
    return F.coalesce(whole, value.cast("string"), F.lit(""))


def cell_text(value) -> str:
    """The same of any value, with pipes escaped and breaks as spaces."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    if isinstance(value, (list, tuple)):
        return ", ".join(cell_text(v) for v in value)
    return re.sub(r"[\r\n]+", " ", str(value)).replace("|", "\\|")


def fenced(text: str) -> str:
    """Text in a fence longer than any run of backticks in it."""
    longest = max((len(r) for r in re.findall(r"`+", text)), default=0)
    fence = "`" * max(3, longest + 1)
    return f"{fence}\n{text}\n{fence}"


def inline(text: str) -> str:
    """Text as code in a line; breaks become U+FFFD."""
    plain = re.sub(r"\r\n|[\n\r\v\f\x85  ]", "�", text)
    longest = max((len(r) for r in re.findall(r"`+", plain)), default=0)
    space = " " if plain.startswith("`") or plain.endswith("`") else ""
    return "`" * (longest + 1) + space + plain + space + "`" * (longest + 1)


def table(df: DataFrame, title: str, limit: int = MOST_ROWS) -> str:
    """The first rows as a table."""
    rows = df.limit(min(limit, MOST_ROWS)).collect()
    if not rows:
        return f"## {title}\n\nNo rows.\n"
    out = [f"## {title} ({len(rows)})", "", "| " + " | ".join(map(cell_text, df.columns)) + " |", "|" + " --- |" * len(df.columns)]
    out += ["| " + " | ".join(cell_text(v) for v in row) + " |" for row in rows]
    return "\n".join(out) + "\n"


def hits(df: DataFrame, total: int, unit: str, shown: Callable[[str], str] = str) -> str:
    """Search hits with their contexts; ``shown`` turns a module's key into what is displayed."""
    out = [f"# {total} {unit}"]
    for row in df.limit(MOST_ROWS).collect():
        at = row.asDict()
        out.append(f"## {shown(at['doc_id'])}" + (f":{line}" if (line := at.get("line_no") or at.get("line")) and isinstance(line, int) else ""))
        if at.get("context"):
            out.append(fenced(at["context"]))
    return "\n\n".join(out) + "\n"


def tree(nodes: DataFrame) -> str:
    """Subsystems, each below its parent and by name at every level."""
    paths = sorted((r.path.split(".")[1:] for r in nodes.select("path").distinct().limit(MOST_ROWS).collect()))
    return "".join(f"{'  ' * (len(p) - 1)}- {p[-1]}\n" for p in paths if p)


def counted_list(df: DataFrame, title: str, column: str) -> str:
    """One item a line, under their number."""
    items = [r[0] for r in df.select(column).orderBy(column).limit(MOST_ROWS).collect()]
    return f"# {title} ({len(items)})\n\n" + "".join(f"- {inline(str(i))}\n" for i in items)


def type_text(types: Column) -> Column:
    """Alternative types as one text."""
    return F.array_join(types, ", ")
