"""Forms in XML files: elements, events, commands and dynamic lists.

A file is read into a plain tree as far as it goes; what can't be read further
leaves the tree as it is then, and a flag. The tree is then read by rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.kinds import KINDS, looked_up

MOST_BYTES = 16 << 20

# Tags that are elements of a form, with their Russian names where they have one.
ELEMENTS = {
    "InputField": "ПолеВвода", "LabelField": "ПолеНадписи", "CheckBoxField": "ФлажокПоле", "RadioButtonField": "ПолеПереключателя", "NumberField": "ПолеЧисла",
    "TextDocumentField": "ПолеТекстовогоДокумента", "SpreadsheetDocumentField": "ПолеТабличногоДокумента", "PictureField": "ПолеКартинки", "Table": "ТаблицаФормы", "FormattedDocumentField": None,
    "PlannerField": None, "DendrogramField": None, "ChartField": None, "GanttChartField": None, "PeriodField": None, "ProgressBarField": None, "TrackBarField": None, "CalendarField": None,
    "HTMLDocumentField": None, "Button": "Кнопка", "ButtonGroup": "ГруппаКнопок", "UsualGroup": "ОбычнаяГруппа", "Pages": "Страницы", "Page": "Страница", "CommandBar": "КоманднаяПанель", "Popup": None,
    "ColumnGroup": None, "LabelDecoration": "ДекорацияНадпись", "PictureDecoration": "ДекорацияКартинка", "Hyperlink": "Гиперссылка", "Addition": None,
}
SERVICE = ("ContextMenu", "ExtendedTooltip", "ShortTooltip", "SearchStringAddition", "ViewStatusAddition", "SearchControlAddition")
TRANSPARENT = ("AutoCommandBar",)
_TYPE = "http://www.w3.org/2001/XMLSchema-instance"


def display_type(tag: Column) -> Column:
    """What an element's type is called; unknown ones are called as they are."""
    return F.coalesce(looked_up({k: v for k, v in ELEMENTS.items() if v}, tag), tag)


@dataclass
class Node:
    """An element of a file: local name, namespaces in force, attributes, own text, children."""

    prefix: str = ""
    name: str = ""
    attributes: dict[str, str] = field(default_factory=dict)
    spaces: dict[str, str] = field(default_factory=dict)
    text: str = ""
    children: list[Node] = field(default_factory=list)

    def all(self, name: str) -> list[Node]:
        return [c for c in self.children if c.name == name]

    def first(self, name: str) -> Node | None:
        return next(iter(self.all(name)), None)

    def has(self, name: str) -> str:
        """The text of a child."""
        child = self.first(name)
        return child.text if child else ""

    @property
    def space(self) -> str:
        return self.spaces.get(self.prefix, "")

    def walk(self) -> Iterator[Node]:
        waiting = [self]
        while waiting:
            node = waiting.pop()
            yield node
            waiting.extend(reversed(node.children))


_HEAD = re.compile(r"﻿?(?:<\?xml\s[^>]*?\?>)?")


def tree(text: str, deepest: int | None = None) -> tuple[Node, bool, int]:
    """(a node above all roots, whether the text was read to its end, its depth); ends early below ``deepest``."""
    top = Node()
    held, depth = [top], 0

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal depth
        prefix, _, local = name.rpartition(":")
        spaces = held[-1].spaces
        own = {k[6:] if k != "xmlns" else "": v for k, v in attributes.items() if k == "xmlns" or k.startswith("xmlns:")}
        node = Node(prefix, local, attributes, spaces | own if own else spaces)
        held[-1].children.append(node)
        held.append(node)
        depth = max(depth, len(held) - 1)
        if deepest is not None and depth > deepest:
            raise RecursionError

    def text_found(data: str) -> None:
        held[-1].text += data

    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True

    def rooted(name: str, attributes: dict[str, str]) -> None:  # the wrapping around any number of roots
        parser.StartElementHandler = start

    parser.StartElementHandler, parser.CharacterDataHandler = rooted, text_found
    parser.EndElementHandler = lambda _: held.pop() if len(held) > 1 else None
    try:
        parser.Parse(f"<around.all>{_HEAD.sub('', text, count=1)}</around.all>".encode(), True)
    except (expat.ExpatError, RecursionError):
        return top, False, depth
    return top, True, depth


def localized(node: Node | None, language: str | None = None) -> str:
    """The text of the first item that isn't empty, one in ``language`` before others."""
    items = [] if node is None else [(i.has("lang"), i.has("content")) for i in node.all("item")]
    return next((c for lang, c in items if c and lang == language), next((c for _, c in items if c), ""))


def _events(node: Node | None) -> list[dict]:
    return [] if node is None else [{"event": e.attributes.get("name", ""), "handler": e.text.strip()} for e in node.all("Event")]


def _elements(section: Node) -> list[dict]:
    """Elements of a section, each before those in it; containers nobody sees are passed through."""
    out: list[dict] = []
    waiting = list(reversed(section.children))
    while waiting:
        node = waiting.pop()
        if node.name in TRANSPARENT:
            inner = [c for s in node.all("ChildItems") for c in s.children]
        elif node.name in ELEMENTS:
            out.append({"name": node.attributes.get("name", ""), "type": node.name, "title": localized(node.first("Title")), "data_path": node.has("DataPath").strip(), "events": _events(node.first("Events"))})
            inner = [c for s in node.children if s.name == "ChildItems" for c in s.children] + [c for s in node.children if s.name in TRANSPARENT for i in s.all("ChildItems") for c in i.children]
        else:
            continue
        waiting.extend(reversed(inner))
    return out


def _is_dynamic_list(settings: Node) -> bool:
    """Whether the type of a Settings element is DynamicList in the namespace of the element itself."""
    typed = next((v for k, v in settings.attributes.items() if ":" in k and k.rpartition(":")[2] == "type" and settings.spaces.get(k.rpartition(":")[0]) == _TYPE), None)
    if typed is None:
        return False
    prefix, _, local = typed.rpartition(":")
    return local == "DynamicList" and (not prefix or prefix in settings.spaces) and settings.spaces.get(prefix, "") == settings.space


def read_form(text: str) -> dict:
    """A form as far as its file can be read."""
    top, whole, _ = tree(text)
    form = next((n for n in top.walk() if n.name == "Form"), None)
    out = {"title": "", "elements": [], "handlers": [], "commands": [], "dynamic_lists": [], "parse_incomplete": not whole, "no_form_root": whole and form is None}
    if form is None:
        return out
    out["title"] = localized(form.first("Title"))
    out["handlers"] = _events(form.first("Events"))
    for child in form.children:
        if child.name == "ChildItems":
            out["elements"] += _elements(child)
        elif child.name in ELEMENTS:
            out["elements"] += _elements(Node(children=[child]))
        elif child.name == "Commands":
            out["commands"] += [{"name": c.attributes.get("name", ""), "action": c.has("Action").strip()} for c in child.all("Command")]
        elif child.name == "Attributes":
            for attribute in child.all("Attribute"):
                for settings in attribute.all("Settings"):
                    if _is_dynamic_list(settings):
                        out["dynamic_lists"].append({"name": attribute.attributes.get("name", ""), "manual_query": settings.has("ManualQuery").strip() == "true", "main_table": settings.has("MainTable").strip(), "query_text": settings.has("QueryText")})
    return out


_EVENT = "array<struct<event:string,handler:string>>"
SCHEMA = f"path string, title string, elements array<struct<name:string,type:string,title:string,data_path:string,events:{_EVENT}>>, handlers {_EVENT}, commands array<struct<name:string,action:string>>, dynamic_lists array<struct<name:string,manual_query:boolean,main_table:string,query_text:string>>, parse_incomplete boolean, no_form_root boolean"
_PAIRS = pa.list_(pa.struct([("event", pa.string()), ("handler", pa.string())]))
_ARROW = pa.schema(
    [
        ("path", pa.string()), ("title", pa.string()), ("elements", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("title", pa.string()), ("data_path", pa.string()), ("events", _PAIRS)]))), ("handlers", _PAIRS),
        ("commands", pa.list_(pa.struct([("name", pa.string()), ("action", pa.string())]))),
        ("dynamic_lists", pa.list_(pa.struct([("name", pa.string()), ("manual_query", pa.bool_()), ("main_table", pa.string()), ("query_text", pa.string())]))), ("parse_incomplete", pa.bool_()), ("no_form_root", pa.bool_()),
    ]
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            content = batch.column(1)[at].as_py()
            text = content.decode("utf-8", "replace") if isinstance(content, bytes) else content
            row = {"path": batch.column(0)[at].as_py()} | read_form(text)
            yield pa.RecordBatch.from_pylist([row], schema=_ARROW)


def parsed(files: DataFrame) -> DataFrame:
    """Forms of ``files`` (path, content): nested columns, and flags of files that end early or are no form.

    Defined results: null contents and files above 16 MiB give no row.
    """
    size = F.length("content") if dict(files.dtypes)["content"] == "binary" else F.octet_length("content")
    return files.where("content is not null").where(size <= MOST_BYTES).select("path", "content").mapInArrow(_read, SCHEMA)


_FOLDER = {one: folder for one, folder, _ in KINDS}


def form_path(path: Column) -> Column:
    """(folder, object_name, form_name) of a form's file; nulls for others. A common form has its own name for both."""
    of_object = r"(?:^|/)([^/]+)/([^/]+)/Forms/([^/]+)/Ext/Form\.xml$"
    common = r"(?:^|/)(CommonForms)/([^/]+)/Ext/Form\.xml$"
    get = lambda p, i: F.nullif(F.regexp_extract(path, p, i), F.lit(""))
    return F.struct(F.coalesce(get(of_object, 1), get(common, 1)).alias("folder"), F.coalesce(get(of_object, 2), get(common, 2)).alias("object_name"), F.coalesce(get(of_object, 3), get(common, 2)).alias("form_name"))


def form_files(spark, root: str, object_type: str, object_name: str) -> DataFrame:
    """(path, form_name, content) of an object's form files; of none where the object has no forms.

    Names that lead elsewhere and unknown types are refused.
    """
    if not object_name or "\x00" in object_name or object_name in (".", "..") or re.search(r"[/\\]|\.\.", object_name):
        raise ValueError("not a name of an object")
    if object_type == "CommonForm":
        folder = f"{root}/CommonForms/{object_name}/Ext"
    elif object_type in _FOLDER:
        folder = f"{root}/{_FOLDER[object_type]}/{object_name}/Forms"
    else:
        raise ValueError(f"unknown type {object_type}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "path string, form_name string, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "Form.xml").load(folder)
    return files.select("path", form_path(F.col("path"))["form_name"].alias("form_name"), "content").where("form_name is not null")


# Properties that name an object's main form, in the order they are asked, and events of a form asked of the live side.
MAIN_FORMS = ("ОсновнаяФормаОбъекта", "ОсновнаяФормаСписка", "ОсновнаяФормаВыбора", "ОсновнаяФорма")
LIVE_EVENTS = ("ПриОткрытии", "ПриСозданииНаСервере", "ПередЗаписью", "ПриЗаписиНаСервере", "ПослеЗаписиНаСервере", "ПередЗакрытием", "ОбработкаОповещения", "ОбработкаНавигационнойСсылки", "ОбработкаВыбора")


def main_form(properties: Column, forms: Column) -> Column:
    """The form that an object's properties (a map) name as its main one, else the first of its forms, else null."""
    named = [F.try_element_at(properties, F.lit(p)) for p in MAIN_FORMS]
    return F.coalesce(*named, F.get(forms, F.lit(0)))


def live_handlers(properties: Column) -> Column:
    """(event, handler) of those events that a form's properties (a map) have a handler for."""
    every = F.transform(F.array(*map(F.lit, LIVE_EVENTS)), lambda e: F.struct(e.alias("event"), F.try_element_at(properties, e).alias("handler")))
    return F.filter(every, lambda h: F.trim(h["handler"]) != "")


COLLECTIONS = ("elements", "handlers", "commands", "dynamic_lists")


def merged(live: DataFrame, dump: DataFrame, on: list[str]) -> DataFrame:
    """Forms of two sources: of a form with another name the dump's, where it has anything, goes as a whole.

    Else each collection is the dump's unless it is empty or missing there.
    ``live`` and ``dump`` have ``on``, name and the collections.
    """
    a = live.select(*on, *[F.col(c).alias(f"__l_{c}") for c in ("name", *COLLECTIONS)])
    b = dump.select(*on, *[F.col(c).alias(f"__d_{c}") for c in ("name", *COLLECTIONS)], F.lit(True).alias("__there"))
    filled = lambda c: F.coalesce(F.size(F.col(f"__d_{c}")) > 0, F.lit(False))
    any_filled = filled(COLLECTIONS[0])
    for c in COLLECTIONS[1:]:
        any_filled = any_filled | filled(c)
    whole = any_filled & ~F.col("__l_name").eqNullSafe(F.col("__d_name"))
    pick = lambda c: F.when(whole | filled(c), F.col(f"__d_{c}")).otherwise(F.col(f"__l_{c}")).alias(c)
    name = F.when(whole | F.col("__l_name").isNull(), F.col("__d_name")).otherwise(F.col("__l_name")).alias("name")
    return a.join(b, on, "full").select(*on, name, *[pick(c) for c in COLLECTIONS])
