"""Problem 4: nested form payloads as linked flat tables.

The payloads of an Arrow batch are indexed together (``functions.jsonindex``).
One pass per nesting level then gives each value its part: form, element, event,
command or dynamic list. Rows keep the path of their element, the path of its
parent and their position.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions import jsonindex

#: Keys that are read; each may begin with a capital.
KEYS = ("name", "title", "type", "dataPath", "event", "handler", "action", "mainTable", "manualQuery", "parseIncomplete", "noFormRoot", "elements", "childItems", "events", "handlers", "commands", "dynamicLists")
_NAMES = [*KEYS, *(k[0].upper() + k[1:] for k in KEYS)]
_ROLE = {k: n for n, k in enumerate(KEYS)}

#: Parts of a form. A list's state is that of its entries plus _LIST.
FORM, ELEMENT, EVENT, COMMAND, DYNAMIC_LIST = range(1, 6)
_LIST = 10
_RECORDS = {"form": FORM, "element": ELEMENT, "event": EVENT, "command": COMMAND, "dynamic_list": DYNAMIC_LIST}
_COLLECTIONS = ((FORM, "elements", ELEMENT), (ELEMENT, "childItems", ELEMENT), (ELEMENT, "events", EVENT), (FORM, "handlers", EVENT), (FORM, "commands", COMMAND), (FORM, "dynamicLists", DYNAMIC_LIST))

_TEXTS = ("name", "title", "type", "dataPath", "event", "handler", "action", "mainTable", "manualQuery")
#: The texts that a record has.
_OF = {"form": ("name", "title"), "element": ("name", "title", "type", "dataPath"), "event": ("event", "handler"), "command": ("name", "title", "action"), "dynamic_list": ("name", "title", "mainTable", "manualQuery")}
_SCHEMA = pa.schema(
    [("form_id", pa.int64()), ("record", pa.string()), ("element_path", pa.string()), ("parent_path", pa.string()), ("position", pa.int32()), ("depth", pa.int32())]
    + [(k, pa.string()) for k in ("name", "title", "type", "data_path", "event_name", "handler", "action", "main_table", "manual_query")]
    + [("parse_incomplete", pa.bool_()), ("no_form_root", pa.bool_())]
)
_SPARK_SCHEMA = "form_id bigint, record string, element_path string, parent_path string, position int, depth int, name string, title string, type string, data_path string, event_name string, handler string, action string, main_table string, manual_query string, parse_incomplete boolean, no_form_root boolean"

#: Bytes indexed at once, and rows of an output batch.
_BYTES, _ROWS = 2 << 20, 20_000


def _chosen(nodes: jsonindex.Nodes) -> tuple[np.ndarray, np.ndarray]:
    """The role of each node and whether it is the one its parent's role is read from.

    Of equal keys the last counts; a key with a small first letter goes before
    one with a capital, unless its value is null.
    """
    code = nodes.codes(_NAMES)
    role, capital = np.where(code >= 0, code % len(KEYS), -1), code >= len(KEYS)
    at = np.flatnonzero(role >= 0)
    order = at[np.lexsort((at, capital[at], role[at], nodes.parent[at]))]
    last = np.ones(len(order), bool)
    last[:-1] = (nodes.parent[order[1:]] != nodes.parent[order[:-1]]) | (role[order[1:]] != role[order[:-1]]) | (capital[order[1:]] != capital[order[:-1]])
    order = order[last]
    weight = np.where(capital[order], 1, np.where(nodes.kind[order] == 0x6E, 0, 2))  # n begins null alone
    order = order[np.lexsort((weight, role[order], nodes.parent[order]))]
    last = np.ones(len(order), bool)
    last[:-1] = (nodes.parent[order[1:]] != nodes.parent[order[:-1]]) | (role[order[1:]] != role[order[:-1]])
    chosen = np.zeros(len(role), bool)
    chosen[order[last]] = True
    return role, chosen


def _parts(nodes: jsonindex.Nodes, role: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State, owning form or element, and position of each node, level by level."""
    state, owner, position = np.zeros(len(role), np.int64), np.full(len(role), -1), nodes.position.copy()
    order = np.argsort(nodes.depth, kind="stable")
    borders = np.searchsorted(nodes.depth[order], np.arange(int(nodes.depth.max(initial=-1)) + 2))
    for a, b in zip(borders[:-1], borders[1:]):
        here = order[a:b]
        if a == 0:
            state[here[nodes.kind[here] == 0x7B]] = FORM
            continue
        up = nodes.parent[here]
        above = state[up]
        if not above.any():
            break
        member = (above > _LIST) & (nodes.kind[here] == 0x7B)
        state[here[member]] = above[member] - _LIST
        owner[here[member]] = owner[up[member]]
        for holder, key, entry in _COLLECTIONS:
            found = (above == holder) & (role[here] == _ROLE[key]) & chosen[here]
            many, one = found & (nodes.kind[here] == 0x5B), found & (nodes.kind[here] == 0x7B)
            state[here[many]], state[here[one]] = entry + _LIST, entry
            owner[here[found]] = up[found]
            position[here[one]] = 1
    return state, owner, position


def _paths(state: np.ndarray, owner: np.ndarray, position: np.ndarray) -> tuple[list, np.ndarray]:
    """Path of each form and element, by node, and its depth; owners stand before what they own."""
    path: list = [None] * len(state)
    depth = np.zeros(len(state), np.int32)
    for i in np.flatnonzero((state == FORM) | (state == ELEMENT)).tolist():
        up = owner[i]
        if up < 0:
            path[i] = ""
        else:
            path[i] = f"{path[up]}.{position[i]}" if path[up] else str(position[i])
            depth[i] = depth[up] + 1
    return path, depth


def _records(nodes: jsonindex.Nodes, records: Iterable[str], form_ids: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of the wanted records, as in the schema; ``form_ids`` are those of the texts."""
    role, chosen = _chosen(nodes)
    state, owner, position = _parts(nodes, role, chosen)
    path, depth = _paths(state, owner, position)
    child: dict[str, np.ndarray] = {}
    for record in records:
        own = np.flatnonzero(state == _RECORDS[record])
        if not len(own):
            continue
        mine = own if record in ("form", "element") else owner[own]
        above = owner[mine]

        def values(key: str, own=own) -> pa.Array:
            if key not in child:
                held = np.flatnonzero(chosen & (role == _ROLE[key]))
                child[key] = np.full(len(role), -1)
                child[key][nodes.parent[held]] = held
            return nodes.strings(child[key][own])

        nothing = lambda kind, n=len(own): pa.nulls(n, kind)
        texts = [values(k) if k in _OF[record] else nothing(pa.string()) for k in _TEXTS]
        if record == "event":
            texts[4:6] = [t.fill_null("") for t in texts[4:6]]
        # text that is neither true nor false is no flag
        flags = [pa.array([{"true": True, "false": False}.get(x) for x in values(k).to_pylist()], pa.bool_()) if record == "form" else nothing(pa.bool_()) for k in ("parseIncomplete", "noFormRoot")]
        columns = [
            form_ids.take(pa.array(nodes.text[own])), pa.array([record] * len(own)), pa.array([path[i] for i in mine.tolist()], pa.string()),
            pa.array([None if i < 0 else path[i] for i in above.tolist()], pa.string()), pa.array(np.ones(len(own)) if record == "form" else position[own]).cast(pa.int32()), pa.array(depth[mine]), *texts, *flags,
        ]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _BYTES; a longer text stands alone."""
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > _BYTES:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _reader(records: tuple[str, ...]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(payload.buffers()[1], np.int64)[payload.offset : payload.offset + len(payload) + 1]
            whole = np.frombuffer(payload.buffers()[2] or b"", np.uint8)
            for a, b in _slices(np.diff(offsets)):
                data, starts = whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                marks = [s for s in starts[:-1][np.append(data, 0)[starts[:-1]] == 0xEF].tolist() if data[s : s + 3].tobytes() == b"\xef\xbb\xbf"]
                if marks:
                    data = data.copy()
                    data[(np.array(marks)[:, None] + np.arange(3)).ravel()] = 0x20
                for out in _records(jsonindex.index(data, starts), records, batch.column(0).slice(a, b - a)):
                    for at in range(0, out.num_rows, _ROWS):
                        yield out.slice(at, _ROWS)

    return read


def flatten(form_info: DataFrame, records: tuple[str, ...] = tuple(_RECORDS)) -> DataFrame:
    """All records of each form's latest delivery: form, element, event, command and dynamic_list.

    The path of an event, command or list is that of its element, '' being the
    form. Positions count null entries, which give no row; a bare object has
    position 1.

    Defined results: of equal loaded_at the greater payload holds, null before
    all; a latest payload that is null, empty, no JSON or no object gives no
    rows; rows without form_id are no forms; of repeated keys the last counts,
    and a small first letter goes before a capital unless its value is null; a
    collection that is no list and no object is empty; a missing or null event
    or handler is ''; other missing texts are null; a value that is no string
    comes out as it is written.
    """
    latest = form_info.where("form_id is not null").groupBy("form_id").agg(F.max(F.struct("loaded_at", "payload")).alias("x"))
    return latest.select("form_id", "x.payload").where("payload is not null").mapInArrow(_reader(records), _SPARK_SCHEMA)


def found(form_info: DataFrame) -> DataFrame:
    """p4_found: the events of elements and the handlers of forms."""
    return flatten(form_info, ("event",)).select("form_id", "element_path", F.col("position").alias("event_pos"), "event_name", "handler")


def forms(form_info: DataFrame) -> DataFrame:
    """One row a form."""
    return flatten(form_info, ("form",)).select("form_id", "name", "title", "parse_incomplete", "no_form_root")


def elements(form_info: DataFrame) -> DataFrame:
    """One row an element, linked to the element that holds it by parent_path ('' for the form)."""
    return flatten(form_info, ("element",)).select("form_id", "element_path", "parent_path", "position", "depth", "name", "type", "title", "data_path")


def commands(form_info: DataFrame) -> DataFrame:
    """One row a command or dynamic list of a form."""
    return flatten(form_info, ("command", "dynamic_list")).select("form_id", "record", "position", "name", "title", "action", "main_table", "manual_query")


# --- the same in DuckDB's SQL, value by value


def _get(e: str, key: str) -> str:
    """The value of a key, or of the key with a capital where it is missing or null."""
    other = key[0].upper() + key[1:]
    return f"case when coalesce(json_type({e}, '$.{key}'), 'NULL') != 'NULL' then json_extract({e}, '$.{key}') else json_extract({e}, '$.{other}') end"


def _entries(e: str, key: str) -> str:
    return f"case json_type({_get(e, key)}) when 'ARRAY' then json_extract({_get(e, key)}, '$[*]') when 'OBJECT' then [{_get(e, key)}] else [] end"


def _text(e: str, key: str) -> str:
    value = _get(e, key)
    return f"case json_type({value}) when 'VARCHAR' then {value} ->> '$' when 'NULL' then null else ({value})::varchar end"


def element_type(e: str) -> str:
    """The type of an element."""
    return _text(e, "type")


def sql(last: str) -> str:
    """A query over ``form`` (form_id, e), ``element`` (form_id, path, parent, pos, depth, e) and ``event`` (form_id, path, pos, e)."""
    return f"""
        with recursive latest as (select form_id, payload from form_info where form_id is not null qualify row_number() over (partition by form_id order by loaded_at desc nulls last, payload desc nulls last) = 1),
        form as (select form_id, e from (select form_id, case when json_valid(ltrim(payload, chr(65279))) then ltrim(payload, chr(65279))::json end as e from latest) where json_type(e) = 'OBJECT'),
        step(form_id, path, parent, pos, depth, e, l) as (
            select form_id, '', null::varchar, 1, 0, e, {_entries("e", "elements")} from form
            union all
            select form_id, case when parent_path = '' then '' else parent_path || '.' end || i, parent_path, i::int, d + 1, x, {_entries("x", "childItems")}
            from (select form_id, path as parent_path, depth as d, unnest(l) as x, generate_subscripts(l, 1) as i from step) where json_type(x) = 'OBJECT'),
        element as (select * from step where depth > 0),
        listed as (select form_id, path, case when depth = 0 then {_entries("e", "handlers")} else {_entries("e", "events")} end as l from step),
        event as (select * from (select form_id, path, unnest(l) as e, generate_subscripts(l, 1)::int as pos from listed) where json_type(e) = 'OBJECT')
        {last}
    """


FOUND_SQL = sql(f"select form_id, path as element_path, pos as event_pos, coalesce({_text('e', 'event')}, '') as event_name, coalesce({_text('e', 'handler')}, '') as handler from event")
ELEMENTS_SQL = sql(f"select form_id, path as element_path, parent as parent_path, pos as position, depth, {_text('e', 'name')} as name, {_text('e', 'type')} as type, {_text('e', 'title')} as title, {_text('e', 'dataPath')} as data_path from element")
FORMS_SQL = sql(f"select form_id, {_text('e', 'name')} as name, {_text('e', 'title')} as title, try_cast({_text('e', 'parseIncomplete')} as boolean) as parse_incomplete, try_cast({_text('e', 'noFormRoot')} as boolean) as no_form_root from form")
_LISTED = " union all ".join(f"select form_id, '{record}' as record, unnest({_entries('e', key)}) as x, generate_subscripts({_entries('e', key)}, 1)::int as position from form" for record, key in (("command", "commands"), ("dynamic_list", "dynamicLists")))
COMMANDS_SQL = sql(
    f"select form_id, record, position, {_text('x', 'name')} as name, {_text('x', 'title')} as title, case when record = 'command' then {_text('x', 'action')} end as action, "
    f"case when record != 'command' then {_text('x', 'mainTable')} end as main_table, case when record != 'command' then {_text('x', 'manualQuery')} end as manual_query from ({_LISTED}) where json_type(x) = 'OBJECT'"
)
