"""Structural index of many JSON texts at once, by bitmaps over their bytes.

Texts lie one after another in a buffer. Bitmaps mark escaped bytes, quotes,
brackets and delimiters; the running parity of quotes tells what is inside
strings; prefix sums of brackets give the nesting depth. From these come the
tokens, and from the tokens the values with their parents, keys and positions.
No text is read value by value, and no depth is too deep.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

#: Classes of tokens, and of the two ends of a text.
_START, _OBJECT, _ARRAY, _OBJECT_END, _ARRAY_END, _COMMA, _COLON, _STRING, _SCALAR, _KEY, _NEXT_KEY, _STOP = range(12)
_CLASS = np.zeros(256, np.uint8)
for _char, _class in ((b"{", _OBJECT), (b"[", _ARRAY), (b"}", _OBJECT_END), (b"]", _ARRAY_END), (b",", _COMMA), (b":", _COLON)):
    _CLASS[_char[0]] = _class


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_BLANK, _ESCAPES, _HEX = _bytes(b" \t\r\n"), _bytes(b'"\\/bfnrtu'), _bytes(b"0123456789abcdefABCDEF")
_LITERAL = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null")

#: What may follow what; a comma inside an object is a _NEXT_KEY.
_MAY = np.zeros((12, 12), bool)
_VALUES, _AFTER = [_OBJECT, _ARRAY, _STRING, _SCALAR], [_COMMA, _NEXT_KEY, _OBJECT_END, _ARRAY_END, _STOP]
for _one, _others in (
    (_START, _VALUES), (_OBJECT, [_KEY, _OBJECT_END]), (_ARRAY, [*_VALUES, _ARRAY_END]), (_KEY, [_COLON]), (_COLON, _VALUES), (_COMMA, _VALUES), (_NEXT_KEY, [_KEY]),
    (_STRING, _AFTER), (_SCALAR, _AFTER), (_OBJECT_END, _AFTER), (_ARRAY_END, _AFTER),
):
    _MAY[_one, _others] = True


@dataclass
class Nodes:
    """The values of all well-formed texts, in order of their first bytes."""

    data: np.ndarray
    text: np.ndarray  # the number of the text
    begin: np.ndarray  # the first byte
    end: np.ndarray  # behind the last byte
    kind: np.ndarray  # the first byte itself
    parent: np.ndarray  # the node that holds it, or -1
    depth: np.ndarray
    position: np.ndarray  # in its parent, from 1
    key_begin: np.ndarray  # of the key's bytes without quotes; -1 outside objects
    key_end: np.ndarray
    well: np.ndarray  # of each text: whether it is JSON

    def strings(self, at: np.ndarray) -> pa.Array:
        """Of each node of ``at`` the string's characters, nothing for null and for -1, any other value as it is written; by one gathering of bytes."""
        there = at >= 0
        own = np.where(there, at, 0)
        quoted = np.zeros(len(at), bool)
        if len(self.kind):
            quoted = self.kind[own] == 0x22
            there = there & (self.kind[own] != 0x6E)  # n begins null alone
        begin = np.where(there, self.begin[own] + quoted, 0) if len(self.kind) else np.zeros(len(at), np.int64)
        size = np.where(there, self.end[own] - quoted - begin, 0) if len(self.kind) else np.zeros(len(at), np.int64)
        stops = np.cumsum(size)
        where = np.repeat(begin - (stops - size), size) + np.arange(int(stops[-1]) if len(stops) else 0)
        data = self.data[where]
        offsets = np.append(0, stops)
        valid = pa.array(there).buffers()[1]
        out = pa.Array.from_buffers(pa.large_string(), len(at), [valid, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        slashes = np.append(0, np.cumsum(data == 0x5C))
        escaped = quoted & there & (slashes[offsets[1:]] > slashes[offsets[:-1]])
        if escaped.any():
            written = out.filter(pa.array(escaped)).dictionary_encode()
            plain = pa.array([json.loads(f'"{t}"') for t in written.dictionary.to_pylist()], pa.large_string()).take(written.indices)
            out = pc.replace_with_mask(out, pa.array(escaped), plain)
        return out

    def codes(self, names: list[str]) -> np.ndarray:
        """The index in ``names`` (ASCII, below 24 bytes) of each node's key; -1 for other keys and for none."""
        width = 24
        keyed = np.flatnonzero(self.key_begin >= 0)
        out = np.full(len(self.text), -1)
        if not len(keyed):
            return out
        size = self.key_end[keyed] - self.key_begin[keyed]
        padded = np.append(self.data, np.zeros(width, np.uint8))
        letters = np.lib.stride_tricks.sliding_window_view(padded, width)[self.key_begin[keyed]] * (np.arange(width) < size[:, None])
        known = np.array([list(n.encode().ljust(width, b"\0")) for n in names], np.uint8)
        mixed = lambda rows: np.ascontiguousarray(rows).view(np.uint64) @ _MIX
        hashes = mixed(known)
        order = np.argsort(hashes)
        found = order[np.minimum(np.searchsorted(hashes[order], mixed(letters)), len(names) - 1)]
        same = (size < width) & (letters == known[found]).all(axis=1)
        out[keyed[same]] = found[same]
        place = {name: n for n, name in enumerate(names)}
        slashes = np.append(0, np.cumsum(self.data == 0x5C))
        for i in keyed[slashes[self.key_end[keyed]] > slashes[self.key_begin[keyed]]]:  # keys written with escapes
            key = json.loads(b'"' + self.data[self.key_begin[i] : self.key_end[i]].tobytes() + b'"')
            out[i] = place.get(key, -1)
        return out


def _escapes(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Backslashes that escape the next byte: the odd ones of each run; runs begin anew at ``first``."""
    at = np.flatnonzero(data == 0x5C)
    begins = np.append(True, np.diff(at) != 1)[: len(at)] | np.isin(at, first)
    run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - run) % 2 == 0]


def _last(codes: np.ndarray, wanted: np.ndarray, n: int) -> np.ndarray:
    """Of each wanted (level * n + index) the greatest code of the same level below it, as an index; -1 for none."""
    place = np.searchsorted(codes, wanted) - 1
    found = codes[np.maximum(place, 0)] if len(codes) else np.full(len(wanted), -1)
    return np.where((place >= 0) & (found // n == wanted // n), found % n, -1)


def index(data: np.ndarray, starts: np.ndarray) -> Nodes:
    """The nodes of the texts in ``data`` (bytes) that begin at ``starts``, whose last entry is the end.

    Texts that are no JSON have no nodes.
    """
    texts = len(starts) - 1
    well = np.ones(texts, bool)
    first = starts[:-1]
    heads = np.zeros(len(data) + 1, bool)
    heads[first] = True
    text_of = lambda at: np.searchsorted(starts, at, side="right") - 1

    # bitmaps of the bytes
    slash = _escapes(data, first)
    escaped = np.zeros(len(data) + 1, bool)
    escaped[slash + 1] = True
    escaped &= ~heads
    quote = (data == 0x22) & ~escaped[:-1]
    count = np.append(0, np.cumsum(quote, dtype=np.int64))
    well &= (count[starts[1:]] - count[first]) % 2 == 0
    inside = (count[1:] - np.repeat(count[first], np.diff(starts))) % 2 == 1  # an opening quote is inside, a closing one isn't
    opening, closing = quote & inside, quote & ~inside
    outside = ~inside & ~closing
    kinds = np.where(outside, _CLASS[data], 0)
    kinds[opening] = _STRING
    plain = outside & (kinds == 0) & ~_BLANK[data]
    led = np.append(False, plain)[:-1] & ~heads[:-1]
    kinds[plain & ~led] = _SCALAR

    # what is wrong inside strings
    well[text_of(np.flatnonzero(inside & (data < 0x20)))] = False
    next_bytes = np.append(data, np.zeros(5, np.uint8))
    well[text_of(slash[~_ESCAPES[next_bytes[slash + 1]] | heads[slash + 1] | ~inside[slash]])] = False
    units = slash[next_bytes[slash + 1] == 0x75]
    well[text_of(units[~_HEX[next_bytes[units[:, None] + np.arange(2, 6)]].all(axis=1)])] = False

    # tokens and their levels
    at = np.flatnonzero(kinds)
    kind = kinds[at].astype(np.int64)
    text, n, everywhere = text_of(at), max(len(at), 1), np.arange(len(at))
    opens, closes = (kind == _OBJECT) | (kind == _ARRAY), (kind == _OBJECT_END) | (kind == _ARRAY_END)
    depth = np.cumsum(opens.astype(np.int64) - closes)
    borders = np.searchsorted(at, starts)
    base = np.append(0, depth)[borders]
    well &= base[1:] == base[:-1]
    level = depth - opens - base[:-1][text]  # of a bracket: the level it stands at itself
    well[text[level < 0]] = False
    shifted = level - min(int(level.min(initial=0)), 0) + 1  # levels of broken texts may be below 0
    codes = np.sort(shifted[opens] * n + everywhere[opens])
    parent = _last(codes, (shifted - 1) * n + everywhere, n)
    parent[(parent >= 0) & (text[parent] != text)] = -1
    partner = np.full(len(at), -1)
    ends = everywhere[closes]
    partner[ends] = _last(codes, shifted[ends] * n + ends, n)
    bad = (partner[ends] < 0) | (text[partner[ends]] != text[ends]) | (kind[partner[ends]] + 2 != kind[ends])
    well[text[ends[bad]]] = False

    # what follows what
    kind[(kind == _COMMA) & (parent >= 0) & (kind[parent] == _OBJECT)] = _NEXT_KEY
    well[text[(kind == _COMMA) & (parent < 0)]] = False
    same = np.append(False, text[1:] == text[:-1])[: len(at)]
    before = np.where(same, np.append(0, kind)[:-1], _START)
    kind[(kind == _STRING) & ((before == _OBJECT) | (before == _NEXT_KEY))] = _KEY
    before = np.where(same, np.append(0, kind)[:-1], _START)
    well[text[~_MAY[before, kind]]] = False
    used = borders[1:] > borders[:-1]
    well &= used
    well[used] &= _MAY[kind[borders[1:][used] - 1], _STOP]

    # where tokens end
    end = at + 1
    string_ends = np.flatnonzero(closing)
    strings = everywhere[(kind == _STRING) | (kind == _KEY)]
    place = np.searchsorted(string_ends, at[strings])
    end[strings] = np.append(string_ends, len(data))[place] + 1
    scalars = everywhere[kind == _SCALAR]
    stops = np.append(np.flatnonzero(~plain | heads[:-1]), len(data))
    end[scalars] = stops[np.searchsorted(stops, at[scalars], side="right")]
    known: dict[bytes, bool] = {}
    for i in scalars:
        word = data[at[i] : end[i]].tobytes()
        if word not in known:
            known[word] = _LITERAL.fullmatch(word) is not None
        if not known[word]:
            well[text[i]] = False
    ends = ends[partner[ends] >= 0]
    end[partner[ends]] = at[ends] + 1

    # values, with the commas before them in their container
    commas = everywhere[(kind == _COMMA) | (kind == _NEXT_KEY)]
    comma_codes = np.sort(parent[commas] * n + commas)
    nodes = everywhere[(opens | (kind == _STRING) | (kind == _SCALAR)) & well[text]]
    position = np.searchsorted(comma_codes, parent[nodes] * n + nodes) - np.searchsorted(comma_codes, parent[nodes] * n) + 1
    number = np.full(n + 1, -1)
    number[nodes] = np.arange(len(nodes))
    keyed = before[nodes] == _COLON
    key = np.maximum(nodes - 2, 0)
    return Nodes(
        data, text[nodes], at[nodes], end[nodes], data[at[nodes]], number[parent[nodes]], level[nodes], position,
        np.where(keyed, at[key] + 1, -1), np.where(keyed, end[key] - 1, -1), well,
    )
