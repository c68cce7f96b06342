"""Vectorised access to the characters of an Arrow string column.

A batch is seen as one array of code points with the offsets of its rows, so
that classification, boundaries and folding run as whole-array operations.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

LIMIT = 0x110000

#: The code points with the White_Space property.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point."""
    major = np.array([unicodedata.category(chr(c))[0] for c in range(LIMIT)])
    out = np.full(LIMIT, OTHER, np.uint8)
    out[major == "L"] = LETTER
    out[major == "N"] = NUMBER
    out[list(WHITE_SPACE)] = SPACE
    return out


def slices(array: pa.Array, budget: int = 16 << 20) -> Iterator[pa.Array]:
    """Cut a string array so that no piece has much more than ``budget`` bytes."""
    if len(array) == 0:
        return
    offsets = np.frombuffer(array.buffers()[1], np.int64 if pa.types.is_large_string(array.type) else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    start = 0
    while start < len(array):
        end = int(np.searchsorted(offsets, offsets[start] + budget, side="right")) - 1
        end = min(max(end, start + 1), len(array))
        yield array.slice(start, end - start)
        start = end


def raw_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the int64 byte offsets of the rows.

    Null rows count as empty.
    """
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each begins."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.flatnonzero((data & 0xC0) != 0x80)


def to_array(points: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string array from code points and the code-point offsets of its rows."""
    data = np.ascontiguousarray(points, np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    raw = np.frombuffer(data, np.uint8)
    starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    at = starts[offsets].astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(data))
