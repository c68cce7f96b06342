"""Problem 6: ids of every text by a public byte-level BPE vocabulary.

Pre-tokens are cut for a whole Arrow batch at once from code-point classes.
Equal pre-tokens are found by dictionary encoding, so each different one is
resolved once, in two tiers: a minimal perfect hash knows the pre-tokens that
are vocabulary entries; the rest are merged with a heap over linked bytes.
The ids of the batch are then gathered without a loop over rows.

Defined results: a null and an empty text give an empty list; repeated rows
give repeated results; very long texts are handled in slices of bounded size
(a single text is never cut).
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.codepoints import LETTER, SPACE, classes, code_points, raw_bytes, slices

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_MASK = (1 << 64) - 1
_MIX = 0x9E3779B97F4A7C15
_STIR = 0xD6E8FEB86659FD93


def read_ranks(path: str = DEFAULT_VOCABULARY) -> list[bytes]:
    """Vocabulary entries in the order of their ids, from a file of base64 and rank."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Minimal perfect hash of byte strings by hash-and-displace.

    Keys fall into buckets; a bucket of several keys gets the first seed that
    sends all of them to free slots, a bucket of one key the free slot itself.
    As many slots as keys; the key kept in a slot rejects strangers.
    """

    def __init__(self, keys: list[bytes], load: int = 4):
        n = self.n = len(keys)
        self.buckets = max(1, n // load)
        self.keys = keys
        hashes = np.array([xxhash.xxh3_64_intdigest(key) for key in keys], np.uint64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        seeds, slots, taken = [0] * self.buckets, np.full(n, -1, np.int64), np.zeros(n, bool)
        largest_first = np.argsort(-sizes, kind="stable")
        for b in largest_first[sizes[largest_first] > 1].tolist():
            members = order[ends[b] - sizes[b] : ends[b]]
            for base in range(1, 1 << 62, 64):
                tried = np.arange(base, base + 64, dtype=np.uint64)
                at = np.sort(self._slots(hashes[members][None, :], tried[:, None]), axis=1)
                good = np.flatnonzero(~taken[at].any(axis=1) & (at[:, 1:] != at[:, :-1]).all(axis=1))
                if len(good):
                    break
            seeds[b] = int(tried[good[0]])
            at = self._slots(hashes[members], tried[good[:1]])
            slots[at], taken[at] = members, True
        free = np.flatnonzero(~taken).tolist()
        for b in np.flatnonzero(sizes == 1).tolist():
            at = free.pop()
            seeds[b], slots[at] = -at - 1, order[ends[b] - 1]
        self.seeds, self.slots = seeds, slots.tolist()

    def _slots(self, h: np.ndarray, seed: np.ndarray) -> np.ndarray:
        x = h ^ (seed * np.uint64(_MIX))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(_STIR)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(self.n)).astype(np.int64)

    def _slot(self, h: int, seed: int) -> int:
        x = (h ^ (seed * _MIX)) & _MASK
        x = ((x ^ (x >> 32)) * _STIR) & _MASK
        return (x ^ (x >> 32)) % self.n

    def find(self, key: bytes) -> int:
        """Index of ``key`` among the keys, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % self.buckets]
        i = self.slots[-seed - 1 if seed < 0 else self._slot(h, seed)]
        return i if i >= 0 and self.keys[i] == key else -1


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token by merging its bytes, lowest rank first, leftmost on ties."""
    n = len(token)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, left, stop = heapq.heappop(heap)
        right = after[left] if alive[left] else n
        if right >= n or end[right] != stop:
            continue  # one of the two parts has changed since
        end[left] = stop
        alive[right] = False
        nxt = after[left] = after[right]
        if nxt < n:
            before[nxt] = left
            if (r := ranks.get(token[left : end[nxt]])) is not None:
                heapq.heappush(heap, (r, left, end[nxt]))
        prev = before[left]
        if prev >= 0 and (r := ranks.get(token[prev:stop])) is not None:
            heapq.heappush(heap, (r, prev, stop))
    out, at = [], 0
    while at < n:
        out.append(ranks[token[at : end[at]]])
        at = after[at]
    return out


def pre_token_starts(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, as a mask over code points.

    ``rows`` holds the first code point of each row. Runs of letters, of
    numbers and of other signs are pre-tokens, with one blank before them; of
    white space before them all but the last character is one; an apostrophe
    with one of seven English endings is one.
    """
    n = len(points)
    kind = classes()[points]
    fresh = np.zeros(n + 1, bool)
    fresh[rows[rows < n]] = True
    fresh[n] = True
    start = np.empty(n, bool)
    start[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= fresh[:n]
    # the last white space of a run that something follows
    last = np.flatnonzero((kind[:-1] == SPACE) & start[1:] & ~fresh[1:n]) if n > 1 else np.zeros(0, np.int64)
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    # apostrophe endings
    quote = np.flatnonzero(points[:-1] == 0x27) if n > 1 else last
    quote = quote[start[quote] & ~fresh[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        first = points[quote + 1]
        has_two = (quote + 2 < n) & ~fresh[np.minimum(quote + 2, n)]
        second = np.where(has_two, points[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = ((first == ord("r")) & (second == ord("e"))) | ((first == ord("v")) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
        hit = quote[one | two]
        stop = hit + np.where(one[one | two], 2, 3)
        start[hit + 1] = False
        start[stop[stop < n]] = True
    return start


class Encoder:
    """Encodes string arrays; keeps resolved pre-tokens up to a bound."""

    def __init__(self, vocabulary: list[bytes], perfect: PerfectHash, keep: int = 400_000):
        self.ranks = {token: i for i, token in enumerate(vocabulary)}
        self.perfect = perfect
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, token: bytes) -> int:
        whole = self.perfect.find(token)
        ids = [whole] if whole >= 0 else merge(token, self.ranks)
        k = len(self.known)
        if k == len(self.begin):
            self.begin, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.begin, self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[k], self.size[k] = self.used, len(ids)
        self.used += len(ids)
        self.known[token] = k
        return k

    def _resolve(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each pre-token of the array, and the first pre-token of each row."""
        data, offsets = raw_bytes(texts)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        points, at = code_points(data)
        rows = np.searchsorted(at, offsets)  # offsets are character starts or the end
        start = pre_token_starts(points, rows[:-1])
        first = np.flatnonzero(start)
        bounds = np.append(at[first], len(data)).astype(np.int32)
        tokens = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())])
        coded = tokens.dictionary_encode()
        if len(self.known) > self.keep:
            self._forget()
        known, learn = self.known, self._learn
        entry = np.fromiter((k if (k := known.get(t)) is not None else learn(t) for t in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        return entry[np.asarray(coded.indices)], np.searchsorted(first, rows)

    def encode(self, texts: pa.Array) -> pa.Array:
        """Lists of ids."""
        entry, rows = self._resolve(texts)
        size = self.size[entry]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat((self.begin[entry] - (ends - size)), size)
        where += np.arange(total)
        offsets = np.concatenate([[0], ends])[rows].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.ids[where]))

    def count(self, texts: pa.Array) -> pa.Array:
        """Numbers of ids."""
        entry, rows = self._resolve(texts)
        ends = np.concatenate([[0], np.cumsum(self.size[entry])])
        return pa.array(np.diff(ends[rows]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, perfect: PerfectHash | None = None) -> Encoder:
    """The encoder of a vocabulary file, kept for the life of the process."""
    if path not in _ENCODERS:
        perfect = perfect or perfect_hash(path)
        _ENCODERS[path] = Encoder(perfect.keys, perfect)
    return _ENCODERS[path]


@lru_cache(maxsize=4)
def perfect_hash(path: str) -> PerfectHash:
    """The perfect hash of a vocabulary file, built once a process."""
    return PerfectHash(read_ranks(path))


def _batches(path: str, shared, what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, None if path in _ENCODERS else shared.value)
        for batch in batches:
            texts, done = batch.column(batch.num_columns - 1), 0
            for piece in slices(texts):
                kept = [batch.column(i).slice(done, len(piece)) for i in range(batch.num_columns - 1)]
                out = own.encode(piece) if what == "ids" else own.count(piece)
                yield pa.RecordBatch.from_arrays([*kept, out], names=[*batch.schema.names[:-1], what])
                done += len(piece)

    return run


def _run(df: DataFrame, keep: list[str | Column], text: str | Column, path: str, what: str, kind: str) -> DataFrame:
    if not os.path.exists(path):
        raise ValueError(f"no vocabulary at {path}")
    shared = df.sparkSession.sparkContext.broadcast(perfect_hash(path))  # bounded by the vocabulary
    given = df.select(*keep, (F.col(text) if isinstance(text, str) else text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(_batches(path, shared, what), f"{schema}, {what} {kind}")


def encode(df: DataFrame, keep: list[str | Column], text: str | Column = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``ids`` (array<int>) of each row; no shuffle."""
    return _run(df, keep, text, vocabulary, "ids", "array<int>")


def count_tokens(df: DataFrame, keep: list[str | Column], text: str | Column = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (bigint) of each row; no shuffle."""
    return _run(df, keep, text, vocabulary, "n_tokens", "bigint")
