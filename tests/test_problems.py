"""Problems 2, 4 and 5 on small tables made by hand, and against plain versions."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stratalens.functions import bloom, jsonindex
from stratalens.operators import forms, orphans, snapshots
from stratalens.session import lookup_join

DAY = lambda n: dt.datetime(2025, 1, n)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_all_are_registered():
    assert {f"p{n}_found" for n in (2, 4, 5)} <= set(__spark_entry__.queries())


# --- problem 2

MANIFEST = "repo string, gen string, gen_at timestamp, rel_path string, mtime_ms long, size long, loaded_at timestamp, doc_id string, diff_kind string"
FILES = [
    ("r", "z", DAY(1), "./A\\B.bsl", 1, 1, DAY(1)), ("r", "z", DAY(1), "old", 1, None, DAY(1)), ("r", "z", DAY(1), "й", 1, None, DAY(1)),
    ("r", "a", DAY(8), "A/B.bsl", 9, 1, DAY(8)), ("r", "a", DAY(8), "A/B.bsl", 1, 1, DAY(9)), ("r", "a", DAY(8), "й", 1, 2, DAY(8)), ("r", "a", DAY(8), "new", 1, 1, DAY(8)),
    ("r", "m", DAY(22), "old", 1, 1, DAY(22)), ("q", "z", DAY(1), "x", 1, 1, DAY(1)),
]


def manifest(spark, files):
    return spark.createDataFrame([(*f, "d", "clash") for f in files], MANIFEST)


def test_p2(spark):
    got = rows(snapshots.diff(manifest(spark, FILES + FILES[:3] * 50)))
    assert got == sorted([
        ("r", "a", "new", "added"), ("r", "a", "old", "deleted"), ("r", "a", "й", "modified"),
        ("r", "m", "A/B.bsl", "deleted"), ("r", "m", "new", "deleted"), ("r", "m", "old", "added"), ("r", "m", "й", "deleted"),
    ], key=repr)
    assert ("r", "a", "й", "modified", "size") in rows(snapshots.changes(manifest(spark, FILES)))


def test_p2_edges(spark):
    assert snapshots.diff(manifest(spark, [])).count() == 0
    nulls = [(None, "a", DAY(1), "x", None, None, None), (None, "b", DAY(2), "x", None, 0, None), (None, "b", DAY(2), None, 1, 1, DAY(1)), (None, None, DAY(3), "x", None, 0, DAY(1)), (None, "b", None, "x", None, None, None)]
    assert rows(snapshots.changes(manifest(spark, nulls))) == sorted([(None, "b", "x", "modified", "size"), (None, "b", None, "added", ""), (None, None, None, "deleted", "")], key=repr)
    long = "д/" * 50_000 + "x.bsl"
    assert rows(snapshots.diff(manifest(spark, [("r", "a", DAY(1), "y", 1, 1, DAY(1)), ("r", "b", DAY(2), "y", 1, 1, DAY(1)), ("r", "b", DAY(2), "./" + long, 1, 1, DAY(1))]))) == [("r", "b", long, "added")]


# --- problem 4


def plain_events(payload):
    """The same read value by value."""
    text = payload.removeprefix("﻿") if payload else ""
    try:
        form = json.loads(text, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return
    get = lambda e, k: e.get(k) if e.get(k) is not None else e.get(k[0].upper() + k[1:])
    entries = lambda e, k: x if isinstance(x := get(e, k), list) else [x] if isinstance(x, dict) else []
    waiting = [("", form, "handlers", "elements")] if isinstance(form, dict) else []
    while waiting:
        path, entry, own, inner = waiting.pop()
        for at, event in enumerate(entries(entry, own), 1):
            if isinstance(event, dict):
                yield path, at, get(event, "event") or "", get(event, "handler") or ""
        for at, child in enumerate(entries(entry, inner), 1):
            if isinstance(child, dict):
                waiting.append((f"{path}.{at}" if path else str(at), child, "events", "childItems"))


def random_payload(rng, depth=0):
    cap = lambda k: k[0].upper() + k[1:] if rng.random() < 0.3 else k
    some = lambda make: rng.choice([None, [], "x", 3, make(), [make(), None, make()], [[make()], make()]])
    event = lambda: {cap("event"): rng.choice(["A", None, "ё\"\\\n"]), cap("handler"): rng.choice(["h", None, ""]), "x": {"event": "no"}}
    out = {cap("name"): "n", "tooltip": {"events": [event()]}, cap("handlers" if not depth else "events"): some(event), "events" if not depth else "handlers": some(event)}
    if depth < 4:
        out[cap("elements" if not depth else "childItems")] = some(lambda: random_payload(rng, depth + 1))
    items = list(out.items())
    rng.shuffle(items)
    return dict(items)


FORM = "form_id long, loaded_at timestamp, payload string, position int, record string"


def test_p4(spark):
    old, new = {"handlers": [{"event": "X"}]}, {
        "Handlers": [None, {"Event": "A", "Handler": None}], "handlers": None,
        "elements": {"childItems": [None, {"Events": {"event": "B", "handler": "h"}, "ChildItems": [{"events": [{"event": "C"}, None, {"event": "D", "handler": "d"}]}]}]},
    }
    df = spark.createDataFrame([(1, DAY(1), json.dumps(old), 0, ""), (1, DAY(2), json.dumps(new), 0, ""), (2, DAY(1), json.dumps(old), 0, ""), (2, DAY(2), None, 0, "")], FORM)
    assert rows(forms.found(df)) == [(1, "", 2, "A", ""), (1, "1.2", 1, "B", "h"), (1, "1.2.1", 1, "C", ""), (1, "1.2.1", 3, "D", "d")]
    assert [r[1:5] for r in rows(forms.elements(df))] == [("1", "", 1, 1), ("1.2", "1", 2, 2), ("1.2.1", "1.2", 1, 3)]
    assert rows(forms.forms(df)) == [(1, None, None, None, None)]


def test_p4_brute_force(spark):
    rng = random.Random(7)
    texts = [json.dumps(random_payload(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])) for _ in range(400)]
    texts += ["", " ", "[]", "null", "{", "﻿" + texts[0], texts[1][:-1], '{"a": 1,}', "nonsense", '{"handlers": [{"\\u0065vent": "E", "handler": 5}]}']
    texts.append('{"elements": [' + '{"childItems": [' * 400 + '{"events": [{"event": "deep"}]}' + "]}" * 400 + "]}")
    texts.append(json.dumps({"handlers": [{"event": "e" * 100_000, "handler": "h"}] * 60}))
    df = spark.createDataFrame([(n, DAY(1), t, 0, "") for n, t in enumerate(texts)] + [(-1, None, None, 0, ""), (None, DAY(1), texts[0], 0, "")], FORM)
    expected = sorted([(n, *(str(x) if isinstance(x, int) and i > 1 else x for i, x in enumerate(e))) for n, t in enumerate(texts) for e in plain_events(t)], key=repr)
    assert rows(forms.found(df)) == expected
    assert forms.found(df.limit(0)).count() == 0


def test_json_index_agrees():
    rng = random.Random(3)
    texts = []
    for _ in range(3000):
        text = json.dumps(random_payload(rng, 3), ensure_ascii=rng.random() < 0.5)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(text))
            text = rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice('{}[]:,"\\ 1tn\x01u') + text[at:], text[:at] or "1"])
        texts.append(text)
    parts = [t.encode() for t in texts]
    nodes = jsonindex.index(np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(p) for p in parts])))
    for n, text in enumerate(texts):
        try:
            json.loads(text, parse_constant=lambda _: 1 / 0)
            ok = True
        except (ValueError, ZeroDivisionError):
            ok = False
        assert bool(nodes.well[n]) == ok, text
    assert set(nodes.text.tolist()) == set(np.flatnonzero(nodes.well).tolist())


# --- problem 5


def references(spark, member, life, nodes):
    return (
        spark.createDataFrame([(i, r, o, t, "x") for i, r, o, t in member], "member_id long, repo string, object string, seen_at timestamp, h string"),
        spark.createDataFrame([(*x, "x") for x in life], "repo string, object string, first_seen timestamp, deleted_at timestamp, kind string"),
        spark.createDataFrame([(*x, DAY(3), "x") for x in nodes], "subsystem_id long, repo string, path string, parent_path string, read_at timestamp, reason string"),
        spark.createDataFrame([("Catalog", "Catalogs", "Справочник")], "singular_eng string, plural_eng string, russian_name string"),
    )


MEMBER = [
    (1, "r", "Catalog.A", DAY(5)), (2, "r", "Справочник.A", DAY(1)), (3, "r", "Catalog.A", DAY(9)), (4, "q", "Catalog.A", DAY(5)), (5, "r", "Catalog.A", DAY(2)), (6, "r", "", DAY(2)), (7, "r", None, DAY(2)),
    (8, "r", "Catalog.A", DAY(10)), (4, "q", "Catalog.A", DAY(5)), (9, "r", "Catalog.A", None), (10, "r", "none", None), (11, None, "Catalog.A", DAY(5)), (12, "r", "B.B", DAY(4)), (13, "r", "B.B", DAY(7)), (14, "r", "C", DAY(9)),
]
LIFE = [("r", "Справочник.A", DAY(2), DAY(9)), ("r", "Catalog.A", DAY(10), None), ("r", "B.B", DAY(1), DAY(5)), ("r", "B.B", DAY(3), DAY(6)), ("r", "B.B", DAY(9), DAY(8)), ("r", "C", None, None), (None, "Catalog.A", DAY(1), None)]
NODES = [(1, "r", "П.А", None), (2, "r", "П.А.Б", "П.А"), (3, "q", "П.А.Б", "П.А"), (4, "r", "П.В.Г", "П.A"), (5, "r", "П.Д", ""), (6, None, "П", None), (7, None, "П.Е", "П"), (8, "r", None, "П.А")]
ORPHANS = [("membership", 2, "late"), ("membership", 3, "deleted"), ("membership", 4, "missing"), ("membership", 10, "missing"), ("membership", 13, "deleted"), ("membership", 14, "late"), ("subsystem", 3, "missing"), ("subsystem", 4, "missing")]


@pytest.mark.parametrize("most_bytes, most_rows", [(bloom.MOST_BYTES, 1000), (0, 1000), (bloom.MOST_BYTES, 0)])
def test_p5(spark, most_bytes, most_rows):
    given = references(spark, MEMBER, LIFE, NODES)
    assert rows(orphans.orphans(*given, most_bytes, most_rows).drop("seen_at")) == sorted(ORPHANS, key=repr)


def test_p5_edges(spark):
    given = references(spark, MEMBER, LIFE, NODES)
    assert ("subsystem", "2025-01", "missing", 2) in rows(orphans.counts(*given)) and ("membership", None, "missing", 1) in rows(orphans.counts(*given))
    empty = references(spark, [], [], [])
    assert orphans.found(*empty).count() == 0
    assert {r[2] for r in rows(orphans.found(given[0], empty[1], empty[2], empty[3]))} == {"missing"}


def test_spans_are_merged(spark):
    rng = random.Random(9)
    at = lambda: dt.datetime(2025, 1, 1) + dt.timedelta(days=rng.randint(0, 400))
    life = [("r", f"o{rng.randint(0, 9)}", at(), rng.choice([None, at(), at()]) if rng.random() < 0.7 else at()) for _ in range(300)]
    _, spans = orphans.lives(spark.createDataFrame(life, "repo string, object string, first_seen timestamp, deleted_at timestamp"))
    got = spans.collect()
    for name in {o for _, o, _, _ in life}:
        own = sorted((r.since, r.until) for r in got if r.object == name)
        assert all(a[1] < b[0] for a, b in zip(own, own[1:]))
        for day in range(420):
            t = dt.datetime(2025, 1, 1) + dt.timedelta(days=day)
            assert any(a <= t < b for a, b in own) == any(o == name and s <= t and (e is None or t < e) for _, o, s, e in life)


def test_bloom(spark):
    keys = spark.range(50_000).select(F.xxhash64("id").alias("h"))
    for bits in (bloom.SEGMENT_BITS, 1 << 12):
        held = bloom.build(keys, segment_bits=bits)
        assert held.segments == max(1, (1 << 20) // bits)
        inside = np.array([r.h for r in keys.collect()])
        assert held.may_hold(inside).all()
        others = np.array([r.h for r in spark.range(50_000, 150_000).select(F.xxhash64("id").alias("h")).collect()])
        assert held.may_hold(others).mean() < 0.01
    assert bloom.build(keys, most_bytes=10) is None
    assert not bloom.build(keys.limit(0)).may_hold(inside).any()


@pytest.mark.parametrize("most", [1000, 0])
def test_lookup_join(spark, most):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "id long, k string")
    right = spark.createDataFrame([("a", 5), ("a", 6), (None, 7)], "k string, v long")
    assert rows(lookup_join(left, right, ["k"], "inner", "id", most=most)) == [(1, "a", 5), (1, "a", 6), (3, None, 7), (4, "a", 5), (4, "a", 6)]
    assert rows(lookup_join(left, right, ["k"], "left_anti", "id", most=most)) == [(2, "b")]
    assert rows(lookup_join(left, right, ["k"], "left", "id", F.col("v") > 5, most=most)) == [(1, "a", 6), (2, "b", None), (3, None, 7), (4, "a", 6)]
