"""Quotas of sources and of their shards, and the blocks that are taken."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalens.llm import mixing
from stratalens.llm.mixing import _shard_quotas, plan_sources, sainte_lague


def plain(weights, seats, caps):
    """Seat by seat to the highest quotient."""
    given = [0] * len(weights)
    for _ in range(seats):
        free = [i for i, w in enumerate(weights) if given[i] < caps[i] and w > 0]
        if not free:
            break
        given[max(free, key=lambda i: (weights[i] / (2 * given[i] + 1), -i))] += 1
    return given


def test_caps_that_hold_all_seats_end():
    assert sainte_lague(np.array([3.0, 5.0]), 10_000_000, np.array([4, 6])).tolist() == [4, 6]
    assert sainte_lague(np.array([1e-9, 1e6]), 11, np.array([5, 10])).tolist() == [1, 10]
    assert sainte_lague(np.array([53.0, 24, 23]), 7).tolist() == [3, 2, 2]
    assert sainte_lague(np.array([5.0]), 3, np.array([10])).tolist() == [3] and sainte_lague(np.array([]), 3).tolist() == []


def test_highest_quotients():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 8))
        weights = rng.choice([0.0, 0.1, 0.5, 1.0, 2.0, 3.7, 100.0], n)
        caps = rng.integers(0, 15, n)
        seats = int(rng.integers(0, 60))
        assert sainte_lague(weights, seats, caps).tolist() == plain(weights, seats, caps)


@pytest.mark.parametrize("shards", [200, 2000, 50_000])
def test_no_source_is_lost_at_any_size(shards):
    rng = np.random.default_rng(1)
    tokens = rng.integers(2_000_000, 4_000_000, shards)
    totals = pd.DataFrame({"source": ["scarce", "rich"], "available": [int(tokens.sum()), 10**14]})
    plan = plan_sources(totals, pd.DataFrame({"source": ["scarce", "rich"], "weight": [0.01, 0.99], "max_repeats": [3, 1]}))
    quota = plan.table["quota"]
    assert abs(quota[0] / quota.sum() - 0.01) < 1e-6 and plan.block == 512
    group = pd.DataFrame({"source": "scarce", "shard": np.arange(shards), "tokens": tokens, "max_repeats": 3, "quota": quota[0], "block": plan.block})
    part = _shard_quotas(group)
    assert part["quota"].sum() >= quota[0] - shards and (part["quota"] <= 3 * part["blocks"]).all()
    mixed = (part["quota"] * part["tokens"] / part["blocks"]).sum()
    assert abs(mixed / (3 * tokens.sum()) - 1) < 1e-4


TARGET = "source string, weight double, max_repeats int"


def sized(spark, parts):
    out = None
    for source, count, tokens in parts:
        df = spark.range(count).select((F.col("id") + (0 if out is None else out.count())).alias("doc_id"), F.lit(source).alias("source"), F.expr(tokens).alias("n_tokens"))
        out = df if out is None else out.unionAll(df)
    return out


def test_shares_and_repeats(spark):
    df = sized(spark, [("a", 6000, "50 + id % 100"), ("b", 500, "50 + id % 100"), ("c", 3000, "20 + id % 400"), ("none", 100, "10")])
    target = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 4), ("c", 0.3, 2), ("missing", 0.1, 1), ("a", 0.5, 1)], TARGET)
    got = mixing.mix_sized(df, target, shard_rows=700)
    shares = {r.source: r for r in got.shares().collect()}
    assert all(abs(shares[s].actual_share - w) < 0.005 for s, w in (("a", 0.5), ("b", 0.2), ("c", 0.3)))
    assert shares["none"].mixed_tokens == 0 and shares["missing"].target_share == 0 and [shares[s].most_uses <= m for s, m in (("a", 1), ("b", 4), ("c", 2))] == [True] * 3
    assert shares["b"].mixed_tokens == 4 * shares["b"].available_tokens  # the scarce source is used up
    rows = sorted(tuple(r) for r in got.documents.collect())
    assert rows == sorted(tuple(r) for r in mixing.mix_sized(df.repartition(5), target, shard_rows=700).documents.collect())
    assert rows != sorted(tuple(r) for r in mixing.mix_sized(df, target, seed=8, shard_rows=700).documents.collect())
    part = mixing.mix_sized(df, target, total_tokens=100_000, shard_rows=700).shares().collect()
    assert abs(sum(r.mixed_tokens for r in part) - 100_000) < 3000


def test_edges(spark):
    target = spark.createDataFrame([("a", 1.0, 2), (None, 0.5, 1)], TARGET)
    one = sized(spark, [("a", 1, "5")])
    assert [tuple(r) for r in mixing.mix_sized(one, target).documents.collect()] == [(0, "a", 5, 2)]
    assert mixing.mix_sized(one.limit(0), target).documents.count() == 0 and mixing.mix_sized(one, target.limit(0)).documents.count() == 0
    null = spark.createDataFrame([(1, None, 5), (2, "a", 0), (3, "a", None)], "doc_id long, source string, n_tokens long")
    assert mixing.mix_sized(null, target).documents.count() == 0
    huge = spark.createDataFrame([(1, "a", 10**9)] + [(n, "a", 1) for n in range(2, 50)], "doc_id long, source string, n_tokens long")
    assert mixing.mix_sized(huge, target, total_tokens=10**9).shares().first().mixed_tokens >= 10**9
