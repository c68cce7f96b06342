"""Problem 7: mixing sources to target weights in tokens of a public tokenizer.

The documents of a source lie in shards, and those of a shard, in a seeded
order, in blocks of equal tokens. Sainte-Laguë apportionment gives the blocks of
the whole mix to sources by the highest quotients of their weights, and each
source's blocks to its shards by those of their tokens: integer quotas, never
above what may be repeated. A shard then takes as many of its blocks, from a
seeded one on and around, each once before any is taken again. A document goes
with the block in which its middle token lies.

The total is, unless given, the largest at which every source can make up its
weight without using a document more than ``max_repeats`` times. A source
without documents can't contribute; the weights of the others are scaled up. A
source without a target isn't used.

Blocks have ``BLOCK_TOKENS`` tokens, or fewer where the smallest source would
have less than ``LEAST_BLOCKS`` of them; within a shard all are equal, so that a
shard is a whole number of blocks and nothing is lost by rounding at any size.

Defined results: documents without source, with a null or empty text or
without tokens aren't used; repeated target rows count once; an empty table of
documents or of targets gives an empty mix. The order of equal hashes is that of
doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalens.llm.bpe import DEFAULT_VOCABULARY, count_tokens
from stratalens.session import materialize

#: Documents a shard holds about; shards bound the groups that one task orders.
SHARD_ROWS = 20_000
#: Tokens of a block at most, and blocks of the smallest source at least.
BLOCK_TOKENS, LEAST_BLOCKS = 512, 2000


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients weight/(2a+1), never above the caps; ties go to the earlier entry.

    Fewer than ``seats`` are given only if all caps are reached.
    """
    weights = np.asarray(weights, float)
    caps = np.full(len(weights), seats, np.int64) if caps is None else np.minimum(np.asarray(caps, np.int64), seats)
    caps = np.where(weights > 0, np.maximum(caps, 0), 0)
    seats = int(min(seats, caps.sum()))
    given = np.zeros(len(weights), np.int64)
    if seats <= 0:
        return given
    if seats == caps.sum():
        return caps
    # the largest price at which no more than the seats are sold
    low, high = 0.0, float(weights.max()) * 2
    sold = lambda price: np.minimum(caps, np.floor((weights / price + 1) / 2)).astype(np.int64)
    for _ in range(200):
        middle = (low + high) / 2
        if middle <= low or middle >= high:
            break
        if middle > 0 and sold(middle).sum() > seats:
            low = middle
        else:
            high = middle
    given = sold(high)
    while (left := seats - int(given.sum())) > 0:  # ties at the price
        quotient = np.where(given < caps, weights / (2 * given + 1), -1)
        given[np.argsort(-quotient, kind="stable")[: min(left, int((quotient > 0).sum()))]] += 1
    return given


@dataclass
class Plan:
    """Quotas of the sources in blocks, and the tokens of a block."""

    table: pd.DataFrame  # source, weight, target_share, max_repeats, available, quota
    block: int


def plan_sources(totals: pd.DataFrame, targets: pd.DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS) -> Plan:
    """Blocks of each source of the targets; ``totals`` has source and available tokens."""
    t = targets.merge(totals, on="source", how="left")
    t["available"] = t["available"].fillna(0).astype("int64")
    t["weight"] = t["weight"].fillna(0.0).clip(lower=0)
    t["max_repeats"] = t["max_repeats"].fillna(1).clip(lower=0).astype("int64")
    most = t["available"] * t["max_repeats"]
    usable = t["weight"].where(most > 0, 0.0)
    used = usable > 0
    t["target_share"] = usable / usable.sum() if used.any() else 0.0
    block = max(1, min(block_tokens, int(t.loc[used, "available"].min()) // LEAST_BLOCKS)) if used.any() else 1
    if total_tokens is None:
        total_tokens = int((most / t["target_share"])[used].min()) if used.any() else 0
    t["quota"] = sainte_lague(t["target_share"].to_numpy(), -(-total_tokens // block), -(-most.to_numpy() // block))
    return Plan(t, block)


def _shard_quotas(group: pd.DataFrame) -> pd.DataFrame:
    """Blocks and quotas of the shards of one source."""
    group = group.sort_values("shard")
    blocks = np.maximum(1, np.rint(group["tokens"] / group["block"])).astype("int64")
    given = sainte_lague(group["tokens"].to_numpy(), int(group["quota"].iloc[0]), (blocks * group["max_repeats"]).to_numpy())
    return pd.DataFrame({"source": group["source"], "shard": group["shard"], "tokens": group["tokens"], "blocks": blocks, "quota": given})


@dataclass
class Mix:
    """The chosen documents (doc_id, source, n_tokens, uses), with what they were chosen from."""

    documents: DataFrame
    per_source: DataFrame
    goals: DataFrame

    def shares(self) -> DataFrame:
        """Target and actual share of each source; the few sums are written once."""
        return _shares(self.documents, self.per_source, self.goals)


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, vocabulary: str = DEFAULT_VOCABULARY, shard_rows: int = SHARD_ROWS, block_tokens: int = BLOCK_TOKENS) -> Mix:
    """The mix of ``documents`` (doc_id, source, text) for ``targets`` (source, weight, max_repeats)."""
    sized = materialize(count_tokens(documents, ["doc_id", "source"], "text", vocabulary), "token_sizes")
    return mix_sized(sized, targets, total_tokens, seed, shard_rows, block_tokens)


def mix_sized(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, shard_rows: int = SHARD_ROWS, block_tokens: int = BLOCK_TOKENS) -> Mix:
    """The same of documents whose tokens are counted: (doc_id, source, n_tokens)."""
    spark = sized.sparkSession
    sized = sized.where("n_tokens > 0 and source is not null")
    target = targets.where("source is not null").groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    per_source = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("rows"))
    goal = target.toPandas()  # the table of targets is configuration: as many rows as sources to mix
    found = per_source.join(target, "source", "left_semi").toPandas()
    plan = plan_sources(found[["source", "available"]], goal, total_tokens, block_tokens)
    kept = plan.table[["source", "weight", "target_share", "max_repeats", "quota"]].merge(found[["source", "rows"]], on="source", how="left")
    kept["shards"] = np.maximum(1, -(-kept.pop("rows").fillna(0).astype("int64") // shard_rows))
    goals = spark.createDataFrame([tuple(r) for r in kept.astype(object).itertuples(index=False)], "source string, weight double, target_share double, max_repeats bigint, quota bigint, shards bigint")
    used = F.broadcast(goals.where("quota > 0").select("source", "max_repeats", "quota", "shards"))  # one row a target
    rows = sized.join(used, "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards")))
    totals = rows.groupBy("source", "shard", "max_repeats", "quota").agg(F.sum("n_tokens").alias("tokens")).withColumn("block", F.lit(plan.block))
    quotas = totals.groupBy("source").applyInPandas(_shard_quotas, "source string, shard bigint, tokens bigint, blocks bigint, quota bigint").where("quota > 0")
    order = W.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.select("doc_id", "source", "n_tokens", "shard").join(quotas, ["source", "shard"]).withColumn("stop", F.sum("n_tokens").over(order))
    middle = F.col("stop") - F.expr("n_tokens div 2") - 1
    own = F.least(F.floor(middle * F.col("blocks") / F.col("tokens")), F.col("blocks") - 1)
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.col("blocks"))
    turn = F.pmod(own - first, F.col("blocks"))
    uses = F.expr("quota div blocks") + (turn < F.col("quota") % F.col("blocks")).cast("int")
    chosen = placed.select("doc_id", "source", "n_tokens", uses.cast("int").alias("uses")).where("uses > 0")
    return Mix(chosen, per_source, goals)


def _shares(chosen: DataFrame, per_source: DataFrame, goals: DataFrame) -> DataFrame:
    taken = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("mixed_tokens"), F.count("*").alias("documents_used"), F.max("uses").alias("most_uses"))
    taken = materialize(taken, "taken")
    whole = taken.agg(F.sum("mixed_tokens")).scalar()
    return (
        goals.drop("quota", "shards")
        .join(per_source.drop("rows"), "source", "full")
        .join(taken, "source", "left")
        .select(
            "source",
            F.coalesce("weight", F.lit(0.0)).alias("weight"),
            F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
            "max_repeats",
            F.coalesce("available", F.lit(0)).alias("available_tokens"),
            F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
            F.coalesce(F.col("mixed_tokens") / whole, F.lit(0.0)).alias("actual_share"),
            F.coalesce("documents_used", F.lit(0)).alias("documents_used"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        )
    )
