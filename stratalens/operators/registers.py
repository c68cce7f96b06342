"""Virtual tables of registers: balances, turnovers and slices.

These are our definitions: a balance has the records up to and including the
moment, balances of zero don't show, turnovers have both bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PERIODS = ("record", "day", "week", "month", "quarter", "year")
_STEPS = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}


@dataclass(frozen=True)
class Accumulation:
    """A register of movements: when, by what, how much, and the SQL condition of an expense (never null)."""

    period: str
    dimensions: tuple[str, ...]
    resource: str
    expense: str

    def signed(self, df: DataFrame) -> DataFrame:
        """Movements as exact numbers, receipts and expenses apart. Rows without period or resource don't move anything."""
        amount, expense = F.col(self.resource).cast("decimal(18,4)"), F.expr(self.expense)
        own = df.where(F.col(self.period).isNotNull() & amount.isNotNull())
        return own.select(*self.dimensions, F.col(self.period).alias("period"), F.when(~expense, amount).otherwise(0).alias("receipt"), F.when(expense, amount).otherwise(0).alias("expense"))


def balance(df: DataFrame, register: Accumulation, at: str) -> DataFrame:
    """(dimensions, balance) at a moment."""
    moved = register.signed(df).where(F.col("period") <= F.lit(at).cast("timestamp"))
    return moved.groupBy(*register.dimensions).agg(F.sum(F.col("receipt") - F.col("expense")).alias("balance")).where("balance != 0")


def turnovers(df: DataFrame, register: Accumulation, start: str, end: str, unit: str = "month") -> DataFrame:
    """(dimensions, period, receipt, expense, turnover) of each period with movements."""
    if unit not in PERIODS:
        raise ValueError(f"no period {unit}")
    moved = register.signed(df).where(F.col("period").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    period = F.col("period") if unit == "record" else F.date_trunc(unit, "period")
    out = moved.groupBy(*register.dimensions, period.alias("period")).agg(F.sum("receipt").alias("receipt"), F.sum("expense").alias("expense"))
    return out.withColumn("turnover", F.col("receipt") - F.col("expense"))


def balance_and_turnovers(df: DataFrame, register: Accumulation, start: str, end: str, unit: str = "month", fill: bool = False) -> DataFrame:
    """(dimensions, period, opening, receipt, expense, turnover, closing).

    With ``fill`` every period between the bounds comes out, else those with
    movements. Movements before the start make the opening balance.
    """
    dims = list(register.dimensions)
    moved = register.signed(df).where(F.col("period") <= F.lit(end).cast("timestamp"))
    before = F.col("period") < F.lit(start).cast("timestamp")
    # the opening balance stands in a period of its own, before all others
    own = moved.groupBy(*dims, F.when(~before, F.date_trunc(unit, "period")).alias("period")).agg(F.sum("receipt").alias("receipt"), F.sum("expense").alias("expense"))
    if fill:
        every = F.explode(F.sequence(F.date_trunc(unit, F.lit(start).cast("timestamp")), F.date_trunc(unit, F.lit(end).cast("timestamp")), F.expr(_STEPS[unit])))
        empty = F.lit(0).cast("decimal(28,4)")
        blank = own.select(*dims).distinct().select(*dims, every.alias("period"), empty.alias("receipt"), empty.alias("expense"))
        own = own.unionByName(blank).groupBy(*dims, "period").agg(F.sum("receipt").alias("receipt"), F.sum("expense").alias("expense"))
    running = F.sum(F.col("receipt") - F.col("expense")).over(W.partitionBy(*dims).orderBy(F.asc_nulls_first("period")).rowsBetween(W.unboundedPreceding, W.currentRow))
    out = own.withColumns({"turnover": F.col("receipt") - F.col("expense"), "closing": running}).where("period is not null")
    return out.select(*dims, "period", (F.col("closing") - F.col("turnover")).alias("opening"), "receipt", "expense", "turnover", "closing")


def slice_last(df: DataFrame, period: str, dimensions: list[str], tie: list[str], columns: list[str], at: str | None = None) -> DataFrame:
    """The last record of each combination of dimensions up to a moment; ties end by ``tie``."""
    own = df if at is None else df.where(F.col(period) <= F.lit(at).cast("timestamp"))
    rest = [c for c in dict.fromkeys([*tie, *columns]) if c not in (*dimensions, period)]
    last = own.where(F.col(period).isNotNull()).groupBy(*dimensions).agg(F.max(F.struct(period, *rest)).alias("x"))
    return last.select(*dimensions, *[F.col(f"x.{c}").alias(c) for c in (period, *rest)])


def slice_first(df: DataFrame, period: str, dimensions: list[str], tie: list[str], columns: list[str], at: str | None = None) -> DataFrame:
    """The first record from a moment on."""
    own = df if at is None else df.where(F.col(period) >= F.lit(at).cast("timestamp"))
    rest = [c for c in dict.fromkeys([*tie, *columns]) if c not in (*dimensions, period)]
    first = own.where(F.col(period).isNotNull()).groupBy(*dimensions).agg(F.min(F.struct(period, *rest)).alias("x"))
    return first.select(*dimensions, *[F.col(f"x.{c}").alias(c) for c in (period, *rest)])
