"""Event log reads with strict filters, and windows over the events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions.text import clamp_limit

DEFAULT_DAYS = 7
DEFAULT_LIMIT, MOST_LIMIT = 50, 500


def _moment(value: str | dt.datetime | None, end: bool = False) -> dt.datetime | None:
    """A moment from ISO text; a day alone is its beginning, or its end. Anything else is refused."""
    if value is None or isinstance(value, dt.datetime):
        return value
    moment = dt.datetime.fromisoformat(value)
    return moment + dt.timedelta(days=1, microseconds=-1) if end and len(value) == 10 else moment


def filtered(events: DataFrame, start=None, end=None, level: str | None = None, user: int | None = None, now: dt.datetime | None = None) -> DataFrame:
    """Events between two moments (included), of a level and a user.

    Without start it is seven days before ``now``. A filter that can't be used is
    refused, never left out: text that is no moment, an end before the start, a
    level or user the log doesn't have.
    """
    start, end = _moment(start), _moment(end, True)
    if start is None:
        start = (now or dt.datetime.now(dt.UTC).replace(tzinfo=None)) - dt.timedelta(days=DEFAULT_DAYS)
    if end is not None and end < start:
        raise ValueError("the end is before the start")
    for name, value in (("event_type", level), ("user_id", user)):
        if value is not None:
            if events.where(F.col(name) == value).isEmpty():
                raise ValueError(f"no {name} {value}")
            events = events.where(F.col(name) == value)
    events = events.where(F.col("ts") >= F.lit(start))
    return events if end is None else events.where(F.col("ts") <= F.lit(end))


def page(events: DataFrame, limit: int | None = None) -> DataFrame:
    """The first events by moment and id."""
    return events.orderBy("ts", "event_id").limit(clamp_limit(limit, DEFAULT_LIMIT, MOST_LIMIT))


def total(events: DataFrame) -> DataFrame:
    """All events before any limit: (total, unit)."""
    return events.agg(F.count("*").alias("total")).withColumn("unit", F.lit("events"))


def page_with_total(events: DataFrame, limit: int | None = None) -> DataFrame:
    """The page with the number of all events beside each row, by a scalar subquery."""
    return page(events, limit).withColumn("total", events.agg(F.count("*")).scalar())


# --- windows


def per_window(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Events, values and users of each window and type; sliding ones if ``slide`` is given."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: events less than ``gap`` apart."""
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
