"""Date helpers: period bounds, session numbering, next session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEK = "1w"
MONTH = "1mo"


def period_start(day: Column, frequency: str) -> Column:
    """Monday of the week, or first day of the month."""
    return F.trunc(day, _unit(frequency))


def period_end(day: Column, frequency: str) -> Column:
    """Sunday of the week, or last day of the month."""
    if _unit(frequency) == "week":
        return F.date_add(F.trunc(day, "week"), 6)
    return F.last_day(day)


def next_period_start(start: Column, frequency: str) -> Column:
    return F.date_add(start, 7) if _unit(frequency) == "week" else F.add_months(start, 1)


NUMBERED = (
    "calendar_id",
    "session",
    "session_open_at",
    "session_close_at",
    "session_no",
    "next_session",
    "next_open_at",
    "calendar_size",
)


def number_sessions(sessions: DataFrame) -> DataFrame:
    """Number each calendar's sessions from zero and attach the session that follows.

    A calendar holds one row per day at most, so this window stays small however many bars
    the calendar serves. A stored calendar that already carries the numbers is used as it is.
    """
    if set(NUMBERED) <= set(sessions.columns):
        return sessions.select(*NUMBERED)
    order = Window.partitionBy("calendar_id").orderBy("session")
    return sessions.select(
        "calendar_id",
        "session",
        "session_open_at",
        "session_close_at",
        (F.row_number().over(order) - 1).cast("long").alias("session_no"),
        F.lead("session").over(order).alias("next_session"),
        F.lead("session_open_at").over(order).alias("next_open_at"),
        F.count(F.lit(1)).over(Window.partitionBy("calendar_id")).alias("calendar_size"),
    )


def _unit(frequency: str) -> str:
    units = {WEEK: "week", MONTH: "month"}
    if frequency not in units:
        raise ValueError("period bars need a weekly (1w) or monthly (1mo) frequency")
    return units[frequency]
