"""Bars against the calendar: positions, cover checks, next open."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.calendar import number_sessions
from barloom.operators.calendars import SESSION_KEY, with_calendar_id
from barloom.operators.segments import layout_for


@dataclass(frozen=True)
class Aligned:
    """Bars of the series that cover their calendar, and why other series do not."""

    bars: DataFrame
    violations: DataFrame
    size: int | None


def align(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Attach calendar position and next open to each bar; unknown sessions keep NULLs.

    Bars with a ``calendar_id`` meet the sessions of their own calendar only, so one bar stays one row however many
    calendars there are; see :func:`barloom.operators.calendars.with_calendar_id` for bars without.
    """
    numbered = number_sessions(sessions).select(
        *SESSION_KEY,
        "session_no",
        "next_session",
        "next_open_at",
        "calendar_size",
        F.col("session_open_at").alias("_calendar_open_at"),
        F.col("session_close_at").alias("_calendar_close_at"),
    )
    joined = with_calendar_id(bars, sessions).join(numbered, [*SESSION_KEY], "left")
    return joined.select(
        *bars.columns,
        "session_no",
        "next_session",
        "next_open_at",
        "calendar_size",
        (
            (F.col("session_open_at") != F.col("_calendar_open_at"))
            | (F.col("session_close_at") != F.col("_calendar_close_at"))
        ).alias("_shifted"),
    )


def cover(bars: DataFrame, sessions: DataFrame, *, exact: bool = False) -> Aligned:
    """Keep the series whose bars are a calendar prefix (``exact``: the whole calendar).

    The check is an aggregate, so it never holds a series in one place. Series that pass have
    one bar per session, which bounds every later window by the calendar.
    """
    aligned = align(bars, sessions)
    found = cover_violations(aligned, exact=exact)
    kept = aligned.join(found.select("asset_id").distinct(), "asset_id", "left_anti")
    return Aligned(kept.drop("_shifted", "calendar_size"), found, layout_for(sessions))


def cover_summary(aligned: DataFrame) -> DataFrame:
    """One row per series: how its bars relate to the calendar."""
    days = aligned.groupBy("asset_id", "session").agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set("source").alias("sources"),  # the handful of sources of one bar
        F.max("session_no").alias("no"),
        F.max("calendar_size").alias("calendar_size"),
        F.count_if("_shifted").alias("shifted"),
    )
    return days.groupBy("asset_id").agg(
        F.count_if(F.col("no").isNull()).alias("unexpected_count"),
        F.sum("shifted").alias("shifted_count"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicate_count"),
        F.size(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("source_count"),
        F.count("no").alias("covered"),
        F.max("no").alias("last_no"),
        F.max("session").alias("last_session"),
        F.max("calendar_size").alias("calendar_size"),
    )


def cover_violations(aligned: DataFrame, *, exact: bool = False) -> DataFrame:
    """Why a series is not a prefix of the calendar (or, if ``exact``, all of it)."""
    summary = cover_summary(aligned)
    excess = {
        "unexpected_session": F.col("unexpected_count"),
        "shifted_session": F.col("shifted_count"),
        "duplicate_session": F.col("duplicate_count"),
        "missing_session": F.col("last_no") + 1 - F.col("covered"),
        "mixed_sources": F.col("source_count") - 1,
    }
    if exact:
        excess["calendar_not_covered"] = F.col("calendar_size") - F.col("covered")
    rules = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), n.cast("long").alias("n"))
            for rule, n in excess.items()
        ]
    )
    return (
        summary.select("asset_id", F.col("last_session").alias("session"), F.inline(rules))
        .filter("n > 0")
        .select("asset_id", "rule", "session", F.col("n").cast("string").alias("detail"))
    )
