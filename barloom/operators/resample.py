"""Weekly and monthly bars out of daily bars and an independent calendar."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import calendar
from barloom.operators.alignment import align, cover_violations
from barloom.operators.calendars import with_calendar_id

COMPLETE = "complete"
PARTIAL_CUTOFF = "partial_cutoff"
MISSING_DATA = "incomplete_missing_data"


def expected_periods(sessions: DataFrame, frequency: str) -> DataFrame:
    """One row per calendar period with its sessions (at most 31, so arrays are safe)."""
    start = calendar.period_start(F.col("session"), frequency)
    item = F.struct("session", "session_close_at")
    periods = sessions.groupBy("calendar_id", start.alias("period_start")).agg(
        F.count(F.lit(1)).alias("expected_count"),
        F.min("session").alias("expected_first_session"),
        F.max("session").alias("expected_last_session"),
        F.min("session_close_at").alias("first_close_at"),
        F.array_sort(F.collect_list(item)).alias("_items"),
    )
    return periods.select(
        "calendar_id",
        "period_start",
        calendar.period_end(F.col("period_start"), frequency).alias("period_end"),
        "expected_count",
        "expected_first_session",
        "expected_last_session",
        "first_close_at",
        F.col("_items.session_close_at").alias("expected_closes"),
        F.sha2(F.array_join(F.col("_items.session").cast("array<string>"), ","), 256).alias(
            "expected_hash"
        ),
    )


def period_bars(
    bars: DataFrame, sessions: DataFrame, frequency: str, cutoff_at: dt.datetime
) -> DataFrame:
    """Aggregate daily bars into periods and grade each period's completeness.

    A complete period is stamped with the availability of its own bars, any other with the
    caller's cutoff. An omitted session whose close the cutoff has reached means missing data.
    Periods without bars yield no row; see :func:`resample_violations`. A period that the series' calendar does not
    know at all has no expected session and is never complete.
    """
    start = calendar.period_start(F.col("session"), frequency)
    keyed = with_calendar_id(bars, sessions)
    observed = keyed.groupBy("asset_id", "source", "calendar_id", start.alias("period_start")).agg(
        F.min_by("open", "session").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "session").alias("close"),
        F.sum("volume").cast("decimal(24,6)").alias("volume"),
        F.min("session").alias("first_session"),
        F.max("session").alias("last_session"),
        F.min("session_open_at").alias("period_open_at"),
        F.max("session_close_at").alias("period_close_at"),
        F.max("available_at").alias("available_at"),
        F.count(F.lit(1)).alias("constituent_count"),
    )
    expected = expected_periods(sessions, frequency).drop("period_end")
    joined = observed.join(expected, ["calendar_id", "period_start"], "left").withColumns(
        {
            "expected_count": F.coalesce("expected_count", F.lit(0)),
            "period_end": calendar.period_end(F.col("period_start"), frequency),
        }
    )
    whole = F.col("constituent_count") == F.col("expected_count")
    cutoff = F.lit(cutoff_at).cast("timestamp")
    omitted_close = F.try_element_at(
        "expected_closes", (F.col("constituent_count") + 1).cast("int")
    )
    return joined.select(
        "asset_id",
        "source",
        "calendar_id",
        F.lit(frequency).alias("frequency"),
        "period_start",
        "period_end",
        "first_session",
        "last_session",
        "open",
        "high",
        "low",
        "close",
        "volume",
        "period_open_at",
        "period_close_at",
        "available_at",
        F.when(whole, F.col("available_at")).otherwise(cutoff).alias("cutoff_at"),
        "constituent_count",
        "expected_count",
        F.when(whole, COMPLETE)
        .when(cutoff < omitted_close, PARTIAL_CUTOFF)
        .otherwise(MISSING_DATA)
        .alias("completeness"),
        "expected_hash",
    )


def resample_violations(
    bars: DataFrame, sessions: DataFrame, frequency: str, cutoff_at: dt.datetime
) -> DataFrame:
    """Why a series must not be resampled: gaps, late bars, elapsed periods without bars."""
    cutoff = F.lit(cutoff_at).cast("timestamp")
    late = bars.filter(F.col("available_at") > cutoff).select(
        "asset_id",
        F.lit("bar_after_cutoff").alias("rule"),
        "session",
        F.date_format("available_at", "yyyy-MM-dd HH:mm:ss").alias("detail"),
    )
    order = Window.partitionBy("calendar_id").orderBy("period_start")  # one row per period
    upcoming = expected_periods(sessions, frequency).select(
        "calendar_id",
        "period_start",
        F.lead("period_start").over(order).alias("next_start"),
        F.lead("first_close_at").over(order).alias("next_first_close"),
    )
    last = with_calendar_id(bars, sessions).groupBy("asset_id", "calendar_id").agg(
        calendar.period_start(F.max("session"), frequency).alias("period_start")
    )
    elapsed = (
        last.join(upcoming, ["calendar_id", "period_start"])
        .filter(F.col("next_first_close") <= cutoff)
        .select(
            "asset_id",
            F.lit("elapsed_period_without_bars").alias("rule"),
            F.col("next_start").alias("session"),
            F.date_format("next_start", "yyyy-MM-dd").alias("detail"),
        )
    )
    return cover_violations(align(bars, sessions)).unionByName(late).unionByName(elapsed)


def constituent_violations(
    bars: DataFrame, sessions: DataFrame, frequency: str, cutoff_at: dt.datetime
) -> DataFrame:
    """Periods whose bars are not the first sessions of the period, in time and each once.

    ``not_a_prefix``: the sessions of the bars are not exactly the first that the series' calendar expects of the period (a
    hole, a strange or a repeated session; a period that only lacks its end is sound). The calendar has the digest of every
    prefix of a period, at most 31, and the bars' own digest is compared with the one at their count. ``available_before_close``
    and ``available_after_cutoff`` judge every bar. ``session`` is the start of the period, ``detail`` how many bars.
    """
    start = calendar.period_start(F.col("session"), frequency)
    keys = ["calendar_id", "period_start"]
    expected = sessions.groupBy("calendar_id", start.alias("period_start")).agg(
        F.array_sort(F.collect_set("session")).alias("_days")
    )
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size("_days")), lambda k: _sessions_digest(F.slice("_days", F.lit(1), k))
    )
    expected = expected.select(*keys, prefixes.alias("_prefixes"))
    cutoff = F.lit(cutoff_at).cast("timestamp")
    days = with_calendar_id(bars, sessions).groupBy("asset_id", "calendar_id", start.alias("period_start"), "session").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("available_at") < F.col("session_close_at")).alias("_early"),
        F.count_if(F.col("available_at") > cutoff).alias("_late"),
    )
    # Repeated bars are counted by session first, so a period never lists more than its dates.
    held = days.groupBy("asset_id", *keys).agg(
        F.array_sort(F.collect_list("session")).alias("_held"),
        F.sum("_n").alias("_count"),
        F.sum("_early").alias("_early"),
        F.sum("_late").alias("_late"),
    )
    joined = held.join(expected, keys, "left")
    at_count = F.get("_prefixes", (F.col("_count") - 1).cast("int"))
    broken = ~_sessions_digest(F.col("_held")).eqNullSafe(at_count)
    rules = F.array_compact(
        F.array(
            *[
                F.when(hit, F.struct(F.lit(rule).alias("rule"), n.alias("n")))
                for rule, hit, n in (
                    ("not_a_prefix", broken, F.col("_count")),
                    ("available_before_close", F.col("_early") > 0, F.col("_early")),
                    ("available_after_cutoff", F.col("_late") > 0, F.col("_late")),
                )
            ]
        )
    )
    return joined.select("asset_id", F.col("period_start").alias("session"), F.inline(rules)).select(
        "asset_id", "rule", "session", F.col("n").cast("string").alias("detail")
    )


def _sessions_digest(days: Column) -> Column:
    return F.sha2(F.array_join(days.cast("array<string>"), ","), 256)


def boundary_violations(
    sessions: DataFrame, calendars: DataFrame, frequency: str
) -> DataFrame:
    """Calendars whose requested range does not begin and end with whole periods.

    ``calendars`` has calendar_id, requested_start, requested_end.
    """
    span = sessions.groupBy("calendar_id").agg(
        calendar.period_start(F.min("session"), frequency).alias("first_start"),
        calendar.period_end(F.max("session"), frequency).alias("last_end"),
    )
    return span.join(calendars, "calendar_id").filter(
        (F.col("requested_start") != F.col("first_start"))
        | (F.col("requested_end") != F.col("last_end"))
    ).select("calendar_id", "requested_start", "requested_end", "first_start", "last_end")


def complete_only(periods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split off every period that is not complete."""
    whole = F.col("completeness") == COMPLETE
    offenders = periods.filter(~whole).select(
        "asset_id",
        F.lit("incomplete_period").alias("rule"),
        F.col("period_start").alias("session"),
        F.col("completeness").alias("detail"),
    )
    return periods.filter(whole), offenders


def period_violations(periods: DataFrame, sessions: DataFrame, frequency: str) -> DataFrame:
    """Contract of a period series as strategy input.

    Every period complete, of the wanted frequency, consecutive, and built on exactly the
    sessions the independent calendar has for it.
    """
    _, incomplete = complete_only(periods)
    order = Window.partitionBy("asset_id").orderBy("period_start")
    wrong = periods.filter(F.col("frequency") != frequency).select(
        "asset_id",
        F.lit("wrong_frequency").alias("rule"),
        F.col("period_start").alias("session"),
        F.col("frequency").alias("detail"),
    )
    gaps = (
        periods.select(
            "asset_id", "period_start", F.lag("period_start").over(order).alias("previous")
        )
        .filter(
            F.col("previous").isNotNull()
            & (F.col("period_start") != calendar.next_period_start(F.col("previous"), frequency))
        )
        .select(
            "asset_id",
            F.lit("period_gap").alias("rule"),
            F.col("period_start").alias("session"),
            F.date_format("previous", "yyyy-MM-dd").alias("detail"),
        )
    )
    independent = expected_periods(sessions, frequency).select(
        "calendar_id", "period_start", F.col("expected_hash").alias("calendar_hash")
    )
    foreign = (
        with_calendar_id(periods, sessions)
        .join(independent, ["calendar_id", "period_start"], "left")
        .filter(~F.col("expected_hash").eqNullSafe(F.col("calendar_hash")))
        .select(
            "asset_id",
            F.lit("calendar_mismatch").alias("rule"),
            F.col("period_start").alias("session"),
            F.coalesce("calendar_hash", F.lit("no such period")).alias("detail"),
        )
    )
    return incomplete.unionByName(wrong).unionByName(gaps).unionByName(foreign)
