"""Row and table contracts. Each returns the input plus violations, or violation rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import calendar
from barloom.operators.segments import running_in_parts
from barloom.schemas import PRICE_FIELDS


def with_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``violations``: the names of the rules a row breaks. NULL counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def split(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the others with their violations."""
    judged = with_violations(df, rules)
    clean = F.size("violations") == 0
    return judged.filter(clean).drop("violations"), judged.filter(~clean)


def bar_rules() -> dict[str, Column]:
    """One daily bar."""
    c = F.col
    return {
        "open_before_close": c("session_open_at") < c("session_close_at"),
        "available_after_close": c("available_at") >= c("session_close_at"),
        "high_at_least_low": c("high") >= c("low"),
        "open_in_range": c("open").between(c("low"), c("high")),
        "close_in_range": c("close").between(c("low"), c("high")),
        "positive_prices": F.least(*PRICE_FIELDS) > 0,
        "non_negative_volume": c("volume") >= 0,
        "source_named": F.length("source").between(1, 128),
    }


def session_rules() -> dict[str, Column]:
    """One trading session."""
    return {"open_before_close": F.col("session_open_at") < F.col("session_close_at")}


def period_rules() -> dict[str, Column]:
    """One weekly or monthly bar."""
    c = F.col
    frequency = c("frequency")
    start, end = c("period_start"), c("period_end")
    weekly = (F.weekday(start) == 0) & (end == F.date_add(start, 6))
    monthly = (start == F.trunc(start, "month")) & (end == F.last_day(start))
    return {
        "period_bounds": F.when(frequency == calendar.WEEK, weekly)
        .when(frequency == calendar.MONTH, monthly)
        .otherwise(False),
        "sessions_in_period": (c("first_session") >= start) & (c("last_session") <= end),
        "constituents_within_expected": c("constituent_count").between(1, c("expected_count")),
        "available_after_close": c("available_at") >= c("period_close_at"),
        "available_by_cutoff": c("available_at") <= c("cutoff_at"),
        "high_at_least_low": c("high") >= c("low"),
        "open_in_range": c("open").between(c("low"), c("high")),
        "close_in_range": c("close").between(c("low"), c("high")),
    }


def target_rules() -> dict[str, Column]:
    """One target position."""
    return {
        "effective_after_decision": F.col("effective_at") > F.col("decision_at"),
        "long_or_flat": F.col("weight").isin(0, 1),
    }


def schedule_violations(sessions: DataFrame, calendars: DataFrame) -> DataFrame:
    """Calendar contract: range, local-date labels, strict order without overlap.

    ``calendars`` has calendar_id, timezone, label_policy, requested_start, requested_end.
    Labels are compared in the calendar's own time zone.
    """
    order = Window.partitionBy("calendar_id").orderBy("session", "session_open_at")
    instant = F.when(F.col("label_policy") == "close_local_date", F.col("session_close_at")).when(
        F.col("label_policy") == "open_local_date", F.col("session_open_at")
    )
    local = F.to_date(F.from_utc_timestamp(instant, F.col("timezone")))
    judged = with_violations(
        sessions.join(calendars, "calendar_id").withColumns(
            {
                "_last_session": F.lag("session").over(order),
                "_last_close": F.lag("session_close_at").over(order),
            }
        ),
        {
            **session_rules(),
            "inside_requested_range": F.col("session").between(
                F.col("requested_start"), F.col("requested_end")
            ),
            "label_is_local_date": local.isNull() | (F.col("session") == local),
            "strictly_ordered": F.col("_last_session").isNull()
            | (F.col("session") > F.col("_last_session")),
            "no_overlap": F.col("_last_close").isNull()
            | (F.col("session_open_at") > F.col("_last_close")),
        },
    )
    return judged.filter(F.size("violations") > 0).select(
        "calendar_id", "session", "violations"
    )


def engine_input_violations(bars: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets of a backtest: known weight, one per instant, on an existing open."""
    opens = bars.select("asset_id", F.col("session_open_at").alias("effective_at")).distinct()
    keyed = targets.select("asset_id", "effective_at", "weight")

    def rule(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("asset_id", "effective_at", F.lit(name).alias("rule"))

    repeated = keyed.groupBy("asset_id", "effective_at").count().filter("count > 1")
    return (
        rule(keyed.filter(~F.col("weight").isin(0, 1)), "weight_not_long_flat")
        .unionByName(rule(repeated, "duplicate_effective_at"))
        .unionByName(
            rule(keyed.join(opens, ["asset_id", "effective_at"], "left_anti"), "no_such_open")
        )
        .unionByName(
            rule(
                bars.groupBy("asset_id", F.col("session_open_at").alias("effective_at"))
                .count()
                .filter("count > 1"),
                "duplicate_bar",
            )
        )
    )


def interval_violations(intervals: DataFrame, releases: DataFrame) -> DataFrame:
    """Eligible intervals: ordered, disjoint, inside the schedule, distinct reports.

    ``intervals`` has release_id, start_session, end_session, session_count, report_id;
    ``releases`` has release_id, schedule_start, schedule_end, schedule_count.
    """
    joined = intervals.join(releases, "release_id").withColumns(
        {
            "_order": F.struct("start_session", "end_session", "report_id"),
            "_part": F.coalesce(F.year("start_session"), F.lit(0)),
        }
    )
    # An interval must start after every earlier one has ended: a running maximum, cut by the year it starts in.
    before = (Window.unboundedPreceding, -1)
    joined = running_in_parts(joined, ["release_id"], "_part", "_order", {"_last_end": ("max", F.col("end_session"))}, before)
    rows = with_violations(
        joined,
        {
            "start_before_end": F.col("start_session") <= F.col("end_session"),
            "inside_schedule": (F.col("start_session") >= F.col("schedule_start"))
            & (F.col("end_session") <= F.col("schedule_end")),
            "disjoint": F.col("_last_end").isNull()
            | (F.col("start_session") > F.col("_last_end")),
            "counts_sessions": F.col("session_count") >= 1,
        },
    ).select("release_id", "start_session", F.explode("violations").alias("rule"))
    totals = (
        joined.groupBy("release_id")
        .agg(
            F.sum("session_count").alias("_sum"),
            F.max("schedule_count").alias("_max"),
        )
        .filter(F.col("_sum") > F.col("_max"))
        .select(
            "release_id",
            F.lit(None).cast("date").alias("start_session"),
            F.lit("more_sessions_than_schedule").alias("rule"),
        )
    )
    reports = (
        intervals.groupBy("release_id", "report_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("start_session").alias("start_session"))
        .filter(F.col("n") > 1)
        .select("release_id", "start_session", F.lit("repeated_report").alias("rule"))
    )
    return rows.unionByName(totals).unionByName(reports)


def supported_ranges(consumed: DataFrame, intervals: DataFrame) -> DataFrame:
    """Flag consumed ranges that lie wholly inside one eligible interval.

    ``consumed`` has release_id, first_session, last_session. Intervals are listed under each
    year they touch, so the join is an equi-join on (release, year) and a release with many
    ranges spreads over its years.
    """
    by_year = intervals.select(
        "release_id",
        "start_session",
        "end_session",
        F.explode(F.sequence(F.year("start_session"), F.year("end_session"))).alias("_year"),
    )
    inside = (
        consumed.withColumn("_year", F.year("first_session"))
        .join(by_year, ["release_id", "_year"])
        .filter(
            (F.col("start_session") <= F.col("first_session"))
            & (F.col("first_session") <= F.col("last_session"))
            & (F.col("last_session") <= F.col("end_session"))
        )
        .select("release_id", "first_session", "last_session")
        .distinct()
        .withColumn("supported", F.lit(True))
    )
    return consumed.join(
        inside, ["release_id", "first_session", "last_session"], "left"
    ).withColumn("supported", F.coalesce("supported", F.lit(False)))
