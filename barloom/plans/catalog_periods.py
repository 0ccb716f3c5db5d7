"""Registered queries on weekly and monthly bars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.calendar import MONTH, WEEK
from barloom.functions.identity import period_payload, signal_payload, stable_id
from barloom.operators import calendars, momentum
from barloom.operators.alignment import align, cover, cover_violations
from barloom.operators.backtest import Costs, backtest
from barloom.operators.resample import (
    boundary_violations,
    complete_only,
    constituent_violations,
    period_bars,
    period_violations,
    resample_violations,
)
from barloom.plans import strategies, views
from barloom.plans.publish import publish
from barloom.session import materialize

FAR = dt.datetime(2100, 1, 1)
LAST_DAY = "2001-06-13"
CUT_EARLY = dt.datetime(2001, 6, 14, 12, 0)
CUT_LATE = dt.datetime(2001, 6, 16, 0, 0)
COLUMNS = (
    "asset_id", "period_start", "period_end", "open", "high", "low", "close", "volume",
    "available_at", "constituent_count", "expected_count", "completeness",
)
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _periods(spark, sf_dir, frequency, *, after=None):
    bars, sessions = views.market(spark, sf_dir, after=after)
    return period_bars(bars, sessions, frequency, FAR), sessions


@query
def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish(_periods(spark, sf_dir, WEEK)[0].select(*COLUMNS))


@query
def monthly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish(_periods(spark, sf_dir, MONTH)[0].select(*COLUMNS))


@query
def period_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars end on a Wednesday: partial before the next close, missing data after it."""
    bars, sessions = views.market(spark, sf_dir)
    known = bars.filter(F.col("session") <= LAST_DAY)
    parts = [
        period_bars(known, sessions, frequency, cutoff).withColumn("case", F.lit(name))
        for frequency in (WEEK, MONTH)
        for name, cutoff in ((f"{frequency} early", CUT_EARLY), (f"{frequency} late", CUT_LATE))
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return publish(
        every.select(
            "case", "asset_id", "period_start", "cutoff_at", "constituent_count",
            "expected_count", "completeness",
        )
    )


@query
def incomplete_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, sessions = views.market(spark, sf_dir)
    known = bars.filter(F.col("session") <= LAST_DAY)
    return publish(complete_only(period_bars(known, sessions, MONTH, CUT_LATE))[1])


@query
def resample_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset ends weeks early, one has a hole, one runs past the cutoff."""
    bars, sessions = views.market(spark, sf_dir)
    a, s = F.col("asset_id"), F.col("session")
    broken = bars.filter(
        ((a == "A") & (s <= "2001-05-01"))
        | ((a == "N") & (s <= LAST_DAY) & (F.datediff(s, F.lit("1995-01-01").cast("date")) % 97 != 0))
        | ((a == "R") & (s <= "2001-06-20"))
    )
    return publish(resample_violations(broken, sessions, WEEK, CUT_LATE))


@query
def cover_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bars against the days on which every asset trades, and against all days."""
    bars = views.bars_table(spark, sf_dir)
    common = cover_violations(align(bars, views.common_days(bars)), exact=True)
    every = cover_violations(align(bars, views.all_days(bars)), exact=True)
    return publish(
        common.withColumn("calendar", F.lit("common")).unionByName(
            every.withColumn("calendar", F.lit("all days"))
        )
    )


CHANGE = "1998-01-01"


def _followed(spark, sf_dir):
    """One asset on weekdays, one on all days, and the others change from the first to the second."""
    bars = views.bars_table(spark, sf_dir)
    both = views.all_days(bars, weekdays_only=True).withColumn("calendar_id", F.lit("WEEKDAYS")).unionByName(
        views.all_days(bars).withColumn("calendar_id", F.lit("ALL"))
    )
    a, never, change = F.col("asset_id"), F.lit(None).cast("date"), F.lit(CHANGE).cast("date")

    def entry(name, start, end):
        return F.struct(F.lit(name).alias("calendar_id"), start.alias("valid_from"), end.alias("valid_to"))

    entries = (
        F.when(a == "N", F.array(entry("WEEKDAYS", never, never)))
        .when(a == "R", F.array(entry("ALL", never, never)))
        .otherwise(F.array(entry("WEEKDAYS", never, change), entry("ALL", change, never)))
    )
    mapping = bars.select("asset_id").distinct().select("asset_id", F.inline(entries))
    return bars, calendars.compile_calendars(mapping, both)


@query
def two_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars against two calendars and a change between them, both sides stored in buckets of (calendar, session)."""
    bars, followed = _followed(spark, sf_dir)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = calendars.bucketed(calendars.assigned(bars, followed), calendars.SESSION_KEY, buckets, "keyed-bars")
    sessions = calendars.bucketed(followed.sessions, calendars.SESSION_KEY, buckets, "keyed-sessions")
    found = align(kept, sessions)
    return publish(found.select("asset_id", "calendar_id", "session", "session_no", "next_session"))


@query
def two_calendars_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the bars of each asset cover the calendar they follow."""
    bars, followed = _followed(spark, sf_dir)
    return publish(cover_violations(align(calendars.assigned(bars, followed), followed.sessions), exact=True))


@query
def targets_s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods, sessions = _periods(spark, sf_dir, WEEK, after=WEEK)
    return publish(strategies.dual_ma_targets(periods, sessions).clean())


@query
def targets_s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods, sessions = _periods(spark, sf_dir, MONTH, after=MONTH)
    return publish(strategies.period_sma_targets(periods, sessions).clean())


@query
def signals_s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods, _ = _periods(spark, sf_dir, MONTH)
    return publish(momentum.momentum_selection(periods), strongest_return=8, weakest_return=8)


@query
def signals_s5_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly two series, one of which starts as a copy of the other (an exact tie)."""
    periods, _ = _periods(spark, sf_dir, MONTH)
    pair = periods.filter(F.col("asset_id").isin("A", "N"))
    copy = (F.col("asset_id") == "N") & (F.col("period_start") < "1997-01-01")
    early = pair.filter((F.col("asset_id") == "A") & (F.col("period_start") < "1997-01-01"))
    tied = pair.filter(~copy).unionByName(early.withColumn("asset_id", F.lit("N")))
    return publish(momentum.momentum_selection(tied), strongest_return=8, weakest_return=8)


@query
def momentum_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two months taken out of one asset, and one descriptor with other semantics."""
    periods, _ = _periods(spark, sf_dir, MONTH)
    holes = periods.filter(
        ~(
            (F.col("asset_id") == "N")
            & F.col("period_start").between("1998-03-01", "1998-04-01")
        )
    )
    descriptors = (
        views.bars_table(spark, sf_dir)
        .select("asset_id")
        .distinct()
        .select(
            "asset_id",
            F.lit(MONTH).alias("frequency"),
            F.when(F.col("asset_id") == "R", "raw").otherwise("total_return").alias("adjustment_mode"),
            F.lit("LINE").alias("calendar_id"),
        )
    )
    return publish(momentum.alignment_violations(holes, descriptors))


@query
def period_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly series with an incomplete week, a dropped week and a foreign calendar."""
    bars, sessions = views.market(spark, sf_dir)
    known = bars.filter((F.col("session") <= LAST_DAY) | (F.col("asset_id") != "A"))
    weeks = period_bars(known, sessions, WEEK, CUT_LATE).filter(
        ~((F.col("asset_id") == "N") & (F.col("period_start") == "1999-06-07"))
    )
    weeks = weeks.filter((F.col("asset_id") != "A") | (F.col("period_start") <= LAST_DAY))
    plain = sessions.select("calendar_id", "session", "session_open_at", "session_close_at")
    fewer = plain.filter(F.col("session") != "1998-02-11")
    return publish(
        period_violations(weeks, fewer, WEEK).withColumn(
            "detail", F.when(F.col("rule") != "calendar_mismatch", F.col("detail"))
        )
    )


@query
def period_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks with holes, with bars on days of another session, and with early and late bars, in one asset each."""
    bars, sessions = views.market(spark, sf_dir)
    a, d = F.col("asset_id"), F.col("d")
    planted = (
        bars.withColumn("d", views.day_number())
        .filter(~((a == "A") & (d % 97 == 0)))
        .withColumns(
            {
                # Two bars on one day and none on the day of the second.
                "session": F.when((a == "N") & (d % 89 == 0), F.date_sub("session", 1)).otherwise(F.col("session")),
                "available_at": F.when((a == "R") & (d % 83 == 0), F.col("session_close_at") - F.expr("interval 1 minute"))
                .when((a == "R") & (d % 79 == 0), F.lit(FAR).cast("timestamp") + F.expr("interval 1 day"))
                .otherwise(F.col("available_at")),
            }
        )
        .drop("d")
    )
    return publish(constituent_violations(planted, sessions, WEEK, FAR))


@query
def weekly_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly targets executed on daily bars."""
    bars, sessions = views.market(spark, sf_dir, after=WEEK)
    targets = strategies.dual_ma_targets(period_bars(bars, sessions, WEEK, FAR), sessions).clean()
    covered = cover(bars, sessions)
    run = backtest(
        covered.bars, materialize(targets, "weekly-targets"), (Costs("weekly", 10_000, 10, 5),),
        size=covered.size,
    )
    return publish(run.totals, significant=("final_equity", "total_commission", "total_slippage"))


@query
def period_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content ids of monthly bars."""
    periods, _ = _periods(spark, sf_dir, MONTH)
    return publish(
        periods.select(
            "asset_id", "period_start", stable_id("period-bar", period_payload()).alias("period_bar_id")
        )
    )


@query
def signal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content ids of momentum signals, after their own contract check."""
    periods, _ = _periods(spark, sf_dir, MONTH)
    signals = momentum.momentum_selection(periods)
    broken = momentum.signal_violations(signals)
    sound = signals.join(broken.select("period_start"), "period_start", "left_anti")
    return publish(
        sound.select(
            "period_start", stable_id("dual-momentum-signal", signal_payload()).alias("signal_id")
        )
    )


@query
def range_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requested range that cuts its first and last week."""
    _, sessions = views.market(spark, sf_dir)
    ranges = sessions.groupBy("calendar_id").agg(
        F.min("session").alias("requested_start"), F.max("session").alias("requested_end")
    )
    return publish(boundary_violations(sessions, ranges, MONTH))
