"""Long/flat strategies as DataFrame pipelines.

Every strategy has the form ``(bars, sessions, **params) -> Targets``. A series that breaks a
contract yields violation rows and no targets; the other series are unaffected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import calendar, features
from barloom.operators import segments
from barloom.operators.alignment import cover
from barloom.operators.calendars import with_calendar_id
from barloom.operators.resample import period_violations
from barloom.operators.rsi import with_wilder_rsi

KEY = ["asset_id"]
POSITION = "session_no"


class ContractViolation(ValueError):
    """Raised by the fail-closed forms when violation rows exist."""


def assert_clean(violations: DataFrame) -> None:
    """Fail closed: raise if there is any violation row."""
    first = violations.limit(1).collect()
    if first:
        raise ContractViolation(str(first[0].asDict()))


@dataclass(frozen=True)
class Targets:
    """Candidate targets flagged per series, and the violations behind the flags."""

    flagged: DataFrame
    violations: DataFrame

    def clean(self) -> DataFrame:
        """Targets of the series without any violation."""
        return self.flagged.filter(~F.col("withheld")).drop("withheld")

    def require(self) -> DataFrame:
        """All targets, or an error if any series broke a contract."""
        assert_clean(self.violations)
        return self.clean()


def sma_targets(bars: DataFrame, sessions: DataFrame, *, window: int) -> Targets:
    """Long after a close strictly above its trailing mean; flat otherwise.

    The bars must cover the calendar exactly. The last bar has no next session and emits
    nothing. The comparison is ``close * n > sum`` in decimals, so ties never trigger.
    """
    features.require_positive("window", window)
    aligned = cover(bars, sessions, exact=True)
    spec = segments.series_window(KEY, POSITION, aligned.size)
    framed = segments.cut_with_halo(aligned.bars, POSITION, window - 1, aligned.size)
    scored = features.with_rolling_sums(framed, {"_sum": ("close", window)}, spec).withColumn(
        "decision_at", features.trailing_watermark("available_at", window, spec)
    )
    rows = segments.drop_halo(scored, POSITION, aligned.size).filter(
        F.col("_sum").isNotNull() & F.col("next_open_at").isNotNull()
    )
    is_long = F.col("close") * window > F.col("_sum")
    return _targets(rows, is_long, aligned.violations, aligned.size)


def donchian_targets(
    bars: DataFrame, sessions: DataFrame, *, pairs: Sequence[tuple[int, int]] = ((55, 20),)
) -> Targets:
    """Channel breakout: in above the prior high of n rows, out below the prior low of m rows.

    ``pairs`` is a grid of (entry, exit) windows evaluated in one pass. Entry and exit cannot
    both hold on one bar (high >= low), so "last event wins" equals the stateful rule.
    """
    if any(exit_ > entry for entry, exit_ in pairs):
        raise ValueError("the exit window must not be longer than the entry window")
    aligned = cover(bars, sessions)
    spec = segments.series_window(KEY, POSITION, aligned.size)
    halo = max(entry for entry, _ in pairs)
    framed = segments.cut_with_halo(aligned.bars, POSITION, halo, aligned.size)
    channels = {f"_high_{n}": features.prior_max("high", n, spec) for n, _ in pairs} | {
        f"_low_{m}": features.prior_min("low", m, spec) for _, m in pairs
    }
    rows = segments.drop_halo(framed.withColumns(channels), POSITION, aligned.size)
    highs, lows = sorted({n for n, _ in pairs}), sorted({m for _, m in pairs})
    options = [
        F.struct(
            F.lit(f"{n}/{m}").alias("params"),
            F.lit(n).alias("warmup"),
            F.lit(highs.index(n)).alias("_upper"),
            F.lit(lows.index(m)).alias("_lower"),
        )
        for n, m in pairs
    ]
    upper = F.get(F.array(*[F.col(f"_high_{n}") for n in highs]), F.col("_upper"))
    lower = F.get(F.array(*[F.col(f"_low_{m}") for m in lows]), F.col("_lower"))
    event = F.when(F.col("close") > upper, 1).when(
        (F.col("close") < lower) & upper.isNotNull(), 0
    )
    return _stateful(rows, options, event, aligned)


def rsi_pullback_targets(
    bars: DataFrame,
    sessions: DataFrame,
    *,
    period: int = 2,
    grid: Sequence[tuple[float, float, int]] = ((10, 70, 200),),
) -> Targets:
    """Buy weakness in an uptrend: in at rsi < entry with close > SMA, out at rsi > exit.

    ``grid`` lists (entry, exit, trend window). Thresholds compare the RSI rounded to nine
    digits, so that a mathematically equal value never triggers.
    """
    if any(entry > exit_ for entry, exit_, _ in grid):
        raise ValueError("the entry threshold must not exceed the exit threshold")
    trends = sorted({n for _, _, n in grid})
    if min(trends) <= period:
        raise ValueError("the trend window must be longer than the RSI period")
    aligned = cover(bars, sessions)
    rsi = with_wilder_rsi(aligned.bars, KEY, POSITION, "close", period, size=aligned.size)
    spec = segments.series_window(KEY, POSITION, aligned.size)
    framed = segments.cut_with_halo(rsi, POSITION, max(trends) - 1, aligned.size)
    summed = features.with_rolling_sums(framed, {f"_sum_{n}": ("close", n) for n in trends}, spec)
    rows = segments.drop_halo(summed, POSITION, aligned.size)
    options = [
        F.struct(
            F.lit(f"{entry:g}/{exit_:g}/{n}").alias("params"),
            F.lit(n - 1).alias("warmup"),
            F.lit(float(entry)).alias("_entry"),
            F.lit(float(exit_)).alias("_exit"),
            F.lit(n).alias("_trend"),
            F.lit(trends.index(n)).alias("_which"),
        )
        for entry, exit_, n in grid
    ]
    strength = F.round("rsi", 9)
    total = F.get(F.array(*[F.col(f"_sum_{n}") for n in trends]), F.col("_which"))
    event = (
        F.when(total.isNull(), None)
        .when((strength < F.col("_entry")) & (F.col("close") * F.col("_trend") > total), 1)
        .when(strength > F.col("_exit"), 0)
    )
    return _stateful(rows, options, event, aligned)


def dual_ma_targets(
    period_bars: DataFrame, sessions: DataFrame, *, fast: int = 13, slow: int = 40
) -> Targets:
    """Weekly fast/slow mean: long while the fast mean is strictly above the slow one."""
    if fast >= slow:
        raise ValueError("the fast window must be shorter than the slow window")
    return _period_targets(
        period_bars,
        sessions,
        calendar.WEEK,
        {"_fast": ("close", fast), "_slow": ("close", slow)},
        slow,
        F.col("_fast") * slow > F.col("_slow") * fast,
    )


def period_sma_targets(period_bars: DataFrame, sessions: DataFrame, *, window: int = 10) -> Targets:
    """Monthly close strictly above its trailing mean of ``window`` months."""
    return _period_targets(
        period_bars,
        sessions,
        calendar.MONTH,
        {"_sum": ("close", window)},
        window,
        F.col("close") * window > F.col("_sum"),
    )


def _period_targets(
    period_bars: DataFrame,
    sessions: DataFrame,
    frequency: str,
    sums: dict[str, tuple[str, int]],
    warmup: int,
    is_long: Column,
) -> Targets:
    found = period_violations(period_bars, sessions, frequency)
    keyed = with_calendar_id(period_bars, sessions)
    kept = keyed.join(found.select("asset_id").distinct(), "asset_id", "left_anti")
    # Consecutive periods of a series: at most 53 rows a year, so one window partition each.
    spec = Window.partitionBy("asset_id").orderBy("period_start")
    scored = features.with_rolling_sums(kept, sums, spec).withColumns(
        {
            "decision_at": features.trailing_watermark("available_at", warmup, spec),
            "_index": F.row_number().over(spec) - 1,
        }
    )
    following = calendar.number_sessions(sessions).select(
        "calendar_id", F.col("session").alias("last_session"), "next_open_at"
    )
    rows = (
        scored.filter(F.col("_index") >= warmup - 1)
        .withColumnRenamed("period_end", "_period_end")
        .join(following, ["calendar_id", "last_session"], "left")
        .withColumn("session", F.col("last_session"))
    )
    return _targets(rows, is_long, found, None)


def _stateful(rows: DataFrame, options: Sequence[Column], event: Column, aligned) -> Targets:
    """Latch entry and exit events per series and parameter set.

    The parameter sets are a literal array exploded after the features are computed, so all
    sets share one pass over the bars.
    """
    expanded = rows.select("*", F.inline(F.array(*options))).select(
        "asset_id",
        "params",
        "warmup",
        "session",
        POSITION,
        "available_at",
        "next_open_at",
        event.cast("int").alias("event"),
    )
    state = segments.running(
        expanded,
        ["asset_id", "params"],
        POSITION,
        {
            "_latch": ("last", F.col("event")),
            "decision_at": ("max", F.col("available_at")),
        },
        aligned.size,
    )
    return _targets(
        state.filter(F.col(POSITION) >= F.col("warmup")),
        F.coalesce(F.col("_latch"), F.lit(0)) == 1,
        aligned.violations,
        aligned.size,
        ["asset_id", "params"],
    )


def _targets(
    rows: DataFrame,
    is_long: Column,
    found: DataFrame,
    size: int | None,
    keys: Sequence[str] = ("asset_id",),
) -> Targets:
    """Project targets; a signal without a next session, or not before it, withholds its series."""
    late = F.col("decision_at") >= F.col("next_open_at")
    unscheduled = F.col("next_open_at").isNull()
    flagged = segments.any_in_series(rows, keys, late | unscheduled, "withheld", size).select(
        *keys,
        "session",
        "decision_at",
        F.col("next_open_at").alias("effective_at"),
        is_long.cast("int").alias("weight"),
        "withheld",
    )
    timing = rows.filter(late | unscheduled).select(
        "asset_id",
        F.when(unscheduled, "missing_next_session").otherwise("late_signal").alias("rule"),
        "session",
        F.date_format("decision_at", "yyyy-MM-dd HH:mm:ss").alias("detail"),
    )
    return Targets(flagged, found.unionByName(timing.distinct()))
