"""Resampling, completeness, momentum and metrics on hand-made series."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import pytest
from conftest import bar, bars_frame, calendar_frame, instant
from pyspark.sql import functions as F

from barloom.functions.calendar import MONTH, WEEK
from barloom.operators import metrics, momentum
from barloom.operators.contracts import period_rules, split
from barloom.operators.resample import (
    complete_only,
    period_bars,
    period_violations,
    resample_violations,
)
from barloom.plans import strategies

WEEKS = [dt.date(2026, 1, d) for d in (5, 6, 7, 8, 9, 12, 13, 14, 15, 16)]


def resample(spark, days, known, frequency, cutoff):
    rows = [bar(d, 100 + i, high=200 + i, low=50 - i) for i, d in enumerate(days[:known])]
    bars, sessions = bars_frame(spark, rows), calendar_frame(spark, days)
    found = [r.rule for r in resample_violations(bars, sessions, frequency, cutoff).collect()]
    return period_bars(bars, sessions, frequency, cutoff).orderBy("period_start").collect(), found


def test_week_aggregates_and_cutoff_edges(spark):
    # The Friday session is missing: before its close partial, from its close on missing data.
    close = instant(WEEKS[9], 21)
    cases = {
        close - dt.timedelta(seconds=1): "partial_cutoff",
        close: "incomplete_missing_data",
        close + dt.timedelta(minutes=10): "incomplete_missing_data",
    }
    for cutoff, expected in cases.items():
        rows, found = resample(spark, WEEKS, 9, WEEK, cutoff)
        assert [r.completeness for r in rows] == ["complete", expected] and not found
    first, second = rows
    assert (first.open, first.close, first.high, first.low) == (100, 104, 204, 46)
    assert first.volume == 5000 and first.constituent_count == 5
    assert first.cutoff_at == first.available_at == instant(WEEKS[4], 21, 5).replace(tzinfo=None)
    assert second.period_start == dt.date(2026, 1, 12) and second.period_end == dt.date(2026, 1, 18)


def test_unobserved_and_elapsed_weeks(spark):
    before = instant(WEEKS[5], 21) - dt.timedelta(seconds=1)
    rows, found = resample(spark, WEEKS, 5, WEEK, before)
    assert len(rows) == 1 and not found
    _, found = resample(spark, WEEKS, 5, WEEK, instant(WEEKS[5], 21))
    assert found == ["elapsed_period_without_bars"]


def test_month_ends_on_its_last_session_and_gaps_are_reported(spark):
    days = [dt.date(2026, 1, d) for d in (27, 28, 29, 30)]
    far = instant(dt.date(2027, 1, 1), 0)
    rows, _ = resample(spark, days, 4, MONTH, far)
    assert rows[0].last_session == days[3] and rows[0].period_end == dt.date(2026, 1, 31)
    assert rows[0].completeness == "complete"
    bars = bars_frame(spark, [bar(d, 5) for i, d in enumerate(WEEKS) if i != 2])
    found = resample_violations(bars, calendar_frame(spark, WEEKS), WEEK, far)
    assert [r.rule for r in found.collect()] == ["missing_session"]
    late = resample_violations(bars_frame(spark, [bar(WEEKS[0], 5)]), calendar_frame(spark, WEEKS), WEEK, instant(WEEKS[0], 21))
    assert [r.rule for r in late.collect()] == ["bar_after_cutoff"]


def test_complete_gate_and_period_contract(spark):
    bars = bars_frame(spark, [bar(d, 5) for d in WEEKS[:9]])
    weeks = period_bars(bars, calendar_frame(spark, WEEKS), WEEK, instant(WEEKS[9], 22))
    clean, broken = complete_only(weeks)
    assert clean.count() == 1 and broken.first().detail == "incomplete_missing_data"
    found = period_violations(weeks, calendar_frame(spark, WEEKS[1:]), WEEK)
    assert {r.rule for r in found.collect()} == {"incomplete_period", "calendar_mismatch"}
    assert split(weeks, period_rules())[1].count() == 0
    bad = weeks.withColumn("period_end", F.date_add("period_end", 1))
    assert {tuple(r.violations) for r in split(bad, period_rules())[1].collect()} == {("period_bounds",)}


def weekly_series(spark, closes):
    monday = dt.date(2024, 1, 1)
    days = [monday + dt.timedelta(days=7 * i) for i in range(len(closes) + 1)]
    bars = bars_frame(spark, [bar(d, c) for d, c in zip(days, closes)])
    sessions = calendar_frame(spark, days)
    return complete_only(period_bars(bars, sessions, WEEK, instant(dt.date(2030, 1, 1), 0)))[0], sessions


def test_weekly_dual_mean_edges(spark):
    rising, sessions = weekly_series(spark, [100 + i for i in range(41)])
    rows = strategies.dual_ma_targets(rising, sessions).require().orderBy("session").collect()
    assert [r.weight for r in rows] == [1, 1]  # first target at the fortieth week
    flat, sessions = weekly_series(spark, [100] * 40)
    assert [r.weight for r in strategies.dual_ma_targets(flat, sessions).require().collect()] == [0]
    short, sessions = weekly_series(spark, [100] * 39)
    assert strategies.dual_ma_targets(short, sessions).require().count() == 0


def months(spark, closes_by_asset, first=dt.date(2024, 1, 1)):
    rows = []
    for asset, closes in closes_by_asset.items():
        for i, c in enumerate(closes):
            y, m = divmod(first.month - 1 + i, 12)
            start = dt.date(first.year + y, m + 1, 1)
            end = (start + dt.timedelta(days=31)).replace(day=1) - dt.timedelta(days=1)
            rows.append((asset, start, end, Decimal(str(c)), instant(end, 21, 5), "h"))
    return spark.createDataFrame(
        rows,
        "asset_id string, period_start date, period_end date, close decimal(18,6), "
        "available_at timestamp, expected_hash string",
    )


def test_momentum_cases(spark):
    flat = [100] * 12
    cases = {
        ("X", "risk_on"): ([*flat, 120], [*flat, 110]),
        ("Y", "risk_on"): ([*flat, 101], [*flat, 110]),
        (None, "cash_non_positive"): ([*flat, 90], [*flat, 100]),
        (None, "relative_tie"): ([*flat, 110], [200] * 12 + [220]),
    }
    for (asset, reason), (x, y) in cases.items():
        signals = momentum.momentum_selection(months(spark, {"X": x, "Y": y}))
        row = signals.collect()
        assert [(r.selected_asset, r.reason) for r in row] == [(asset, reason)]
        assert row[0].decision_at == instant(dt.date(2025, 1, 31), 21, 5).replace(tzinfo=None)
        assert momentum.signal_violations(signals).count() == 0
    # Closes that differ in the last digit: too near for a double, not for the comparison.
    high, low = Decimal("999999999999.000002"), Decimal("999999999999.000001")
    for x, y, winner in ((high, low, "X"), (low, high, "Y")):
        near = momentum.momentum_selection(months(spark, {"X": [low] * 12 + [x], "Y": [low] * 12 + [y]}))
        assert [(r.selected_asset, r.reason) for r in near.collect()] == [(winner, "risk_on")]
        assert momentum.signal_violations(near).count() == 0
    gapped = months(spark, {"X": [*flat, 120, 130]}).filter(F.month("period_start") != 6)
    assert momentum.momentum_selection(gapped).count() == 0
    forged = signals.withColumn("reason", F.lit("risk_on"))
    assert momentum.signal_violations(forged).first().rule == "winner_missing"


def equity_frame(spark, points):
    return spark.createDataFrame(
        [(k, d, i, Decimal(str(v))) for k, ps in points.items() for i, (d, v) in enumerate(ps)],
        "run_id string, observed_on date, position bigint, equity decimal(18,6)",
    )


def scored(spark, points, policy, **options):
    rows = metrics.metric_set(equity_frame(spark, points), ["run_id"], policy, **options).collect()
    return {r.run_id: r.asDict(recursive=True) for r in rows}


def test_metric_goldens(spark):
    d = dt.date
    points = {
        "base": [(d(2026, 1, 1), 100), (d(2026, 1, 2), 110), (d(2026, 1, 3), 99)],
        "cagr": [(d(2026, 1, 1), 100), (d(2026, 1, 3), 121), (d(2026, 1, 11), 400)],
        "one": [(d(2026, 1, 1), 100)],
        "flat": [(d(2026, 1, i), 100) for i in (1, 2, 3)],
        "ruin": [(d(2026, 1, 1), 100), (d(2026, 1, 2), 0)],
    }
    got = scored(spark, points, metrics.MetricPolicy(4, 2, 0))
    base = got["base"]
    assert math.isclose(base["total_return"]["value"], -0.01)
    assert math.isclose(base["max_drawdown"]["value"], -0.1)
    assert math.isclose(base["volatility"]["value"], 0.2)
    assert abs(base["sharpe"]["value"]) < 1e-12
    assert math.isclose(got["cagr"]["cagr"]["value"], 4 ** (1 / 5) - 1)
    one = got["one"]
    assert {one[m]["reason"] for m in ("total_return", "cagr")} == {"insufficient_equity_observations"}
    assert one["volatility"]["reason"] == one["sharpe"]["reason"] == "insufficient_return_observations"
    assert one["max_drawdown"] == {"status": "valid", "value": 0.0, "reason": None}
    assert got["flat"]["sharpe"] == {"status": "undefined", "value": None, "reason": "zero_volatility"}
    assert got["ruin"]["total_return"]["value"] == -1
    second = scored(spark, points, metrics.MetricPolicy(2, 365, 0), version=2)
    assert math.isclose(second["base"]["volatility"]["value"], 0.1 * math.sqrt(2))
    assert second["ruin"]["cagr"]["value"] == -1


def test_risk_free_kinds_and_ddof(spark):
    d = dt.date
    points = {"r": [(d(2026, 1, 1), 100), (d(2026, 1, 2), 110), (d(2026, 1, 3), 121), (d(2026, 1, 4), 121)]}
    annual = metrics.MetricPolicy(4, 365, 1, 0.04, "annual_effective")
    each = metrics.MetricPolicy(4, 365, 1, 1.04**0.25 - 1)
    a, b = scored(spark, points, annual)["r"], scored(spark, points, each)["r"]
    assert math.isclose(a["sharpe"]["value"], b["sharpe"]["value"])
    returns = [0.1, 0.1, 0.0]
    mean = sum(returns) / 3
    spread = math.sqrt(sum((x - mean) ** 2 for x in returns) / 2) * 2
    assert math.isclose(a["volatility"]["value"], spread)
    for bad in ((0, 365, 0), (4, -1, 0), (4, 365, -1), (4, 365, 0, -1.0)):
        with pytest.raises(ValueError):
            metrics.MetricPolicy(*bad)


def test_exact_returns_of_any_scale(spark):
    rows = [("r", i, v) for i, v in enumerate(("1.000000001", "1.000000002", "1.000000002", "0.500000003"))]
    values = spark.createDataFrame(rows, "run_id string, position long, v string")
    for kind in ("decimal(18,9)", "decimal(38,12)"):
        equity = values.selectExpr("run_id", "position", "position as observed_on", f"cast(v as {kind}) as equity")
        got = metrics.exact_returns(equity, ["run_id"]).orderBy("observed_on").collect()
        assert [(r.numerator, r.denominator) for r in got] == [(1, 1_000_000_001), (0, 1), (-499_999_999, 1_000_000_002)]


def test_exact_returns_and_reconciliation(spark):
    d = dt.date
    equity = equity_frame(
        spark, {"r": [(d(2026, 1, 1), 100), (d(2026, 1, 2), 110), (d(2026, 1, 3), 99), (d(2026, 1, 4), 99)]}
    )
    rows = metrics.exact_returns(equity, ["run_id"]).orderBy("observed_on").collect()
    assert [(r.numerator, r.denominator) for r in rows] == [(1, 10), (-1, 10), (0, 1)]

    def check(values):
        returns = spark.createDataFrame(
            [("r", d(2026, 1, 2 + i), Decimal(v)) for i, v in enumerate(values)],
            "run_id string, observed_on date, value decimal(18,6)",
        )
        return sorted(r.rule for r in metrics.metric_input_violations(equity, returns, ["run_id"]).collect())

    assert check(["0.1", "-0.1", "0"]) == []
    assert check(["0.1", "-0.100001", "0"]) == ["return_mismatch"]
    assert check(["0.1", "-0.1"]) == ["return_missing"]
    assert check(["-1", "-0.1", "0", "0"]) == [
        "invalid_loss", "return_mismatch", "return_without_transition",
    ]
