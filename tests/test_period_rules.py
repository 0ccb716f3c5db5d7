"""Constituents of a period against the sessions it should begin with."""

from __future__ import annotations

import datetime as dt

from conftest import bar, bars_frame, calendar_frame, instant, weekdays

from barloom.operators.resample import constituent_violations

DAYS = weekdays("2026-01-05", 20)
CUT = dt.datetime(2026, 2, 2)


def broken(spark, rows, days=DAYS):
    found = constituent_violations(bars_frame(spark, rows), calendar_frame(spark, days), "1w", CUT).collect()
    return sorted((r.asset_id, r.rule, r.session.day, r.detail) for r in found)


def test_a_prefix_is_sound(spark):
    assert broken(spark, [bar(d, 10) for d in DAYS[:13]]) == []
    assert broken(spark, []) == []


def test_holes_swaps_repeats_and_strange_sessions(spark):
    rows = [bar(d, 10, asset="hole") for k, d in enumerate(DAYS[:15]) if k != 6]
    # A Saturday stands in for the Wednesday: as many bars as sessions.
    rows += [bar(d, 10, asset="swap") for k, d in enumerate(DAYS[:5]) if k != 2] + [bar(DAYS[4] + dt.timedelta(1), 10, asset="swap")]
    rows += [bar(d, 10, asset="twice") for d in (*DAYS[:4], DAYS[3])] * 400
    rows += [bar(dt.date(2030, 1, 7), 10, asset="strange")]
    assert broken(spark, rows) == [
        ("hole", "not_a_prefix", 12, "4"),
        ("strange", "available_after_cutoff", 7, "1"),
        ("strange", "not_a_prefix", 7, "1"),
        ("swap", "not_a_prefix", 5, "5"),
        ("twice", "not_a_prefix", 5, "2000"),
    ]


def test_every_bar_is_in_time(spark):
    rows = [bar(d, 10, available=instant(d, 20, 59) if k == 1 else instant(d + dt.timedelta(40), 9) if k in (7, 8) else None) for k, d in enumerate(DAYS[:10])]
    assert broken(spark, rows) == [("X", "available_after_cutoff", 12, "2"), ("X", "available_before_close", 5, "1")]
