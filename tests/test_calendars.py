"""Several calendars, changes between them, and stored buckets."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import bar, bars_frame, calendar_frame, weekdays

from barloom.operators import calendars
from barloom.operators.alignment import align, cover, cover_violations
from barloom.operators.resample import period_bars
from barloom.plans import strategies

MAP = "asset_id string, calendar_id string, valid_from date, valid_to date"
DAYS = weekdays("2024-01-01", 30)
CHANGE = DAYS[10]


def both(spark):
    """ALL has every weekday, NO_MONDAY all but Mondays."""
    some = [d for d in DAYS if d.weekday() != 0]
    return calendar_frame(spark, DAYS, "ALL").unionByName(calendar_frame(spark, some, "NO_MONDAY")), some


def compiled(spark, *entries):
    return calendars.compile_calendars(spark.createDataFrame(list(entries), MAP), both(spark)[0])


def test_one_bar_against_two_calendars_stays_one_row(spark):
    sessions, some = both(spark)
    bars = bars_frame(spark, [bar(d, 10, asset=a) for a in "ABC" for d in DAYS])
    found = compiled(spark, ("A", "ALL", None, None), ("B", "NO_MONDAY", None, None))
    rows = align(calendars.assigned(bars, found), found.sessions).collect()
    assert len(rows) == 3 * len(DAYS)
    no = {(r.asset_id, r.session): r.session_no for r in rows}
    assert [no["A", d] for d in DAYS] == list(range(30))
    assert [no["B", d] for d in DAYS] == [some.index(d) if d in some else None for d in DAYS]
    # No calendar is assigned to C, and several calendars say nothing about bars that name none.
    assert {no["C", d] for d in DAYS} == {None}
    assert {r.session_no for r in align(bars, sessions).collect()} == {None}
    wrong = {(r.asset_id, r.rule): r.detail for r in cover_violations(align(bars, sessions)).collect()}
    assert wrong == {(a, "unexpected_session"): "30" for a in "ABC"}


def test_positions_count_on_across_a_change(spark):
    _, some = both(spark)
    found = compiled(
        spark, ("A", "NO_MONDAY", None, CHANGE), ("A", "ALL", CHANGE, None), ("A", "ALL", CHANGE, None), ("B", "ALL", None, None)
    )
    schedule = [d for d in some if d < CHANGE] + [d for d in DAYS if d >= CHANGE]
    bars = bars_frame(spark, [bar(d, 10 + k, asset="A") for k, d in enumerate(schedule)])
    keyed = calendars.assigned(bars, found)
    rows = sorted(align(keyed, found.sessions).collect(), key=lambda r: r.session)
    assert [r.session_no for r in rows] == list(range(len(schedule)))
    assert [r.next_session for r in rows] == [*schedule[1:], None]
    covered = cover(keyed, found.sessions, exact=True)
    assert covered.violations.count() == 0 and covered.bars.count() == len(schedule)
    targets = strategies.sma_targets(keyed, found.sessions, window=3).require().collect()
    assert {r.session: r.effective_at.date() for r in targets} == dict(zip(schedule[2:-1], schedule[3:], strict=True))


def test_assets_of_one_history_share_a_calendar(spark):
    found = compiled(spark, *[(a, c, f, t) for a in "AB" for c, f, t in (("NO_MONDAY", None, CHANGE), ("ALL", CHANGE, None))])
    assert found.assignments.select("calendar_id").distinct().count() == 1
    assert found.sessions.groupBy("calendar_id", "session").count().filter("count > 1").count() == 0


@pytest.mark.parametrize(
    ("entries", "rule"),
    [
        ([("ALL", None, CHANGE), ("NO_MONDAY", DAYS[5], None)], "overlapping_validity"),
        ([("ALL", None, None), ("NO_MONDAY", None, None)], "overlapping_validity"),
        ([("ALL", CHANGE, CHANGE)], "empty_validity"),
        ([("OTHER", None, None)], "unknown_calendar"),
        ([(None, None, None)], "unknown_calendar"),
    ],
)
def test_unsound_assignments_give_no_calendar(spark, entries, rule):
    found = compiled(spark, *[("A", *e) for e in entries], ("B", "ALL", None, None))
    assert [(r.asset_id, r.rule) for r in found.violations.collect()] == [("A", rule)]
    assert [r.asset_id for r in found.assignments.collect()] == ["B"]


def test_periods_follow_the_calendar_of_their_series(spark):
    _, some = both(spark)
    found = compiled(spark, ("A", "ALL", None, None), ("B", "NO_MONDAY", None, None))
    rows = [bar(d, 10, asset="A") for d in DAYS] + [bar(d, 10, asset="B") for d in some] + [bar(DAYS[0], 10, asset="C")]
    weeks = period_bars(calendars.assigned(bars_frame(spark, rows), found), found.sessions, "1w", dt.datetime(2100, 1, 1)).collect()
    counts = {(r.asset_id, r.expected_count, r.constituent_count, r.completeness) for r in weeks}
    # A period that no calendar knows is kept and never complete.
    assert counts == {("A", 5, 5, "complete"), ("B", 4, 4, "complete"), ("C", 0, 1, "incomplete_missing_data")}


def test_buckets_join_without_a_shuffle(spark, capsys):
    found = compiled(spark, ("A", "ALL", None, None), ("B", "NO_MONDAY", None, None))
    bars = bars_frame(spark, [bar(d, 10, asset=a) for a in "AB" for d in DAYS])
    stored = [
        calendars.bucketed(df, calendars.SESSION_KEY, 4, "test") for df in (calendars.assigned(bars, found), found.sessions)
    ]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = align(*stored)
        joined.explain()
        plan = capsys.readouterr().out
        assert joined.count() == 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
