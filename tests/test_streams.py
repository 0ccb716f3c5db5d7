"""Periods of a stream: cutoff, late and surplus bars, open periods, restarts."""

from __future__ import annotations

import datetime as dt
import tempfile

from conftest import bar, bars_frame, calendar_frame, instant, weekdays
from pyspark.sql import functions as F

from barloom.operators.resample import period_bars
from barloom.streaming import bars as streams

DAYS = weekdays("2026-01-05", 20)
FAR = dt.datetime(2100, 1, 1)


class Feed:
    """A folder of bar files read one file per batch, in order of arrival."""

    def __init__(self, spark, sessions, frequency="1w", **options):
        self.spark, self.root = spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        self.sessions, self.frequency, self.options, self.files = sessions, frequency, options, 0

    def add(self, rows):
        self.files += 1
        bars_frame(self.spark, rows).coalesce(1).write.parquet(f"{self.root}/in/f={self.files:03d}")
        return self

    def run(self):
        """All waiting files, from the checkpoint of the run before."""
        source = self.spark.readStream.schema(bars_frame(self.spark, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in/*")
        periods = streams.period_stream(source, self.sessions, self.frequency, **self.options)
        self.query = streams.append_to(periods, f"{self.root}/out", f"{self.root}/state")
        self.query.awaitTermination()
        return sorted(self.spark.read.parquet(f"{self.root}/out").collect(), key=lambda r: (r.asset_id, r.period_start, r.kind))


def brief(rows):
    return [(r.period_start.day, r.kind, r.row_count, r.completeness) for r in rows]


def test_weeks_go_out_whole_or_at_their_cutoff(spark):
    feed = Feed(spark, calendar_frame(spark, DAYS), delay="1 hour")
    bars = [bar(d, 10 + i) for i, d in enumerate(DAYS) if i not in (6, 18)]
    feed.add(bars[:5]).add(bars[5:9]).add(bars[9:12]).add(bars[12:14])
    # The second week lacks a bar and goes out once a later bar moves the watermark past its cutoff.
    assert brief(feed.run()) == [(5, "period", 5, "complete"), (12, "period", 4, "incomplete_missing_data"), (19, "period", 5, "complete")]
    # A restart goes on with the open week and repeats nothing; the last week stays open.
    feed.add(bars[14:16]).add(bars[16:])
    rows = feed.run()
    assert brief(rows)[3:] == [] and len(rows) == 3
    assert (rows[0].open, rows[0].close, rows[0].high, rows[0].low, rows[0].volume) == (10, 14, 14, 10, 5000)
    assert rows[1].cutoff_at == dt.datetime(2026, 1, 17, 9) and rows[1].expected_count == 5


def test_late_and_surplus_bars_are_counted_and_change_nothing(spark):
    feed = Feed(spark, calendar_frame(spark, DAYS), delay="30 days")
    week = [bar(d, 10 + i) for i, d in enumerate(DAYS[:5])]
    late = bar(DAYS[7], 99, available=instant(DAYS[14], 9))
    feed.add(week[:3]).add(week[3:]).add(week[2:3] * 2).add([bar(d, 20) for d in (*DAYS[5:7], *DAYS[8:10])]).add([late])
    assert brief(feed.run()) == [(5, "period", 5, "complete"), (5, "surplus", 2, None), (12, "late", 1, None)]
    # The watermark passes the second week's cutoff much later.
    feed.add([bar(DAYS[19], 30, available=instant(DAYS[19] + dt.timedelta(60), 9))]).run()
    rows = feed.add([bar(DAYS[19], 30)]).run()
    assert brief(rows)[2:4] == [(12, "late", 1, None), (12, "period", 4, "incomplete_missing_data")]
    # That bar of the last week was itself late, and the one after it came behind the watermark.
    assert brief(rows)[4:] == [(26, "late", 1, None)]
    assert streams.dropped_rows(feed.query) == 1


def test_labels_count_not_the_close_in_utc(spark):
    """A Sunday close in UTC that belongs to Monday's session."""
    sessions = spark.createDataFrame(
        [("C", d, instant(d - dt.timedelta(1), 22), instant(d, 6)) for d in DAYS[:10]],
        "calendar_id string, session date, session_open_at timestamp, session_close_at timestamp",
    )
    rows = [(*bar(d, 10)[:4], instant(d - dt.timedelta(1), 22), instant(d - dt.timedelta(1), 23), instant(d, 7), *bar(d, 10)[7:]) for d in DAYS[:10]]
    assert brief(Feed(spark, sessions).add(rows).run()) == [(5, "period", 5, "complete"), (12, "period", 5, "complete")]


def test_months_and_several_calendars_equal_the_batch_result(spark):
    days = weekdays("2026-01-01", 60)
    some = [d for d in days if d.weekday() != 2]
    sessions = calendar_frame(spark, days, "ALL").unionByName(calendar_frame(spark, some, "SOME"))
    rows = [bar(d, 10 + k % 7, asset="A") for k, d in enumerate(days)] + [bar(d, 20 - k % 5, asset="B") for k, d in enumerate(some)]
    keyed = bars_frame(spark, rows).withColumn("calendar_id", F.when(F.col("asset_id") == "A", "ALL").otherwise("SOME"))
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    keyed.repartition(4).write.parquet(f"{root}/in")
    source = spark.readStream.schema(keyed.schema).parquet(f"{root}/in")
    streams.append_to(streams.period_stream(source, sessions, "1mo"), f"{root}/out", f"{root}/state").awaitTermination()
    names = ["asset_id", "period_start", "open", "high", "low", "close", "volume", "available_at", "constituent_count", "completeness"]
    streamed = spark.read.parquet(f"{root}/out").select(names)
    assert sorted(streamed.collect()) == sorted(period_bars(keyed, sessions, "1mo", FAR).select(names).collect())


def test_a_week_that_no_calendar_knows_is_never_complete(spark):
    feed = Feed(spark, calendar_frame(spark, DAYS[5:]), delay="1 hour")
    feed.add([bar(d, 10) for d in DAYS[:5]]).add([bar(d, 10) for d in DAYS[5:10]])
    rows = feed.run()
    assert brief(rows) == [(5, "period", 5, "incomplete_missing_data"), (12, "period", 5, "complete")]
    assert rows[0].expected_count == 0


def test_an_empty_stream_gives_no_rows(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    bars = bars_frame(spark, [])
    bars.write.parquet(f"{root}/in")
    source = spark.readStream.schema(bars.schema).parquet(f"{root}/in")
    periods = streams.period_stream(source, calendar_frame(spark, DAYS), "1w")
    streams.append_to(periods, f"{root}/out", f"{root}/state").awaitTermination()
    assert spark.read.schema(periods.schema).parquet(f"{root}/out").count() == 0
