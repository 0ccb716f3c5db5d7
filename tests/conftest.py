from __future__ import annotations

import datetime as dt
import sys
import tempfile
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barloom import schemas  # noqa: E402
from barloom.session import build_session  # noqa: E402

UTC = dt.timezone.utc


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def instant(day: dt.date, hour: int, minute: int = 0) -> dt.datetime:
    return dt.datetime(day.year, day.month, day.day, hour, minute, tzinfo=UTC)


def weekdays(first: str, count: int) -> list[dt.date]:
    day, out = dt.date.fromisoformat(first), []
    while len(out) < count:
        if day.weekday() < 5:
            out.append(day)
        day += dt.timedelta(days=1)
    return out


def bar(day, close, *, asset="X", source="s", open_=None, high=None, low=None, volume=1000, available=None):
    close = Decimal(str(close))
    open_ = close if open_ is None else Decimal(str(open_))
    high = max(open_, close) if high is None else Decimal(str(high))
    low = min(open_, close) if low is None else Decimal(str(low))
    return (
        asset,
        source,
        0,
        day,
        instant(day, 14, 30),
        instant(day, 21),
        available or instant(day, 21, 5),
        open_,
        high,
        low,
        close,
        Decimal(volume),
    )


def bars_frame(spark, rows):
    return spark.createDataFrame(rows, schemas.BARS)


def calendar_frame(spark, days, calendar_id="CAL"):
    return spark.createDataFrame(
        [(calendar_id, d, instant(d, 14, 30), instant(d, 21)) for d in days], schemas.SESSIONS
    )
