"""Streams of daily bars: weekly and monthly periods with a cutoff, and quarantine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.functions import calendar
from barloom.operators.calendars import with_calendar_id
from barloom.operators.contracts import bar_rules, with_violations
from barloom.operators.resample import COMPLETE, MISSING_DATA, expected_periods

#: Kinds of rows that the stream of periods emits.
PERIOD, LATE, SURPLUS = "period", "late", "surplus"

_KEY = ("asset_id", "source", "calendar_id", "period_start")
_SUMS = (
    "open decimal(18,6), high decimal(18,6), low decimal(18,6), close decimal(18,6), volume decimal(24,6), "
    "first_session date, last_session date, available_at timestamp, constituent_count bigint"
)
_OUTPUT = (
    "asset_id string, source string, calendar_id string, period_start date, kind string, "
    f"{_SUMS}, expected_count bigint, cutoff_at timestamp, completeness string, row_count bigint"
)
_STATE = f"{_SUMS}, expected_count bigint, cutoff_at timestamp, emitted boolean"
_FIELDS = [part.split()[0] for part in _STATE.split(", ")]


def period_stream(
    bars: DataFrame, sessions: DataFrame, frequency: str, *, lag: str = "12 hours", delay: str = "3 days"
) -> DataFrame:
    """Period bars of a stream, by session label and the calendar of each series.

    A period is emitted once (kind ``period``): as soon as it holds every expected session, or when the watermark passes
    its cutoff, ``lag`` after the close of its last expected session; then it is short of data. Bars that became available
    after the cutoff are ``late`` whenever they arrive, bars beyond the expected number are ``surplus``; both are counted in
    ``row_count`` and never change a period that went out. Periods without a cutoff in sight stay open in the
    state, one row each. Event time is ``available_at``: rows that arrive more than ``delay`` behind it are dropped by Spark,
    which :func:`dropped_rows` reports. A period that the calendar does not know is due ``lag`` after its last day and never
    complete.
    """
    expected = expected_periods(sessions, frequency).select(
        "calendar_id", "period_start", "expected_count", F.element_at("expected_closes", -1).alias("_last_close")
    )
    start = calendar.period_start(F.col("session"), frequency)
    ends = F.date_add(calendar.period_end(F.col("period_start"), frequency), 1).cast("timestamp")
    due = F.coalesce("_last_close", ends) + F.expr(f"interval {lag}")
    rows = (
        with_calendar_id(bars, sessions)
        .withColumn("period_start", start)
        .join(expected, ["calendar_id", "period_start"], "left")
        .select(
            *_KEY,
            "session",
            *["open", "high", "low", "close", "volume", "available_at"],
            F.coalesce("expected_count", F.lit(0)).alias("expected_count"),
            due.alias("cutoff_at"),
        )
    )
    return (
        rows.withWatermark("available_at", delay)
        .groupBy(*_KEY)
        .applyInPandasWithState(_advanced, _OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def _folded(held: dict | None, rows: pd.DataFrame) -> dict:
    """State of a period with further bars in it."""
    rows = rows.sort_values(["session", "available_at"], kind="stable")
    first, last = rows.iloc[0], rows.iloc[-1]
    new = {
        "open": first["open"],
        "high": max(rows["high"]),
        "low": min(rows["low"]),
        "close": last["close"],
        "volume": sum(rows["volume"]),
        "first_session": first["session"],
        "last_session": last["session"],
        "available_at": max(rows["available_at"]),
        "constituent_count": len(rows),
    }
    if held is None:
        return new | {"expected_count": int(first["expected_count"]), "cutoff_at": first["cutoff_at"], "emitted": False}
    earlier, later = new["first_session"] < held["first_session"], new["last_session"] > held["last_session"]
    return held | {
        "open": new["open"] if earlier else held["open"],
        "high": max(held["high"], new["high"]),
        "low": min(held["low"], new["low"]),
        "close": new["close"] if later else held["close"],
        "volume": held["volume"] + new["volume"],
        "first_session": min(held["first_session"], new["first_session"]),
        "last_session": max(held["last_session"], new["last_session"]),
        "available_at": max(held["available_at"], new["available_at"]),
        "constituent_count": held["constituent_count"] + new["constituent_count"],
    }


def _advanced(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One period's next step: take its new bars, emit it when it is whole or due."""
    columns = [part.split()[0] for part in _OUTPUT.split(", ")]
    out: list[dict] = []

    def row(kind: str, fields: dict, count: int) -> None:
        out.append(dict(zip(_KEY, key, strict=True)) | {"kind": kind, "row_count": count} | fields)

    def period(held: dict) -> None:
        whole = held["constituent_count"] == held["expected_count"]
        row(PERIOD, held | {"completeness": COMPLETE if whole else MISSING_DATA}, int(held["constituent_count"]))

    held = dict(zip(_FIELDS, state.get, strict=True)) if state.exists else None
    if state.hasTimedOut:
        if not held["emitted"]:
            period(held)
        state.remove()
    else:
        counts = {LATE: 0, SURPLUS: 0}
        for rows in batches:
            late = rows["available_at"] > rows["cutoff_at"]
            counts[LATE] += int(late.sum())
            rows = rows[~late]
            if len(rows) and held is not None and held["emitted"]:
                counts[SURPLUS] += len(rows)
            elif len(rows):
                held = _folded(held, rows)
        for kind, count in counts.items():
            if count:
                row(kind, {}, count)
        if held is not None:
            due_ms = int(pd.Timestamp(held["cutoff_at"]).timestamp() * 1000)
            is_due = due_ms <= state.getCurrentWatermarkMs()
            if not held["emitted"] and (is_due or held["constituent_count"] == held["expected_count"]):
                period(held)
                held = held | {"emitted": True}
            if is_due:
                if state.exists:
                    state.remove()
            else:
                # Kept until the cutoff even if it is out, so that it does not go out twice.
                state.update(tuple(held[f] for f in _FIELDS))
                state.setTimeoutTimestamp(due_ms)
    if out:
        yield pd.DataFrame([{c: r.get(c) for c in columns} for r in out], columns=columns)


def dropped_rows(query: StreamingQuery) -> int:
    """Rows of a finished or running query that arrived behind the watermark and were left out."""
    return sum(op["numRowsDroppedByWatermark"] for step in query.recentProgress for op in step["stateOperators"])


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run everything available and append it to a table."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def quarantine_stream(
    bars: DataFrame, clean_path: str, quarantine_path: str, checkpoint: str
) -> StreamingQuery:
    """Send bars that keep the bar contract to one table and the others to another.

    Both writes of a batch go below its batch id in overwrite mode, so a batch that is
    repeated after a failure replaces its own output.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # One evaluation of the batch for both writes.
        judged = with_violations(batch, bar_rules()).persist()
        clean = F.size("violations") == 0
        judged.filter(clean).drop("violations").write.mode("overwrite").parquet(f"{clean_path}/batch={batch_id}")
        judged.filter(~clean).write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")
        judged.unpersist()

    return (
        bars.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
