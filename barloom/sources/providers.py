"""Provider rows (text) to normalized daily bars."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.calendars import SESSION_KEY, with_calendar_id
from barloom.operators.contracts import bar_rules, with_violations
from barloom.schemas import PRICE, PRICE_FIELDS, VOLUME

FIELDS = ("date", *PRICE_FIELDS, "volume")


@dataclass(frozen=True)
class Provider:
    """How a provider names its columns and what a row outside the requested range means."""

    source: str
    columns: Mapping[str, str]
    out_of_range: str  # "drop" or "reject"
    empty_is_error: bool


# The two supported row shapes.
LOWER_CASE = Provider("lower", {f: f for f in FIELDS}, "drop", False)
TITLE_CASE = Provider("title", {f: f.title() for f in FIELDS}, "reject", True)


@dataclass(frozen=True)
class Normalized:
    bars: DataFrame
    violations: DataFrame


def parse_session(text: Column) -> Column:
    """Date of a date or timestamp text; the label is the written local date, whatever the zone."""
    instant = F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
    return F.coalesce(
        F.try_to_date(text, "yyyy-MM-dd"),
        F.try_to_date(text, "yyyyMMdd"),
        F.when(instant.isNotNull(), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")),
    )


def parse_decimal(text: Column, kind: str = PRICE) -> Column:
    """Finite decimal of a text; NULL for anything else, including NaN and infinities."""
    return text.try_cast(kind)


def adjustment_mode(flag: Column) -> Column:
    """Strongest claim an adjustment flag supports; never total return."""
    return (
        F.when(flag == "", "raw")
        .when(flag == "qfq", "split_adjusted")
        .otherwise(F.raise_error(F.concat(F.lit("unsupported adjustment: "), flag)))
    )


def attach_session_times(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Open and close instants of each row's session in its own calendar; unknown sessions keep NULLs."""
    times = sessions.select(*SESSION_KEY, "session_open_at", "session_close_at")
    return with_calendar_id(rows, sessions).join(times, [*SESSION_KEY], "left")


def require_columns(raw: DataFrame, provider: Provider) -> None:
    missing = sorted(set(provider.columns.values()) - set(raw.columns))
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))


def normalize_bars(
    raw: DataFrame,
    sessions: DataFrame,
    provider: Provider,
    *,
    start: str | None = None,
    end: str | None = None,
) -> Normalized:
    """Typed bars of every asset whose rows are all acceptable, and what is wrong elsewhere.

    ``raw`` has asset_id plus the provider's text columns, and calendar_id where ``sessions`` holds several. One bad
    row withholds its asset.
    """
    require_columns(raw, provider)
    if start is not None and end is not None and start > end:
        raise ValueError("start must not be later than end")
    text = {field: F.col(name).cast("string") for field, name in provider.columns.items()}
    rows = raw.select(
        "asset_id",
        *[c for c in ("calendar_id",) if c in raw.columns],
        text["date"].alias("_date"),
        parse_session(text["date"]).alias("session"),
        *[parse_decimal(text[f]).alias(f) for f in PRICE_FIELDS],
        parse_decimal(text["volume"], VOLUME).alias("volume"),
    )
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("session") >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside & (F.col("session") <= F.lit(end).cast("date"))
    in_range = F.coalesce(inside, F.lit(True))
    repeated = (
        rows.groupBy("asset_id", "session")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & F.col("session").isNotNull())
        .select("asset_id", "session", F.lit("duplicate_session").alias("rule"))
    )
    kept = rows.filter(in_range) if provider.out_of_range == "drop" else rows
    timed = attach_session_times(kept, sessions).withColumns(
        {"available_at": F.col("session_close_at"), "source": F.lit(f"{provider.source}:raw")}
    )
    rules = {
        "invalid_date": F.col("session").isNotNull(),
        "outside_requested_range": in_range,
        "not_a_session": F.col("session_open_at").isNotNull(),
        **{f"invalid_{f}": F.col(f).isNotNull() for f in (*PRICE_FIELDS, "volume")},
        **bar_rules(),
    }
    judged = with_violations(timed, rules)
    # A row without date or number is reported once, by its first broken rule.
    broken = judged.filter(F.size("violations") > 0).select(
        "asset_id", "session", F.get("violations", F.lit(0)).alias("rule")
    )
    found = broken.unionByName(repeated)
    if provider.empty_is_error:
        empty = (
            rows.groupBy("asset_id")
            .agg(F.count_if(in_range).alias("n"))
            .filter(F.col("n") == 0)
            .select(
                "asset_id",
                F.lit(None).cast("date").alias("session"),
                F.lit("no_bars_in_range").alias("rule"),
            )
        )
        found = found.unionByName(empty)
    clean = timed.join(found.select("asset_id").distinct(), "asset_id", "left_anti")
    return Normalized(
        clean.select(
            "asset_id",
            "source",
            "session",
            "session_open_at",
            "session_close_at",
            "available_at",
            *PRICE_FIELDS,
            "volume",
        ),
        found,
    )
