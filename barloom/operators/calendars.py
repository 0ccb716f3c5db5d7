"""Many calendars: which one a series follows and when, compiled into one dimension of sessions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.calendar import number_sessions
from barloom.session import scratch_path

SESSION_KEY = ("calendar_id", "session")
_EVER, _NEVER = "0001-01-01", "9999-12-31"


@dataclass(frozen=True)
class Calendars:
    """``assignments`` (asset_id, calendar_id), one row per asset; ``sessions`` of every calendar they name, numbered;
    ``violations`` (asset_id, rule, detail) of the assets that got no calendar."""

    assignments: DataFrame
    sessions: DataFrame
    violations: DataFrame


def with_calendar_id(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows with the calendar they follow.

    Rows that name none follow the only calendar of ``sessions``; where it holds several, nothing says which, so
    they get NULL, match no session and are reported.
    """
    if "calendar_id" in rows.columns:
        return rows
    only = sessions.agg(F.when(F.min("calendar_id") == F.max("calendar_id"), F.min("calendar_id"))).scalar()
    return rows.withColumn("calendar_id", only)


def compile_calendars(mapping: DataFrame, sessions: DataFrame) -> Calendars:
    """Turn effective-dated assignments into one calendar per asset.

    ``mapping`` has asset_id, calendar_id, valid_from and valid_to (dates, the end exclusive, NULL: open). An asset that
    changes its calendar follows a composite one, named after its parts and numbered through, so that a bar always
    belongs to exactly one calendar by a plain equality, and positions count on across the change. Assets of one history
    share a composite. Overlapping or empty validity and unknown calendars are violations, and their assets get
    none. An asset has a handful of entries, repeated ones count once.
    """
    entries = mapping.select(
        "asset_id",
        "calendar_id",
        F.coalesce("valid_from", F.lit(_EVER).cast("date")).alias("valid_from"),
        F.coalesce("valid_to", F.lit(_NEVER).cast("date")).alias("valid_to"),
    ).distinct()
    known = sessions.select("calendar_id").distinct().withColumn("_known", F.lit(True))
    held = entries.join(known, "calendar_id", "left").groupBy("asset_id").agg(
        F.array_sort(F.collect_list(F.struct("valid_from", "valid_to", "calendar_id"))).alias("slices"),
        F.count_if(F.col("_known").isNull()).alias("_unknown"),
    )
    count = F.size("slices")
    overlaps = F.exists(
        F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))),
        lambda k: F.coalesce(F.get("slices", k - 1)["valid_to"] > F.get("slices", k)["valid_from"], F.lit(False)),
    )
    rule = (
        F.when(F.col("_unknown") > 0, "unknown_calendar")
        .when(F.exists("slices", lambda s: s["valid_from"] >= s["valid_to"]), "empty_validity")
        .when(overlaps, "overlapping_validity")
    )
    judged = held.select("asset_id", "slices", rule.alias("rule"), _history(F.col("slices")).alias("calendar_id"))
    sound = judged.filter(F.col("rule").isNull())
    plain = number_sessions(sessions)
    parts = sound.filter(F.col("calendar_id") != F.get("slices", F.lit(0))["calendar_id"])
    slices = parts.select("calendar_id", "slices").distinct().select(F.col("calendar_id").alias("_whole"), F.inline("slices"))
    composite = (
        plain.select("calendar_id", "session", "session_open_at", "session_close_at")
        .join(slices, "calendar_id")
        .filter((F.col("session") >= F.col("valid_from")) & (F.col("session") < F.col("valid_to")))
        .select(F.col("_whole").alias("calendar_id"), "session", "session_open_at", "session_close_at")
    )
    return Calendars(
        sound.select("asset_id", "calendar_id"),
        plain.unionByName(number_sessions(composite)),
        judged.filter(F.col("rule").isNotNull()).select("asset_id", "rule", F.col("calendar_id").alias("detail")),
    )


def assigned(bars: DataFrame, calendars: Calendars) -> DataFrame:
    """Bars with the calendar of their asset, NULL where it has none; one row stays one row."""
    return bars.drop("calendar_id").join(calendars.assignments, "asset_id", "left")


def bucketed(rows: DataFrame, keys: Sequence[str], buckets: int, name: str) -> DataFrame:
    """Store rows in buckets of ``keys``; two tables of the same keys and buckets join without another shuffle.

    One file per bucket, sorted inside, below the shared folder; the table is known to this application's catalog.
    """
    path = scratch_path(rows.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    dealt = rows.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)


def _history(slices: Column) -> Column:
    """A calendar's own name if it holds for ever, else the parts and their validity."""

    def part(s):
        always = (s["valid_from"] == F.lit(_EVER).cast("date")) & (s["valid_to"] == F.lit(_NEVER).cast("date"))
        days = F.concat_ws(",", *[F.date_format(s[c], "yyyy-MM-dd") for c in ("valid_from", "valid_to")])
        return F.when(always, s["calendar_id"]).otherwise(F.concat(s["calendar_id"], F.lit("["), days, F.lit(")")))

    return F.array_join(F.transform(slices, part), "+")
