"""Fixture folders: bars, calendar and manifest read and checked as one unit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import schemas
from barloom.functions.identity import series_fingerprint, session_set_hash
from barloom.operators.alignment import align, cover_violations
from barloom.operators.calendars import with_calendar_id


@dataclass(frozen=True)
class Fixture:
    bars: DataFrame
    sessions: DataFrame
    manifest: DataFrame
    violations: DataFrame


def read_bars_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV bars with a declared schema; a malformed line fails the read."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")


def read_calendar_json(spark: SparkSession, path: str) -> DataFrame:
    """Calendar rows as JSON lines with a declared schema."""
    return spark.read.json(path, schema=schemas.SESSIONS, mode="FAILFAST")


def write_fixture(bars: DataFrame, sessions: DataFrame, fixture_id: str, path: str) -> None:
    """Store bars and calendar with a manifest of counts and hashes per asset."""
    _require_id(fixture_id)
    bars.write.parquet(f"{path}/{fixture_id}/bars")
    sessions.write.parquet(f"{path}/{fixture_id}/sessions")
    _manifest(bars, sessions).withColumn("fixture_id", F.lit(fixture_id)).write.parquet(
        f"{path}/{fixture_id}/manifest"
    )


def read_fixture(spark: SparkSession, fixture_id: str, path: str) -> Fixture:
    """Read one explicitly named fixture; there is no notion of a latest one."""
    _require_id(fixture_id)
    root = f"{path}/{fixture_id}"
    bars = spark.read.parquet(f"{root}/bars")
    sessions = spark.read.parquet(f"{root}/sessions")
    manifest = spark.read.parquet(f"{root}/manifest")
    actual = _manifest(bars, sessions)
    pairs = manifest.select("asset_id", F.struct("row_count", "content_hash", "sessions_hash").alias("_m")).join(
        actual.select("asset_id", F.struct("row_count", "content_hash", "sessions_hash").alias("_a")),
        "asset_id",
        "full_outer",
    )
    changed = F.when(F.col("_m").isNull() | F.col("_a").isNull(), "asset_set_differs")
    for name in ("row_count", "content_hash", "sessions_hash"):
        changed = changed.when(~F.col(f"_m.{name}").eqNullSafe(F.col(f"_a.{name}")), f"{name}_differs")
    mismatched = pairs.select("asset_id", changed.alias("rule")).filter(F.col("rule").isNotNull())
    uncovered = cover_violations(align(bars, sessions), exact=True).select("asset_id", "rule")
    return Fixture(bars, sessions, manifest, mismatched.unionByName(uncovered))


def _manifest(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    prints = series_fingerprint(align(bars, sessions), ["asset_id"], "session_no")
    followed = with_calendar_id(bars, sessions).select("asset_id", "calendar_id").distinct()
    hashes = followed.join(session_set_hash(sessions), "calendar_id", "left").select("asset_id", "sessions_hash")
    return prints.join(hashes, "asset_id").select("asset_id", "row_count", "content_hash", "sessions_hash")


def _require_id(fixture_id: str) -> None:
    if not fixture_id or fixture_id == "latest" or "/" in fixture_id:
        raise ValueError("name one explicit fixture")
