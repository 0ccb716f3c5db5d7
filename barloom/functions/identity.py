"""Canonical text and content identities, computed inside Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Instants are written with microseconds and a numeric UTC offset.
INSTANT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"
CHUNK_ROWS = 4096


def canonical_decimal(value: Column) -> Column:
    """Scale-free decimal text: 1.50 and 1.5 are the same, zero has no sign."""
    text = F.regexp_replace(F.format_string("%s", value.cast("string")), r"(\.\d*?)0+$", "$1")
    trimmed = F.regexp_replace(text, r"\.$", "")
    return F.when(value == 0, "0").otherwise(trimmed)


def canonical_json(value: Column) -> Column:
    """Compact JSON of a struct whose fields are already in name order; NULLs are kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def instant_text(value: Column) -> Column:
    return F.date_format(value, INSTANT_FORMAT)


def stable_id(namespace: str, payload: Column, length: int = 24) -> Column:
    """``namespace_<hex>`` over the namespace and the canonical JSON text."""
    if not namespace.strip() or not 12 <= length <= 64:
        raise ValueError("need a namespace and a length between 12 and 64")
    digest = F.sha2(F.concat(F.lit(f"{namespace}\n"), payload), 256)
    return F.concat(F.lit(f"{namespace}_"), F.substring(digest, 1, length))


def bar_payload() -> Column:
    """Canonical JSON of one bar row."""
    return canonical_json(
        F.struct(
            F.col("asset_id").alias("asset"),
            instant_text(F.col("available_at")).alias("available_at"),
            canonical_decimal(F.col("close")).alias("close"),
            canonical_decimal(F.col("high")).alias("high"),
            canonical_decimal(F.col("low")).alias("low"),
            canonical_decimal(F.col("open")).alias("open"),
            F.date_format("session", "yyyy-MM-dd").alias("session"),
            instant_text(F.col("session_close_at")).alias("session_close_at"),
            instant_text(F.col("session_open_at")).alias("session_open_at"),
            F.col("source"),
            canonical_decimal(F.col("volume")).alias("volume"),
        )
    )


def period_payload() -> Column:
    """Canonical JSON of one period bar."""
    return canonical_json(
        F.struct(
            F.col("asset_id").alias("asset"),
            instant_text(F.col("available_at")).alias("available_at"),
            canonical_decimal(F.col("close")).alias("close"),
            F.col("constituent_count"),
            instant_text(F.col("cutoff_at")).alias("cutoff_at"),
            F.col("expected_hash"),
            F.col("frequency"),
            canonical_decimal(F.col("high")).alias("high"),
            canonical_decimal(F.col("low")).alias("low"),
            canonical_decimal(F.col("open")).alias("open"),
            F.date_format("period_start", "yyyy-MM-dd").alias("period_start"),
            canonical_decimal(F.col("volume")).alias("volume"),
        )
    )


def signal_payload() -> Column:
    """Canonical JSON of one momentum signal."""
    return canonical_json(
        F.struct(
            instant_text(F.col("decision_at")).alias("decision_at"),
            F.date_format("period_end", "yyyy-MM-dd").alias("observed_period_end"),
            F.date_format("period_start", "yyyy-MM-dd").alias("observed_period_start"),
            F.col("reason"),
            F.col("selected_asset"),
        )
    )


def series_fingerprint(
    bars: DataFrame, keys: Sequence[str], sequence: str, payload: Column | None = None
) -> DataFrame:
    """Order-sensitive fingerprint of each series.

    Rows hash alone, runs of 4096 positions hash together, 4096 such runs hash together, and so do those: no list
    is longer than 4096 digests in a series of up to 68 billion rows.
    """
    hashed = bars.select(
        *keys,
        F.floor(F.col(sequence) / CHUNK_ROWS).cast("long").alias("_chunk"),
        F.col(sequence).alias("_at"),
        F.sha2(bar_payload() if payload is None else payload, 256).alias("_hash"),
    )
    chunks = hashed.groupBy(*keys, "_chunk").agg(
        _hash_in_order("_at", "_hash").alias("_hash"), F.count(F.lit(1)).alias("_rows")
    )
    spans = chunks.groupBy(*keys, F.floor(F.col("_chunk") / CHUNK_ROWS).cast("long").alias("_span")).agg(
        _hash_in_order("_chunk", "_hash").alias("_hash"), F.sum("_rows").alias("_rows")
    )
    return spans.groupBy(*keys).agg(
        _hash_in_order("_span", "_hash").alias("content_hash"),
        F.sum("_rows").alias("row_count"),
    )


def session_set_hash(sessions: DataFrame) -> DataFrame:
    """Hash of each calendar's distinct ordered sessions (one row per date at most)."""
    return (
        sessions.groupBy("calendar_id")
        .agg(
            F.array_sort(F.collect_set(F.date_format("session", "yyyy-MM-dd"))).alias("sessions")
        )
        .select(
            "calendar_id",
            F.sha2(canonical_json(F.struct("calendar_id", "sessions")), 256).alias(
                "sessions_hash"
            ),
            F.size("sessions").alias("session_count"),
        )
    )


def _hash_in_order(order: str, value: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(order, value)))
    return F.sha2(F.array_join(F.transform(ordered, lambda item: item[value]), "\n"), 256)
