"""Raw provider captures: canonical content, one stored copy, one log row per observation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import credentials
from barloom.functions.identity import canonical_json
from barloom.session import materialize, path_exists

CONTENTS, OBSERVATIONS = "contents", "observations"
PREFIX, PREFIX_DIGITS = "hash_prefix", 2
CONTENT_COLUMNS = ("content_hash", "endpoint", "request", "records", "schema_version")
OBSERVATION_COLUMNS = (
    "capture_id", "content_hash", "provider", "endpoint", "request_fingerprint", "captured_at", "schema_version",
    "adapter_version", "license_profile", "permitted_uses", "redistribution_allowed", "record_count",
)
STORED = (
    "content_hash string, endpoint string, request map<string,string>, records array<map<string,string>>, "
    f"schema_version string, commit_id string, provider string, {PREFIX} string"
)


def capture_text(df: DataFrame) -> DataFrame:
    """Typed provider columns as stable text: ISO dates and instants, plain decimals.

    A non-finite number stops the job: it has no canonical text.
    """
    out = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            # Fractions only where there are any, without trailing zeros: other texts keep their hash.
            fraction = F.regexp_replace(F.date_format(value, ".SSSSSS"), r"\.?0+$", "")
            value = F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), fraction)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
            value = F.when(value.isNull() | finite, value.cast("string")).otherwise(
                F.raise_error(F.lit(f"{field.name} must be finite"))
            )
        else:
            value = value.cast("string")
        out.append(value.alias(field.name))
    return df.select(*out)


def content_json(records: Column | str = "records") -> Column:
    """Canonical content document: keys sorted at every level, time of capture excluded."""
    rows = F.col(records) if isinstance(records, str) else records
    return canonical_json(
        F.struct(
            F.col("endpoint"),
            F.col("provider"),
            F.transform(rows, _sorted_map).alias("records"),
            _sorted_map(F.col("request")).alias("request"),
            F.col("schema_version"),
        )
    )


def screened(captures: DataFrame) -> DataFrame:
    """``captures`` with ``rejected``: the request carries a credential key at any depth, or JSON that cannot be read.

    Decided inside the row: keys of the map, keys of JSON inside its values, and JSON inside those.
    """
    keyed = credentials.with_json_keys(captures.withColumn("_request", F.to_json("request")), "_request", "_keys", depth=6)
    nested = F.filter(F.map_values("request"), lambda v: v.rlike(r"^\s*[\[{]"))
    unreadable = F.coalesce(F.exists(nested, lambda v: ~credentials.is_readable(v)), F.lit(False))
    named = credentials.names_credential(F.transform("_keys", lambda k: k["key"]))
    return keyed.withColumn("rejected", named | unreadable).drop("_request", "_keys")


def write_captures(captures: DataFrame, path: str, commit_id: str | None = None) -> DataFrame:
    """Store new contents once and log every observation; returns the rejected captures.

    ``captures`` has capture_id, provider, endpoint, request map, records array of maps,
    captured_at, schema_version, adapter_version, license_profile, permitted_uses,
    redistribution_allowed. One rejected row rejects every row of its capture_id.

    The append is a commit of two steps. First contents that the store lacks go below
    ``contents``, partitioned by provider and first hash digits; then the observations go below
    ``observations/commit=<commit_id>``, which makes the commit visible. A commit that stops
    between them leaves contents that nothing refers to; as their hash is their address, the next
    commit finds and keeps them. Repeating a ``commit_id`` replaces its observations, so a
    batch may be written again after a failure. Two writers at once may both store a content;
    readers take one intact copy.

    The input is evaluated once, into the shared folder, without the requests and records of rejected rows.
    """
    spark = captures.sparkSession
    commit_id = commit_id or uuid.uuid4().hex
    staged = materialize(_staged(captures), "captures")
    rejected = staged.filter("rejected").select("capture_id").distinct()
    accepted = staged.filter("not rejected").join(rejected, "capture_id", "left_anti")
    # Only hashes and row numbers take part in the search for new contents. The survivors fetch
    # their records by row number, a key that no two rows share.
    candidates = accepted.groupBy("provider", PREFIX, "content_hash").agg(F.min("_row").alias("_row"))
    if path_exists(spark, f"{path}/{CONTENTS}"):
        candidates = materialize(candidates, "capture-hashes")
        seen = stored_hashes(candidates, path)
        candidates = candidates.join(seen, "content_hash", "left_anti")
    fresh = staged.join(candidates.select("_row"), "_row", "left_semi").select(
        *CONTENT_COLUMNS, F.lit(commit_id).alias("commit_id"), "provider", PREFIX
    )
    fresh.hint("rebalance", "provider", PREFIX).write.mode("append").partitionBy("provider", PREFIX).parquet(
        f"{path}/{CONTENTS}"
    )
    accepted.select(*OBSERVATION_COLUMNS).write.mode("overwrite").parquet(f"{path}/{OBSERVATIONS}/commit={commit_id}")
    return rejected


def stored_hashes(candidates: DataFrame, path: str) -> DataFrame:
    """Hashes among ``candidates`` (provider, hash_prefix, content_hash) that the store holds.

    Only partitions whose prefix occurs are listed (at most 256 prefixes reach the driver), of
    these only the hash column is read. The store is the left side of a semi join on its own
    partition columns, so a small batch prunes its partitions by provider as well, and of a large one
    Spark may push a Bloom filter into the scan.
    """
    spark = candidates.sparkSession
    prefixes = sorted(r[0] for r in candidates.select(PREFIX).distinct().collect())
    stored = _contents(spark, path).filter(F.col(PREFIX).isin(prefixes))
    keys = ["provider", PREFIX, "content_hash"]
    return stored.select(*keys).join(candidates.select(*keys), keys, "left_semi").select("content_hash")


def verify_captures(spark: SparkSession, path: str) -> DataFrame:
    """Check every observation against its stored content: present, same hash, same count."""
    return _judged(spark, path).select("capture_id", "provider", "record_count", "verdict")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all verified observations, one row each, with their position."""
    good = _judged(spark, path).filter(F.col("verdict") == "verified")
    contents = _contents(spark, path).select("content_hash", "commit_id", "request", "records")
    return good.select("capture_id", "content_hash", "captured_at", "commit_id").join(
        contents, ["content_hash", "commit_id"]
    ).select(
        "capture_id",
        "captured_at",
        "request",
        F.posexplode("records").alias("record_index", "record"),
    )


def _staged(captures: DataFrame) -> DataFrame:
    """Rows as the store takes them: hash, address and log columns; no request or record of a rejected row."""
    def unless_rejected(value: Column) -> Column:
        return F.when(~F.col("rejected"), value)

    hashed = screened(captures).withColumn("content_hash", unless_rejected(F.sha2(content_json(), 256)))
    return hashed.withColumns(
        {
            PREFIX: F.substring("content_hash", 1, PREFIX_DIGITS),
            "request_fingerprint": unless_rejected(F.to_json(_sorted_map(F.col("request")))),
            "record_count": F.size("records"),
            "request": unless_rejected(F.col("request")),
            "records": unless_rejected(F.col("records")),
            "_row": F.monotonically_increasing_id(),
        }
    ).select("_row", "rejected", PREFIX, "request", "records", *OBSERVATION_COLUMNS)


def _judged(spark: SparkSession, path: str) -> DataFrame:
    """The log with a verdict for each observation and the commit that holds the copy it was judged by."""
    content = F.sha2(content_json(), 256)
    copy = F.struct((content != F.col("content_hash")).alias("changed"), "commit_id", F.size("records").alias("records"))
    stored = _contents(spark, path).groupBy("content_hash").agg(F.min(copy).alias("_copy"))
    log = spark.read.parquet(f"{path}/{OBSERVATIONS}")
    return log.join(stored, "content_hash", "left").select(
        *[log[c] for c in OBSERVATION_COLUMNS],
        F.col("_copy.commit_id").alias("commit_id"),
        F.when(F.col("_copy").isNull(), "content_missing")
        .when(F.col("_copy.changed"), "content_changed")
        .when(F.col("_copy.records") != F.col("record_count"), "record_count_differs")
        .otherwise("verified")
        .alias("verdict"),
    )


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """All stored contents. Directory names are text: a prefix like ``07`` is no number."""
    return spark.read.schema(STORED).parquet(f"{path}/{CONTENTS}")


def _sorted_map(value: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(value)))
