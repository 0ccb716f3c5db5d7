"""Quality policies as rows: versions with a validity, looked up as of each request, thresholds as columns of the checks.

``policies`` has policy_id, version, valid_from, accepted_schemas (array of text), minimum_sources (1 or 2), pass_bps and
warning_bps (decimal text, at most four places), revision_blocks. ``requests`` has asset_id, requested_start, requested_end,
adjustment_mode, policy_id and as_of, and may have request_id.

One job judges requests under any number of policies. Bars are read as often as under one policy: eight checks do not
depend on it, and the three that do (accepted schemas, number of sources, distance of sources) reduce bars to spans, bitmaps
and far cells before policies come in. Their findings name the policy in ``policy_key``; all others hold under every policy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import digits
from barloom.functions.identity import canonical_json
from barloom.operators import quality
from barloom.operators.quality import SERIES
from barloom.session import materialize

TERMS = ("accepted_schemas", "minimum_sources", "pass_bps", "warning_bps", "revision_blocks")
TOLERANCE, TOLERANCE_TEXT = "decimal(12,4)", r"^[0-9]{1,6}(\.[0-9]{1,4})?$"
#: Checks whose findings depend on the policy but are shared by all requests under it.
PER_POLICY = ("schema_contract", "cross_source_ohlc")


def invalid_policies(policies: DataFrame) -> DataFrame:
    """(policy_id, version, rule): versions no request may be judged by. NULL in any column is invalid."""
    low, high = (F.when(F.col(c).rlike(TOLERANCE_TEXT), F.col(c).cast(TOLERANCE)) for c in ("pass_bps", "warning_bps"))
    schemas = F.col("accepted_schemas")
    distinct = (F.size(schemas) > 0) & (F.size(F.array_distinct(schemas)) == F.size(schemas))
    rules = {
        "invalid_identity": F.col("policy_id").isNotNull() & F.col("version").isNotNull() & F.col("valid_from").isNotNull(),
        "invalid_tolerances": (low <= high) & (high < digits.BPS_LIMIT),
        "invalid_minimum_sources": F.col("minimum_sources").isin(1, 2),
        "invalid_schemas": distinct & ~F.exists(schemas, lambda s: s.isNull()),
        "invalid_revision_rule": F.col("revision_blocks").isNotNull(),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(r)) for r, ok in rules.items()]))
    single = policies.select("policy_id", "version", F.explode(broken).alias("rule"))
    # A version has one row and a day one version.
    twice = [
        policies.groupBy("policy_id", key)
        .agg(F.count(F.lit(1)).alias("_n"), F.collect_set("version").alias("_versions"))
        .filter("_n > 1")
        .select("policy_id", F.explode("_versions").alias("version"), F.lit(rule).alias("rule"))
        for key, rule in (("version", "repeated_version"), ("valid_from", "repeated_validity"))
    ]
    return single.unionByName(twice[0]).unionByName(twice[1]).distinct()


@dataclass(frozen=True)
class Applied:
    """Requests with policy_key, policy_hash and the terms of their version, and those no version judges."""

    requests: DataFrame
    violations: DataFrame


def applied(requests: DataFrame, policies: DataFrame) -> Applied:
    """Give each request the version of its policy that is valid as of ``as_of``.

    The versions of a policy, a handful of rows written by people, travel as one sorted array, so a policy that a third of
    all requests name multiplies nothing. A policy with an invalid version judges nothing; its requests, like those before
    the first version, are violations.
    """
    sound = policies.join(invalid_policies(policies).select("policy_id").distinct(), "policy_id", "left_anti")
    exact = sound.withColumns({c: F.col(c).cast(TOLERANCE) for c in ("pass_bps", "warning_bps")}).withColumn(
        "accepted_schemas", F.array_sort("accepted_schemas")
    )
    terms = F.struct("policy_id", "version", *[F.col(c).cast("string") if c.endswith("bps") else F.col(c) for c in TERMS])
    hashed = exact.withColumn("policy_hash", F.sha2(canonical_json(terms), 256))
    versions = hashed.groupBy("policy_id").agg(
        F.sort_array(F.collect_list(F.struct("valid_from", "version", "policy_hash", *TERMS))).alias("_versions")
    )
    started = F.filter("_versions", lambda v: v["valid_from"] <= F.col("as_of"))
    chosen = requests.join(versions, "policy_id", "left").withColumn("_version", F.get(started, F.size(started) - 1))
    key = F.concat_ws("@", "policy_id", "_version.version")
    found = chosen.filter(F.col("_version").isNotNull()).withColumn("policy_key", key)
    if "request_id" not in requests.columns:
        named = quality.with_request_id(found.select(*requests.columns, "policy_key", "_version"))
        found = named.withColumn("request_id", F.concat_ws("/", "request_id", "policy_key"))
    columns = dict.fromkeys([*requests.columns, "request_id", "policy_key"])
    return Applied(
        found.select(*columns, *[F.col(f"_version.{c}").alias(c) for c in ("policy_hash", *TERMS)]),
        chosen.filter(F.col("_version").isNull()).select(*requests.columns, F.lit("no_policy").alias("rule")),
    )


def findings(
    bars: DataFrame,
    sources: DataFrame,
    sessions: DataFrame,
    requests: DataFrame,
    revision_bars: DataFrame | None = None,
    revisions: DataFrame | None = None,
) -> DataFrame:
    """Findings of all eleven checks for ``applied`` requests, with ``policy_key`` where they hold under one policy only."""
    shared = [
        *quality.policy_free_findings(bars, sources, sessions, requests, revision_bars, revisions),
        quality.requested_range_coverage(bars, sources, sessions, requests, None),
    ]
    own = [_schemas(bars, sources, requests), _conflicts(bars, requests)]
    pair = F.from_json("asset_id", "array<string>")
    named = quality.union_all(own).withColumns({"asset_id": pair[0], "policy_key": pair[1]})
    return quality.union_all(shared).withColumn("policy_key", F.lit(None).cast("string")).unionByName(named)


def check_results(
    found: DataFrame, sources: DataFrame, requests: DataFrame, revisions: DataFrame | None = None
) -> DataFrame:
    """Status of each of the eleven checks per request under its policy."""
    special = F.col("check_id").isin(*PER_POLICY)
    plain = quality.check_results(found.filter("policy_key is null"), sources, requests, revisions).filter(~special)
    scopes = requests.select("asset_id", "policy_key").distinct()
    own = quality.check_results(
        _scoped(found.filter("policy_key is not null")), _scoped(sources.join(scopes, "asset_id")), _scoped(requests)
    ).filter(special)
    return plain.unionByName(_unscoped(own))


def eligibility(found: DataFrame, requests: DataFrame) -> DataFrame:
    """Verdict per request under its policy: counts of findings that hold for all and of those under its policy, added."""
    plain, own = found.filter("policy_key is null"), found.filter("policy_key is not null")
    names = [f"{e}_count" for e in quality.EFFECTS]
    parts = [
        quality.range_eligibility(plain, requests.filter(F.col("revision_blocks") == blocks), quality.QualityPolicy(revision_blocks=blocks))
        for blocks in (False, True)
    ]
    parts.append(_unscoped(quality.range_eligibility(_scoped(own), _scoped(requests), quality.QualityPolicy())))
    keys = ["asset_id", "request_id"]
    counted = quality.union_all([p.select(*keys, *names) for p in parts]).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    judged = requests.select(*keys, "requested_start", "requested_end", "policy_key", "policy_hash").distinct()
    return judged.join(counted, keys).withColumn("status", quality.verdict())


@dataclass(frozen=True)
class PolicyReport:
    findings: DataFrame
    check_results: DataFrame
    eligibility: DataFrame
    violations: DataFrame


def policy_report(
    bars: DataFrame,
    sources: DataFrame,
    sessions: DataFrame,
    requests: DataFrame,
    policies: DataFrame,
    revision_bars: DataFrame | None = None,
    revisions: DataFrame | None = None,
) -> PolicyReport:
    """Findings, check results and verdicts of requests that each follow a policy version of their own."""
    given = applied(requests, policies)
    asked = materialize(given.requests, "policy-requests")
    found = materialize(findings(bars, sources, sessions, asked, revision_bars, revisions), "policy-findings")
    return PolicyReport(found, check_results(found, sources, asked, revisions), eligibility(found, asked), given.violations)


def _schemas(bars: DataFrame, sources: DataFrame, requests: DataFrame) -> DataFrame:
    asked = requests.select("asset_id", "policy_key", "accepted_schemas").distinct()
    refused = sources.join(asked, "asset_id").filter(~F.array_contains("accepted_schemas", F.col("schema_version")))
    return quality.unsupported_schemas(
        _scoped(refused.join(quality.delivered_spans(bars), SERIES, "left")), _scoped(requests)
    )


def _conflicts(bars: DataFrame, requests: DataFrame) -> DataFrame:
    """Cells are first held against the narrowest tolerance of their asset; only those beyond it meet each policy."""
    raw = requests.filter(F.col("adjustment_mode") == "raw")
    allowed = raw.groupBy("asset_id").agg(
        F.min("pass_bps").alias("_narrowest"),
        F.collect_set(F.struct("policy_key", "pass_bps", "warning_bps")).alias("_policies"),
    )
    left, right = F.col("left"), F.col("right")
    far = quality.cross_source_values(bars, requests).join(allowed, "asset_id").filter(
        ~digits.cell_within_symmetric_bps(left, right, F.col("_narrowest"))
    )
    each = far.select(*[c for c in far.columns if c not in ("_narrowest", "_policies")], F.inline("_policies"))
    apart = each.filter(~digits.cell_within_symmetric_bps(left, right, F.col("pass_bps"))).withColumn(
        "_mild", digits.cell_within_symmetric_bps(left, right, F.col("warning_bps"))
    )
    return quality.source_conflicts(_scoped(apart))


def _scoped(rows: DataFrame) -> DataFrame:
    """Rows of one asset under one policy, as an asset of their own."""
    return rows.withColumn("asset_id", F.to_json(F.array("asset_id", "policy_key")))


def _unscoped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("asset_id", F.from_json("asset_id", "array<string>")[0])
